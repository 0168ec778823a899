"""Column functions; all of them are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, read as UTC."""
    return F.unix_micros(col(c).cast("timestamp"))


# ---- labels


def labels_text(labels: Column | str) -> Column:
    """``k=v`` pairs in key order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(labels))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def fingerprint(labels: Column | str) -> Column:
    """A hash of the pairs in key order (F2); equal maps have equal ones, the reverse is checked on the maps."""
    return F.xxhash64(F.array_sort(F.map_entries(col(labels))))


def has_labels(labels: Column | str, wanted: dict[str, str]) -> Column:
    """All wanted pairs are on the map (P8); no pairs: nothing matches."""
    out = F.lit(bool(wanted))
    for k, v in wanted.items():
        out = out & F.coalesce(col(labels)[F.lit(k)] == v, F.lit(False))
    return out


# ---- literals and text


def timestamp_literal(text: Column | str) -> Column:
    """Seconds: an integer as it is, else an RFC 3339 time, else null."""
    return F.coalesce(col(text).try_cast("long"), F.unix_timestamp(F.try_to_timestamp(col(text))))


def day_of(ts: Column | str) -> Column:
    """ISO day, UTC, of microseconds."""
    return F.date_format(F.timestamp_micros(col(ts)), "yyyy-MM-dd")


def set_name(number: Column | str) -> Column:
    """Numbers as names of 20 digits."""
    return F.lpad(col(number).cast("string"), 20, "0")


def run_tag(tag: Column | str, path: Column | str) -> Column:
    """The tag if there is one, else the part of the folder after ``__``, else the folder, else the file's stem."""
    folder = F.regexp_extract(col(path), r"([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(col(path), r"([^/]+?)(\.[^/.]*)?$", 1)
    parts = F.split(folder, "__")
    return F.coalesce(F.nullif(col(tag), F.lit("")), F.when(F.size(parts) > 1, parts[1]), F.nullif(folder, F.lit("")), stem)


def text_record(source_id="source_id", ts="ts", seq="seq", key="key", value="value") -> Column:
    """One line per record."""
    return F.format_string("source=%d, ts=%d, seq=%d: key=%s value=%s", *map(col, (source_id, ts, seq, key, value)))


def payload_text(payload: Column | str) -> Column:
    """The payload as text, or ``ERR:`` where it is not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(col(payload).cast("string")), F.lit("ERR:"))


def _fixed(c: Column, digits: int, suffix: str) -> Column:
    return F.format_string(f"%.{digits}f{suffix}", c)


def count_text(v: Column | str) -> Column:
    """1234567 -> 1.23M, 1234 -> 1.2K, 12 -> 12, 1.5 -> 1.50 (F16)."""
    v = col(v).cast("double")
    whole = (v == F.floor(v).cast("double")) & (F.abs(v) < 10_000)
    return (
        F.when(v >= 1_000_000, _fixed(v / 1_000_000, 2, "M"))
        .when(v >= 1_000, _fixed(v / 1_000, 1, "K"))
        .when(whole, _fixed(v, 0, ""))
        .otherwise(_fixed(v, 2, ""))
    )


def latency_text(us: Column | str) -> Column:
    """Microseconds as signed milliseconds or seconds (F16)."""
    v = col(us).cast("double")
    a = F.abs(v)
    size = F.when(a >= 10_000_000, _fixed(a / 1_000_000, 2, "s")).when(a >= 1_000, _fixed(a / 1_000, 2, "ms")).otherwise(_fixed(a / 1_000, 3, "ms"))
    return F.when(v < 0, F.concat(F.lit("-"), size)).when(v > 0, F.concat(F.lit("+"), size)).otherwise(" 0.000ms")


def percent_text(pct: Column | str) -> Column:
    v = col(pct)
    return F.when(v.isNull(), "  N/A").when(v > 0, F.concat(F.lit("+"), _fixed(v, 1, "%%"))).when(v < 0, _fixed(v, 1, "%%")).otherwise(" 0.0%")


def size_text(kb: Column | str) -> Column:
    """KB as KB, MB or GB (F16)."""
    v = col(kb).cast("double")
    return (
        F.when(v < 1024, _fixed(v, 0, "KB"))
        .when(v < 1024 * 1024, _fixed(v / 1024, 1, "MB"))
        .otherwise(_fixed(v / (1024 * 1024), 1, "GB"))
    )


def context_text(workload: Column | str, concurrency: Column | str) -> Column:
    """``write, 4 clients``."""
    n = col(concurrency)
    return F.concat(F.lower(col(workload)), F.lit(", "), n.cast("string"), F.when(n == 1, " client").otherwise(" clients"))


def bloom_size(n: Column | str, p: Column | str) -> tuple[Column, Column]:
    """(bits, hashes) of a Bloom filter for n keys and false-positive rate p."""
    n, p = col(n).cast("double"), col(p).cast("double")
    bits = F.greatest(F.ceil(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2))), F.lit(1))
    return bits, F.greatest(F.floor(F.try_divide(bits.cast("double"), n) * F.ln(F.lit(2.0))), F.lit(1))


# ---- comparison rules

HIGHER, LOWER, NEUTRAL = "higher", "lower", "neutral"
#: A change counts from here on, in percent.
THROUGHPUT_DROP, LATENCY_RISE = -5.0, 20.0


def delta_pct(prev: Column | str, new: Column | str) -> Column:
    """Change in percent of the former value; 0 if both are 0, null if only the former is."""
    prev, new = col(prev), col(new)
    return F.when(prev != 0, (new - prev) / F.nullif(F.abs(prev), F.lit(0.0)) * 100).when(new == prev, F.lit(0.0))


def regressed(prev: Column | str, new: Column | str, direction: Column | str) -> Column:
    """Higher-is-better below -5 %, lower-is-better above 20 % or up from 0."""
    prev, new, way = col(prev), col(new), col(direction)
    pct = delta_pct(prev, new)
    from_zero = (prev == 0) & (new > 0)
    return F.when(way == HIGHER, F.coalesce(pct < THROUGHPUT_DROP, F.lit(False))).when(
        way == LOWER, F.coalesce(pct > LATENCY_RISE, from_zero)
    ).otherwise(F.lit(False))


def improved(delta: Column | str, direction: Column | str) -> Column:
    """Better, or without direction."""
    d, way = col(delta), col(direction)
    return F.when(way == HIGHER, d > 0).when(way == LOWER, d < 0).otherwise(F.lit(True))


def goal_met(value: Column | str, goal: Column | str, direction: Column | str) -> Column:
    """F15."""
    v, g, way = col(value), col(goal), col(direction)
    return F.when(way == HIGHER, v >= g).when(way == LOWER, v <= g).otherwise(F.lit(True))


#: The multiple of the tolerance that each metric is allowed, and its better direction.
TOLERANCE = {
    "insert_per_second": (1.0, HIGHER),
    "range_per_second": (1.5, HIGHER),
    "insert_latency_p50": (4.0, LOWER),
    "range_latency_p50": (4.0, LOWER),
    "insert_latency_p99": (1.5, LOWER),
    "range_latency_p99": (4.0, LOWER),
    "rss_max_kb": (2.0, LOWER),
}


def regressed_beyond(metric: Column | str, prev: Column | str, new: Column | str, tolerance_pct: float, as_coded: bool = False) -> Column:
    """The change is worse than the metric's multiple of the tolerance.

    ``as_coded`` treats range throughput as lower-is-better, as some existing reports do.
    """
    pct, name, out = delta_pct(prev, new), col(metric), F.lit(False)
    for key, (times, way) in TOLERANCE.items():
        lower = way == LOWER or (as_coded and key == "range_per_second")
        worse = pct > tolerance_pct * times if lower else pct < -tolerance_pct * times
        grown = (col(prev) == 0) & (col(new) > 0) if lower else F.lit(False)
        out = F.when(name == key, F.coalesce(worse, grown)).otherwise(out)
    return out

"""Best-fit packing by a configuration linear program over the length histogram.

1. Encode; cut documents longer than the capacity; write the pieces with their rank among the pieces
   of the same length in their partition.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.
3. Covering program: minimise the number of sequences so that the configurations (multisets of
   lengths that fit one sequence) cover the histogram.  Multiplicative weights keep a price per
   length; the configuration of the largest price comes from an unbounded-knapsack dynamic program.
   To keep that program short the prices are per class of ``quantum`` lengths.
4. Rounding: whole copies of each configuration are filled with exact lengths, topped up best-fit
   with what still fits; what the rounding left over is packed best-fit decreasing.  Both work on
   whole runs of equal sequences, so the plan has a few rows per length and not one per piece.
5. Each piece finds its slot by (length, rank) in that plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import task_label, written


def price(values, sizes, capacity: int):
    """Unbounded knapsack: the multiset of classes of the largest total value; counts per class."""
    import numpy as np

    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_size = np.full(capacity + 1, -np.inf)
    by_size[sizes] = values
    for c in range(1, capacity + 1):
        gain = by_size[1 : c + 1] + best[c - 1 :: -1] if c > 1 else by_size[1:2] + best[:1]
        k = int(gain.argmax())
        best[c], choice[c] = (best[c - 1], -1) if best[c - 1] >= gain[k] else (gain[k], k + 1)
    counts: dict[int, int] = {}
    c = capacity
    while c > 0:
        s = int(choice[c])
        counts[s] = counts.get(s, 0) + 1 if s > 0 else 0
        c -= s if s > 0 else 1
    counts.pop(-1, None)
    return counts, best[capacity]


def configuration_program(demand: dict[int, int], capacity: int, epsilon: float = 0.1, rounds: int = 1500) -> list[tuple[dict[int, int], float]]:
    """Fractional covering by multiplicative weights: [(configuration, sequences)], in class units.

    ``demand``: items per class size.  Each round prices a configuration, buys as much of it as
    brings the most covered of its classes forward by an epsilon share, and lowers the prices of what
    it covers.  The purchases are scaled so that the least covered class is just covered, but to no
    more than twice the median class's need: what stays short then is left to the last step of rounding.
    """
    import numpy as np

    if not demand:
        return []
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    place = {int(s): i for i, s in enumerate(sizes)}
    covered, bought = np.zeros(len(sizes)), {}
    log_weight = np.log(need * sizes)  # prices start in proportion to the lengths: the dual of a perfect packing
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        counts, _ = price(weight / need, sizes, capacity)
        rows = np.array([place[s] for s in counts])
        times = np.array([counts[s] for s in counts], float)
        step = epsilon * float((need[rows] / times).min())
        covered[rows] += step * times / need[rows]
        log_weight[rows] -= step * times / need[rows]
        config = tuple(sorted(counts.items()))
        bought[config] = bought.get(config, 0.0) + step
    least = max(float(covered.min()), 1e-9)
    scale = 1 / max(least, float(np.median(covered)) / 2)
    return [(dict(c), x * scale) for c, x in bought.items()]


def plan_sequences(histogram: dict[int, int], capacity: int, quantum: int = 16) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(copies, [(length, count), ...])]: every piece of the histogram in exactly one sequence."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    if full := left.pop(capacity, 0):
        plan.append((full, [(capacity, 1)]))
    order = sorted(left)

    import bisect

    def largest_upto(n: int) -> int:
        at = bisect.bisect_right(order, n)
        return order[at - 1] if at else 0

    def take(lengths: dict[int, int], copies: int) -> None:
        plan.append((copies, sorted(lengths.items(), reverse=True)))
        for n, c in lengths.items():
            left[n] -= c * copies
            if not left[n]:
                del left[n]
                order.pop(bisect.bisect_left(order, n))

    def fill(lengths: dict[int, int], room: int) -> None:
        """Best fit: again and again the longest piece that still fits, of those not yet used up."""
        limit = room
        while room and (n := largest_upto(min(room, limit))):
            free = left[n] - lengths.get(n, 0)
            if k := min(room // n, free):
                lengths[n] = lengths.get(n, 0) + k
                room -= k * n
            limit = n - 1

    def copies_of(lengths: dict[int, int], most: int) -> int:
        return min(most, *(left[n] // c for n, c in lengths.items()))

    classes: dict[int, int] = {}
    for n, c in left.items():
        classes[-(-n // quantum)] = classes.get(-(-n // quantum), 0) + c
    program = configuration_program(classes, capacity // quantum)
    for config, amount in sorted(program, key=lambda x: -x[1]):
        whole = int(amount)
        while whole > 0:
            lengths: dict[int, int] = {}
            room = capacity
            for size, count in sorted(config.items(), reverse=True):
                for _ in range(count):
                    n = largest_upto(min(size * quantum, room))
                    while n > (size - 1) * quantum and left[n] <= lengths.get(n, 0):
                        n = largest_upto(n - 1)
                    if n <= (size - 1) * quantum:
                        break
                    lengths[n] = lengths.get(n, 0) + 1
                    room -= n
            if sum(lengths.values()) < sum(config.values()):
                break  # a class of this configuration is used up
            fill(lengths, room)
            copies = copies_of(lengths, whole)
            take(lengths, copies)
            whole -= copies
    while order:
        lengths = {order[-1]: 1}
        fill(lengths, capacity - order[-1])
        take(lengths, copies_of(lengths, 1 << 62))
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, list[int]]:
    """The plan by length and rank: pieces lo.. of a length go, ``count`` to a sequence, from ``first``."""
    rows: dict[str, list[int]] = {k: [] for k in ("length", "lo", "count", "first", "offset")}
    used: dict[int, int] = {}
    first = 0
    for copies, lengths in plan:
        offset = 0
        for n, c in lengths:
            for k, v in zip(rows, (n, used.get(n, 0), c, first, offset)):
                rows[k].append(v)
            used[n] = used.get(n, 0) + c * copies
            offset += n * c
        first += copies
    return rows


def pack_documents(df: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A null text is empty and packs as the end id alone; repeated rows pack each on their own; an empty
    table gives no rows.  Only documents longer than ``capacity`` are cut.
    """
    import pyarrow as pa

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder_for

        part, _ = task_label()
        encoder, end = encoder_for(vocabulary), end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            rows = {k: [] for k in names}
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode_batch(some.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        for name, v in zip(names, (doc_id, k, at // 4, n, zlib.crc32(piece), part, seen.get(n, 0))):
                            rows[name].append(v)
                        seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    i64, i32 = pa.int64(), pa.int32()
    schema = pa.schema([("doc_id", i64), ("piece", i32), ("start", i64), ("length", i64), ("ids_crc32", i64), ("part", i32), ("rank", i64)])
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(texts.mapInArrow(cut, fields), "pieces")

    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = df.sparkSession.sparkContext.broadcast(slots(plan_sequences(histogram, capacity)))  # some rows per length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        p = {k: np.asarray(v, np.int64) for k, v in plan.value.items()}
        order = np.lexsort((p["lo"], p["length"]))
        p = {k: v[order] for k, v in p.items()}
        starts = np.searchsorted(p["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            slot = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                a, b = starts[n], starts[n + 1]
                slot[here] = a + np.searchsorted(p["lo"][a:b], rank[here], side="right") - 1
            within = rank - p["lo"][slot]
            sequence = p["first"][slot] + within // p["count"][slot]
            offset = p["offset"][slot] + within % p["count"][slot] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # A row per length and partition grows with the corpus, so it is never sent out whole.
    ranked = pieces.join(bases.select("length", "part", "base").hint("shuffle_merge"), ["length", "part"])
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

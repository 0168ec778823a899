"""Around benchmark runs: workloads, a memory sampler and its report, metric dumps, comparing, baselines.

    python -m tidelog.tools compare BASELINE.json TARGET.json... [--goals goals.toml] [--out FILE] [--reg]
    python -m tidelog.tools baseline current|list|set|switch ...
    python -m tidelog.tools describe RUN
"""

from __future__ import annotations

import argparse
import json
import re
import shutil
import sys
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import run_tag
from .operators import compare, metrics
from .schema import MEMORY_SCHEMA
from .sources import runs

#: Share of ranges in a workload's operations; that of mixed is a parameter.
RANGE_SHARE = {"write": 0.0, "read": 1.0, "tail": 0.1, "bulk": 0.5}
RUN_FILES = ("benchmark_result.json", "meta.json", "mem_report.json", "reg.json")
POINTER = "__baseline.json"


# ---- workloads


def operations(
    spark: SparkSession, workload: str, n: int, sources: int, keys: int, value_bytes: int, seed: int, range_fraction: float = 0.5, window_ms: int = 60_000
) -> DataFrame:
    """(op_no, is_range, source_id, key, value, ts, start_ts, end_ts, contains): a workload's operations.

    Sources and keys are drawn evenly; an insert carries a value of ``value_bytes``; a range ends now
    and goes back a window, and one in ten asks for a substring.  Equal seeds give equal operations,
    whatever the partitions: draws are hashes of the seed and the operation's number.
    """
    share = range_fraction if workload == "mixed" else RANGE_SHARE[workload]
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pick = lambda k, m: F.floor(draw(k) * m).cast("long")
    rows = spark.range(n).withColumn("is_range", draw(0) < share)
    ranged = lambda c: F.when(F.col("is_range"), c)
    return rows.select(
        F.col("id").alias("op_no"), "is_range", pick(1, sources).alias("source_id"), F.concat(F.lit("key_"), pick(2, keys)).alias("key"),
        F.when(~F.col("is_range"), F.repeat(F.lit("a"), value_bytes)).alias("value"), F.col("id").alias("ts"),
        ranged(F.greatest(F.col("id") - window_ms, F.lit(0))).alias("start_ts"), ranged(F.col("id")).alias("end_ts"),
        ranged(F.when(draw(3) < 0.1, "a").otherwise("")).alias("contains"),
    )


def prefill(client, spark: SparkSession, n: int, sources: int, keys: int, value_bytes: int) -> int:
    """Inserts before a run that reads."""
    rows = operations(spark, "write", n, sources, keys, value_bytes, seed=67)
    return client.batch_insert([r.asDict() for r in rows.select("source_id", "ts", "key", "value").toLocalIterator()])


def run_workload(client, ops: DataFrame, batch: int = 256) -> dict:
    """Runs operations in order against a client; latencies are per batch of inserts and per range."""
    latency: dict[str, list[float]] = {"insert": [], "range": []}
    counts, failed, records, waiting = {"insert": 0, "range": 0}, {"insert": 0, "range": 0}, 0, []

    def timed(kind: str, n: int, call: Callable):
        start = time.perf_counter()
        try:
            out = call()
        except Exception:
            failed[kind] += n
            return None
        latency[kind].append((time.perf_counter() - start) * 1e6)
        counts[kind] += n
        return out

    def flush():
        if waiting:
            timed("insert", len(waiting), lambda: client.batch_insert(list(waiting)))
            waiting.clear()

    began = time.perf_counter()
    for op in ops.orderBy("op_no").toLocalIterator():
        if op["is_range"]:
            found = timed("range", 1, lambda op=op: sum(1 for _ in _records(client, op)))
            records += found or 0
        else:
            waiting.append({k: op[k] for k in ("source_id", "ts", "key", "value")})
            if len(waiting) >= batch:
                flush()
    flush()
    seconds = max(time.perf_counter() - began, 1e-9)
    return {"counts": counts, "failed": failed, "records": records, "seconds": seconds, "latency_us": latency} | {
        f"{k}_ops_per_sec": n / seconds for k, n in counts.items()
    }


def _records(client, op):
    found = client.range(op["source_id"], op["key"], op["start_ts"], op["end_ts"], op["contains"])
    return client.rows(found) if hasattr(client, "rows") else found


# ---- memory


def memory_now(pid: str | int = "self") -> dict[str, int]:
    """Kilobytes of a process: rss_kb, vms_kb, data_kb."""
    names = {"VmRSS": "rss_kb", "VmSize": "vms_kb", "VmData": "data_kb"}
    said = dict(line.split(":", 1) for line in Path(f"/proc/{pid}/status").read_text().splitlines() if ":" in line)
    return {to: int(said[k].split()[0]) for k, to in names.items() if k in said}


class MemorySampler:
    """Samples a process's memory at an interval, until stopped."""

    def __init__(self, pid: str | int = "self", every: float = 0.5):
        self._pid, self._every, self._samples, self._stop = pid, every, [], threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        began = time.monotonic()
        while True:
            try:
                self._samples.append({"elapsed_secs": time.monotonic() - began} | memory_now(self._pid))
            except OSError:
                return
            if self._stop.wait(self._every):
                return

    def stop(self) -> list[dict]:
        self._stop.set()
        self._thread.join()
        return self._samples

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stop(), MEMORY_SCHEMA)


def _size(kb: float) -> str:
    for unit, scale in (("GB", 1 << 20), ("MB", 1 << 10)):
        if kb >= scale:
            return f"{kb / scale:.1f}{unit}"
    return f"{kb:.0f}KB"


def memory_text(samples: DataFrame, bars: int = 40, engine: DataFrame | None = None) -> str:
    """A report: the summary, sampled engine states, and a bar per sampled moment (Z7); 20 rows of each at most, and the last."""
    summary = metrics.memory_report(samples.withColumn("source_id", F.lit(0))).first()
    if summary is None or not summary["n"]:
        return "no memory samples\n"
    thin = metrics.downsample(samples.withColumn("source_id", F.lit(0)), "elapsed_secs", ["source_id"]).orderBy("elapsed_secs").collect()
    out = [
        "memory", f"  min {_size(summary['rss_min'])}  avg {_size(summary['rss_avg'])}  max {_size(summary['rss_max'])}  end {_size(summary['rss_last'])}",
        f"  {summary['n']} samples, growth {summary['growth'] or 0:.1f} KB/s",
    ]
    if engine is not None:
        both = metrics.downsample(engine.withColumn("source_id", F.lit(0)), "elapsed_secs", ["source_id"]).orderBy("elapsed_secs").collect()
        out += ["engine", *(f"  {r['elapsed_secs']:8.1f}s  {r['memory_bytes'] // 1024:>10} KB  {r['files']:>6} files" for r in both)]
    most = max(r["rss_kb"] for r in thin) or 1
    out += [f"  {r['elapsed_secs']:8.1f}s {_size(r['rss_kb']):>9} {'#' * max(1, round(bars * r['rss_kb'] / most))}" for r in thin]
    return "\n".join(out) + "\n"


# ---- metrics


def metrics_text(snapshot: str | dict, depth: int = 0) -> str:
    """A metrics snapshot as indented lines, sections after plain values."""
    said = json.loads(snapshot) if isinstance(snapshot, str) else snapshot
    plain = [f"{'  ' * depth}{k:<24} {v}" for k, v in said.items() if not isinstance(v, dict)]
    return "\n".join(plain + [f"{'  ' * depth}{k}\n{metrics_text(v, depth + 1)}" for k, v in said.items() if isinstance(v, dict)])


# ---- compare


def compare_files(spark: SparkSession, baseline: str, targets: list[str]) -> DataFrame:
    """The runs of result files against a baseline's, by target."""
    last = lambda path: compare.latest_runs(runs.read_results(spark, path))
    return compare.compare_many(last(baseline), [last(t) for t in targets])


def tag_of(spark: SparkSession, path: str) -> str:
    return spark.createDataFrame([(path, None)], "path string, given string").select(run_tag("given", "path").alias("t")).first()["t"]


def compare_command(spark: SparkSession, baseline: str, targets: list[str], goals: str | None, out: str | None, out_dir: str, core: bool, stop: bool, say=print) -> int:
    """Writes the comparison as JSON, prints it as a table; 1 if asked to stop at a regression and there is one."""
    found = compare_files(spark, baseline, targets).persist()
    place = Path(out or f"{out_dir}/{tag_of(spark, targets[0])}__vs__{tag_of(spark, baseline)}.json")
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps([json.loads(x) for x in found.toJSON().collect()], indent=1))  # some rows a run
    wanted = runs.goals(spark, Path(goals).read_text() if goals and Path(goals).exists() else None)
    shown = compare.with_goals(compare.shown(found, condensed=core), wanted)
    for r in shown.orderBy("target_idx", compare.workload_rank(), "concurrency", "field").collect():
        change = "" if r["delta_pct"] is None else f"{r['delta_pct']:+.1f}%"
        goal = "" if r["goal"] is None else f"  goal {r['goal']:g}: {'met' if r['met'] else 'missed'}"
        say(f"{r['target_idx']} {r['workload']:<6} {r['concurrency']:>3}  {r['field']:<22} {r['prev']:>14.3f} {r['new']:>14.3f} {change:>9}{'  REGRESSED' if r['regressed'] else ''}{goal}")
    return int(stop and compare.has_regression(found))


# ---- baselines


def _baselines(folder: Path) -> list[tuple[str, str]]:
    """(id, folder name), in the order of their numbers."""
    found = [(p.name.partition("__")[0], p.name) for p in folder.iterdir() if p.is_dir()] if folder.exists() else []
    return sorted(found, key=lambda x: (not x[0].isdigit(), int(x[0]) if x[0].isdigit() else 0, x[1]))


def baseline_current(folder: str, source: str, tag: str = "baseline") -> str:
    """Copies a run's files under the next number, and points to it."""
    home, result = Path(folder), Path(source)
    result = result / RUN_FILES[0] if result.is_dir() else result
    if not result.exists():
        raise FileNotFoundError(f"no result file: {result}")
    number = max((int(i) for i, _ in _baselines(home) if i.isdigit()), default=0) + 1
    name = f"{number:02d}__{tag}"
    (home / name).mkdir(parents=True)
    for f in RUN_FILES:
        if (result.parent / f).exists():
            shutil.copy(result.parent / f, home / name / f)
    baseline_switch(folder, name)
    return name


def baseline_pointer(folder: str) -> str | None:
    place = Path(folder) / POINTER
    return json.loads(place.read_text())["baseline"].rpartition("/")[2] if place.exists() else None


def baseline_list(folder: str) -> list[tuple[str, str, bool]]:
    """(id, folder name, whether it is the one pointed to)."""
    now = baseline_pointer(folder)
    return [(i, n, n == now) for i, n in _baselines(Path(folder))]


def baseline_switch(folder: str, which: str) -> str:
    """Points to a baseline by its folder's name, its number or its tag."""
    for i, n in _baselines(Path(folder)):
        if which in (n, i, n.partition("__")[2]) or (which.isdigit() and i.isdigit() and int(which) == int(i)):
            (Path(folder) / POINTER).write_text(json.dumps({"baseline": f"{folder}/{n}"}))
            return n
    raise LookupError(f"no baseline {which!r}")


def baseline_set(folder: str, source: str, which: str) -> str:
    """Replaces the files of a baseline by those of a run."""
    before = baseline_pointer(folder)
    name = baseline_switch(folder, which)
    run = Path(source) if Path(source).is_dir() else Path(source).parent
    for f in RUN_FILES:
        if (run / f).exists():
            shutil.copy(run / f, Path(folder) / name / f)
    if before:
        baseline_switch(folder, before)
    return name


def describe(run: str) -> str:
    """What a run's folder says about itself."""
    place = Path(run)
    meta = json.loads((place / "meta.json").read_text()) if (place / "meta.json").exists() else {}
    m = re.match(r"(.+?)(?:__(.+))?$", place.name)
    said = {"run": m[1], "tag": m[2] or ""} | meta | {"files": ", ".join(sorted(p.name for p in place.iterdir()))}
    return metrics_text(said)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog.tools")
    commands = parser.add_subparsers(dest="command", required=True)
    cmp = commands.add_parser("compare")
    cmp.add_argument("baseline")
    cmp.add_argument("targets", nargs="+")
    cmp.add_argument("--goals")
    cmp.add_argument("--out")
    cmp.add_argument("--out-dir", default="bench/cmp")
    cmp.add_argument("--core", action="store_true")
    cmp.add_argument("--reg", action="store_true", help="exit 1 at a regression")
    base = commands.add_parser("baseline")
    base.add_argument("action", choices=("current", "list", "set", "switch"))
    base.add_argument("names", nargs="*")
    base.add_argument("--folder", default="bench/baselines")
    commands.add_parser("describe").add_argument("run")
    said = parser.parse_args(args)
    if said.command == "compare":
        from .session import session

        return compare_command(session(), said.baseline, said.targets, said.goals, said.out, said.out_dir, said.core, said.reg)
    if said.command == "describe":
        print(describe(said.run))
    elif said.action == "list":
        for i, n, now in baseline_list(said.folder):
            print(f"{'*' if now else ' '} {i:>3} {n}")
    else:
        print({"current": baseline_current, "set": baseline_set, "switch": baseline_switch}[said.action](said.folder, *said.names))
    return 0


if __name__ == "__main__":
    sys.exit(main())

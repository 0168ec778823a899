"""Connected components by alternating large-star and small-star steps, and the pairs of sets that can be
similar, by prefix filtering (DataFrame operations only).

Both steps keep the components and move edges towards their smallest member, so the edges end as one
star per component.  Each step is an aggregation to one minimum per node and a join on it.  Both sides
of that join are dealt by the node and nothing else is done in its stage, so Spark splits the edges of a
node of many neighbours (adaptive skew join): only the minimum is needed with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _with_least(arcs: DataFrame) -> DataFrame:
    """(u, v, m): each arc with the least node among u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(written(least, "least"), "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable; nodes without edges are not in the result.

    Null ends and self-edges are ignored; repeated edges change nothing.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    arcs = written(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "arcs")
    before = None
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v")
        small = _with_least(large)
        small = small.select(F.col("v").alias("x"), "m").unionByName(small.select(F.col("u").alias("x"), "m"))
        arcs = written(small.where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "arcs")
        now = tuple(arcs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        arcs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def prefix_pairs(each: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of sets of different components that can have Jaccard >= percent.

    ``each``: (c, component, n, s), a row per element ``s`` of the set ``c`` of ``n`` elements.  With the
    elements in one order, the rarest first, two sets that similar share one of the first
    n - ceil(percent * n / 100) + 1 of each: no such pair is left out.
    """
    seen = each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    found = each.join(seen, "s").groupBy("c", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("all"))
    # Elements of no other set come first in the order and take their places in the prefix.
    left = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - (F.col("n") - F.size("all"))
    heads = found.where(left > 0).select("c", "component", F.explode(F.slice("all", 1, left.cast("int"))).alias("e"))
    heads = written(heads.select("c", "component", F.col("e.s").alias("s")), "prefixes")
    open_at = heads.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("s")
    heads = heads.join(open_at, "s")
    x, y = (heads.select("s", F.col("c").alias(name), F.col("component").alias(f"c{name}")) for name in ("a", "b"))
    return x.join(y, "s").where("a < b and ca != cb").select("a", "b").distinct()

"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations make all coordinates of a signature.  The first, a 64-bit hash, scatters the
shingles over a ring of RING places; the second is one fixed permutation of the ring, and coordinate
k is the least of its values at the shingles' places, the ring turned by k.  A shingle's values for
all coordinates are thus one stretch of the permutation, read at once.

Documents with the same set of shingles are one class.  Classes that agree in a band of coordinates
share a bucket.  Two bits of SKETCHED coordinates make a sketch; a pair that shares a bucket is verified,
on the full sets, if its sketches differ in at most APART coordinates and its sizes allow the similarity
(two sets of Jaccard 0.8 differ in 19 of 128 on average, and in more than 35 once in 20,000 pairs).

1. Every member of a bucket is compared with the bucket's first member.
2. In buckets that links have not joined whole, every member is compared with another one, of a component
   other than its own, and so on with others while that joins a twentieth of the components left.
3. Then all pairs of a bucket that are still not joined are compared: in buckets of at most SMALL members
   by their sketches, in larger ones unless prefix filtering on the full sets excludes them.  Members of
   these buckets get a longer sketch, of a bit of FINE coordinates; a pair is made in the first only of the
   buckets that it shares, and verified if its long sketches allow the similarity, by five standard deviations.

So a large group of copies is joined early, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, prefix_pairs
from .line_dedup import row_key
from .shared import discard, remembered, written

RING, COORDINATES, BAND = 1 << 20, 160, 5
SMALL = 4096
SKETCHED, APART = 128, 35
FINE = 4096
_SKETCH = ("s0", "s1", "s2", "s3")


class Shingler:
    """Words to 64-bit shingle hashes; remembers the hashes of a bounded number of words."""

    def __init__(self, size: int, remember: int = 400_000):
        self.size, self.remember, self._of = size, remember, {}

    def __call__(self, text: bytes | None):
        """The sorted distinct shingles of a text; fewer words than ``size`` make one, none make none."""
        import numpy as np
        import xxhash

        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self._of
        if len(known) > self.remember:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(found):
                if h is None:
                    found[i] = known[words[i]] = digest(words[i])
        h = np.array(found, np.uint64)
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, len(h) if len(h) < self.size else self.size, np.uint64)
        for k in range(min(self.size, len(h))):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def shingler_for(size: int) -> Shingler:
    """The worker process's own: words that one task hashed serve the next."""
    return remembered(("shingler", size), lambda: Shingler(size))


@lru_cache(maxsize=2)
def circulant(coordinates: int = COORDINATES) -> Circulant:
    return Circulant(coordinates)


def mixed(x):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Circulant:
    """Signatures of shingle sets."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 11):
        import numpy as np

        ring = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
        # Row p has the values at p, p + 1, ...: one stretch for all turns of the ring.
        self._turns = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:coordinates]]), coordinates)
        self._block = max(64, (2048 * COORDINATES) // coordinates)

    def signature(self, shingles):
        import numpy as np

        block = self._block
        place = (shingles & np.uint64(RING - 1)).astype(np.int64)
        out = self._turns[place[:block]].min(0)
        for start in range(block, len(place), block):
            np.minimum(out, self._turns[place[start : start + block]].min(0), out=out)
        return out

    def sketch(self, signature):
        """Two bits of each of the first SKETCHED coordinates, in four 64-bit integers."""
        import numpy as np

        two = (signature[:SKETCHED] & 3).astype(np.uint64).reshape(len(_SKETCH), -1)
        return (two << np.arange(0, 64, 2, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)

    def long_sketch(self, signature):
        """A bit of each coordinate, in 64-bit integers."""
        import numpy as np

        return np.packbits((signature & 1).astype(np.uint8), bitorder="little").view(np.int64)

    def bands(self, signature):
        """A 64-bit key per band, its number mixed in."""
        import numpy as np

        rows = signature.reshape(-1, BAND).astype(np.uint64)
        key = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for k in range(BAND):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key.view(np.int64)


def sign(documents: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, row, n_shingles, k1, k2, bands, sketch): the class of a document is its set's two keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler, turn = shingler_for(shingle_words), circulant()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                sizes, keys, bands, sketches = [], [], [], []
                for text in some.column(1).cast(pa.binary()).to_pylist():
                    s = shingler(text)
                    sizes.append(len(s))
                    keys.append(set_key(s))
                    signature = turn.signature(s) if len(s) else None
                    bands.append(turn.bands(signature) if len(s) else np.zeros(0, np.int64))
                    sketches.append(turn.sketch(signature) if len(s) else np.zeros(len(_SKETCH), np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
                columns = [some.column(0), some.column(2), pa.array(sizes, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), listed]
                columns += [pa.array(c) for c in np.array(sketches, np.int64).reshape(-1, len(_SKETCH)).T]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "k1", "k2", "bands", *_SKETCH])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    return texts.mapInArrow(run, "doc_id long, row long, n_shingles long, k1 long, k2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def set_key(shingles) -> tuple[int, int]:
    """Two 64-bit keys of a sorted set of shingles."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def needed_sets(documents: DataFrame, classes: DataFrame, needed: DataFrame, shingle_words: int) -> DataFrame:
    """(c, shingles): the full sets of the needed classes, from the texts of their first documents.

    The texts are read again.  A bit field keeps most of those not needed out of the shuffle; its size
    follows the number of needed classes up to ``2**25`` bits (4 MB), and it only ever lets too much pass.
    """
    import pyarrow as pa

    n = needed.count()
    needed = needed.join(classes.select("c", "d", "k1", "k2"), "c")
    bits = min(1 << 25, max(1 << 16, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("d"), F.lit(bits))
    words = (
        needed.select((place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .collect()  # bits / 32 rows at most
    )
    import numpy as np

    field = np.zeros(bits // 32, np.uint32)
    if words:
        field[[r["w"] for r in words]] = [r["b"] for r in words]
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler = shingler_for(shingle_words)
        for batch in batches:
            at = batch.column("at").to_numpy()
            hits = np.flatnonzero(shared.value[at // 32] >> (at % 32).astype(np.uint32) & 1)
            for start in range(0, len(hits), 500):
                some = batch.take(pa.array(hits[start : start + 500]))
                sets = [shingler(t) for t in some.column("text").cast(pa.binary()).to_pylist()]
                keys = [set_key(s) for s in sets]
                columns = [some.column("doc_id"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d", "k1", "k2", "shingles"])

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    sets = texts.mapInArrow(run, "d long, k1 long, k2 long, shingles binary")
    return sets.join(needed, ["d", "k1", "k2"]).groupBy("c").agg(F.first("shingles").alias("shingles"))


def elements(sets: DataFrame) -> DataFrame:
    """(c, component, n, s): a row per shingle of the sets (c, component, shingles)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i, packed in enumerate(batch.column("shingles")):
                s = np.frombuffer(packed.as_buffer(), np.int64)
                columns = [pa.array(np.full(len(s), batch.column(k)[i].as_py(), np.int64)) for k in ("c", "component")]
                columns += [pa.array(np.full(len(s), len(s), np.int32)), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, ["c", "component", "n", "s"])

    return sets.select("c", "component", "shingles").mapInArrow(run, "c long, component long, n int, s long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    whole = pairs.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    whole = whole.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    return whole.mapInArrow(run, "a long, b long")


def long_sketches(sets: DataFrame) -> DataFrame:
    """(c, fine): the long sketches of the sets (c, shingles), in FINE / 64 integers each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        turn = circulant(FINE)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                found = [turn.long_sketch(turn.signature(np.frombuffer(x.as_buffer(), np.uint64))) for x in some.column("shingles")]
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * (FINE // 64))
                yield pa.RecordBatch.from_arrays([some.column("c"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["c", "fine"])

    return sets.select("c", "shingles").mapInArrow(run, "c long, fine array<long>")


def finely_near(a: str, b: str, percent: int):
    """Whether the long sketches in two columns differ in no more bits than five deviations above the mean at ``percent``."""
    p = (100 - percent) / 200
    most = int(FINE * p + 5 * (FINE * p * (1 - p)) ** 0.5)
    # In higher-order functions: as one expression it would be too long a method to be compiled.
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y) <= most


def near(a: str, b: str):
    """Whether two sketches, the columns with these prefixes, differ in at most APART coordinates."""
    apart = F.lit(0)
    for name in _SKETCH:
        x = F.col(a + name).bitwiseXOR(F.col(b + name))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return apart <= APART


def unjoined_pairs(members: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pairs of different components in a bucket whose sizes and sketches allow the similarity.

    ``members``: (key, c, n, component, sketch); ``fine``: (c, fine).  Each pair is made once, in the first bucket it shares.
    """
    own = members.groupBy("c").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a class has a key per band at most
    x = written(members.join(own.join(fine, "c"), "c"), "few")
    y = x.select(*(F.col(c).alias(f"b{c}") for c in x.columns))
    alike = F.lit(100) * F.least("n", "bn") >= F.lit(percent) * F.greatest("n", "bn")
    first = F.get(F.array_intersect("keys", "bkeys"), F.lit(0)) == F.col("key")
    pairs = x.join(y, (F.col("key") == F.col("bkey")) & (F.col("c") < F.col("bc")) & (F.col("component") != F.col("bcomponent")) & alike & near("", "b") & first & finely_near("fine", "bfine", percent))
    return pairs.select(F.col("c").alias("a"), F.col("bc").alias("b"))


def near_dedup(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept), a row per row of ``documents``.

    Words are cut at ASCII white space, A-Z lower-cased.  ``component_id`` is the smallest doc_id that
    links reach.  A text without words, or null, is linked with nothing; a null doc_id comes back with a
    null component, and joins nothing.  Rows of one doc_id are told apart by ``row``, a key of doc_id and
    text; each has its own component, and is kept if that is its doc_id.
    """
    signed = written(sign(documents, shingle_words), "signed")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    sketch = [F.first(name).alias(name) for name in _SKETCH]
    classes = own.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("d"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), *sketch
    )
    # A class is named by its set's first key, since rows of one doc_id may be of several classes.
    classes = written(classes.withColumn("c", F.col("k1")), "classes")
    rows = classes.select("c", F.explode("bands").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("first")).where("size > 1"), "buckets")
    sizes = classes.select("c", "n", *_SKETCH)
    bare = written(rows.join(buckets, "key"), "members")
    members = written(bare.join(sizes, "c"), "members")
    discard(bare, buckets)
    close = (F.lit(100) * F.least("n", "bn") >= F.lit(percent) * F.greatest("n", "bn")) & near("", "b")
    other = lambda df, *more: df.select(*more, F.col("n").alias("bn"), *(F.col(x).alias(f"b{x}") for x in _SKETCH))

    def fetched(needed: DataFrame) -> DataFrame:
        """(c, shingles) of the classes ``needed`` (c)."""
        return written(needed_sets(documents, classes, written(needed.distinct(), "needed"), shingle_words), "sets")

    def links(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Verified links of pairs (a, b)."""
        sets = sets or fetched(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))))
        return written(verified(pairs, sets, percent), "links")

    stars = members.where("c != first").dropDuplicates(["c", "first"]).join(other(sizes, F.col("c").alias("first")), "first").where(close)
    tried = written(stars.select(F.col("first").alias("a"), F.col("c").alias("b")), "tried")
    edges = links(tried)

    def still_open() -> DataFrame:
        """The members of buckets with more than one component, each with its own."""
        joined = written(connected_components(edges), "components").withColumnRenamed("node", "c")
        placed = members.join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        return written(placed.join(open_keys, "key"), "open")

    def compare(pairs: DataFrame, sets: DataFrame | None = None) -> int:
        """Verifies the pairs (a, b) that have not been; returns the number of new links."""
        nonlocal tried, edges
        pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "tries")
        fresh = links(pairs, sets)
        tried, edges = tried.unionByName(pairs), edges.unionByName(fresh)
        return fresh.count()

    turn = 0
    while True:
        placed = still_open()
        lead = placed.groupBy("key").agg(F.min_by(F.struct("c", "n", "component", *_SKETCH), F.xxhash64(F.lit(turn), "c")).alias("lead"))
        lead = written(lead.select("key", "lead.*"), "leads")
        lead = other(lead, "key", F.col("c").alias("bc"), F.col("component").alias("bcomponent"))
        tries = placed.join(lead, "key").where((F.col("component") != F.col("bcomponent")) & close)
        n = compare(tries.select(F.least("c", "bc").alias("a"), F.greatest("c", "bc").alias("b")))
        if n * 20 < placed.select("component").distinct().count() or not n:
            break
        turn += 1
    placed = still_open()
    sets = fetched(placed.select("c"))
    few = placed.where(F.col("size") <= SMALL).select("key", "c", "n", "component", *_SKETCH)
    pairs = unjoined_pairs(few, written(long_sketches(sets), "long-sketches"), percent)
    rest = written(placed.where(F.col("size") > SMALL).select("c", "component").distinct(), "rest")
    if not rest.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(written(elements(sets.join(rest, "c")), "elements"), percent))
    compare(pairs, sets)
    joined = written(connected_components(edges), "components").withColumnRenamed("node", "c")
    # Only classes that say something new about a document come back to the documents.
    linked = written(classes.select("k1", "k2", "c", "d", "copies").join(joined, "c", "left"), "linked")
    least = written(linked.where("component is not null").groupBy("component").agg(F.min("d").alias("least")), "least")
    told = linked.where("copies > 1 or component is not null").join(least, "component", "left")
    told = written(told.select("k1", "k2", F.coalesce("least", "d").alias("component")), "told")
    out = signed.select("doc_id", "row", "n_shingles", "k1", "k2").join(told, ["k1", "k2"], "left")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.coalesce(F.when(has_set, F.col("component")), "doc_id")
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

"""Near-duplicate lines across documents (DataFrame operations only).

A line's similarity to another is the Jaccard index of their sets of character 5-grams.  Candidates
come from MinHash over the same 5-grams, so a pair's chance depends on its similarity, however short
the lines are and whatever their script.  All grams of a line are used.  A signature has 80 coordinates: in
lines of up to SHORT grams each is the least hash of all grams after a multiplication by an odd constant of
its own, of which 24 bits are kept; in longer ones the grams are first dealt by their hash into BINS bins, and
each of ten constants gives the least of every bin, which takes an eighth of the work.  A line of nearly SHORT
grams is signed in both ways, so that any two similar lines without repeated grams have one way in common.  A
band of ROWS coordinates, of different bins, is a bucket key.

Three bits of every coordinate make a sketch.  A pair that shares a bucket is a candidate if its sketches
differ in at most APART coordinates; similar lines nearly always do (14 of 80 on average at 0.8), unrelated
ones hardly ever.

Exact copies of a line are one class throughout.  Every class of a bucket is compared with the bucket's
leader, then with three more, and so on while that joins many; so large groups are joined early.  A leader
leaves its bucket when it has been compared.  After the first round a member leaves a bucket in which no line of
another component has a sketch close to its own.  At the end all pairs of a bucket that are not joined yet are
compared: in buckets of at most SMALL classes by their sketches and by the parities of their full 5-gram
sets, which never exclude a similar pair, in larger ones unless prefix filtering on the 5-grams excludes
them.  The comparison is exact, on the full 5-gram sets.  Links become components, and of a
component the first line, by (doc_id, position), stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, prefix_pairs
from .shared import discard, plain_arithmetic, scratch, written

GRAM, COORDINATES, ROWS = 5, 80, 4
BANDS = COORDINATES // ROWS
BINS, SHORT = 8, 96
APART = 29
_SKETCH, _PART = ("s1", "s2", "s3", "s4"), 20
_LOW, _KEPT = (1 << 31) - 1, (1 << 24) - 1
_FACTORS = [random.Random(1000 + k).getrandbits(31) | 1 for k in range(COORDINATES)]
_THREES = int("001" * _PART, 2)
#: The bands are looked at so many at a time, which bounds what is shuffled at once.
BANDS_AT_ONCE = 5
#: Up to so many rows a side of known size goes to every task; beyond, the join is by shuffle.
SMALL_SIDE = 1_000_000
#: Buckets of up to so many classes are compared pair by pair, by their sketches first.
SMALL = 4096
#: A line has so many parity bits when all pairs of its buckets are made.
_WORDS = 16
PARITY = 64 * _WORDS
#: So many members of buckets meet at a time when all pairs are made.
MEMBERS_AT_ONCE = 1_000_000
#: So many pairs at least are fetched with their texts at a time.
SLICE = 400_000


def row_key() -> Column:
    """A key of a row's doc_id and text, by which rows that share a doc_id are told apart."""
    return F.xxhash64("doc_id", "text")


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, k1, k2) of every line that is not blank; two 64-bit keys stand for the line."""
    lines = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.trim("line") != "")
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(7), "line"))


def signed_lines(texts: DataFrame) -> DataFrame:
    """(k1, way, keys, s1, s2, s3, s4): a row per row of the distinct lines ``texts`` and way of signing.

    ``way`` is 0 for short lines, 1 for others; ``keys`` has a 32-bit bucket key per band, the rest is the sketch.
    """
    with plain_arithmetic(texts.sparkSession):  # else every product is checked for an overflow, which is what is wanted here
        return _signed_lines(texts)


def _signed_lines(texts: DataFrame) -> DataFrame:
    # Two bytes a character: a gram is a slice at a known place.  Dealt before the grams are made, a line stays in one task.
    wide = texts.select("k1", "line").repartition("k1").select("k1", F.encode("line", "UTF-16LE").alias("wide"))
    wide = wide.withColumn("n", F.greatest(F.expr("octet_length(wide) div 2").cast("int") - (GRAM - 1), F.lit(1)))

    def hashes(some: DataFrame) -> DataFrame:
        each = some.select("k1", "wide", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        return each.select("k1", F.hash(F.substring("wide", F.col("i") * 2 + 1, F.lit(2 * GRAM))).bitwiseAND(F.lit(_LOW)).alias("h"))

    def least(some: DataFrame, by: list[str], factors: list[int]) -> DataFrame:
        # The kept bits are among the low 32 of the product; they are moved once a line, not once a gram.
        found = some.groupBy(*by).agg(*(F.min((F.col("h") * F.lit(f)).bitwiseAND(F.lit(_KEPT << 7))).alias(f"m{k}") for k, f in enumerate(factors)))
        return found.select(*by, *(F.shiftright(f"m{k}", 7).cast("long").alias(f"m{k}") for k in range(len(factors))))

    def three(k: int, at: int) -> Column:
        return F.shiftleft(F.shiftright(f"m{k}", 9).bitwiseAND(F.lit(7)), 3 * at)

    short = least(hashes(wide.where(F.col("n") <= SHORT)), ["k1"], _FACTORS)
    keys = [F.hash(F.lit(b), *(f"m{k}" for k in range(b * ROWS, (b + 1) * ROWS))) for b in range(BANDS)]
    sketch = [sum((three(i * _PART + k, k) for k in range(_PART)), F.lit(0).cast("long")).alias(name) for i, name in enumerate(_SKETCH)]
    short = short.select("k1", F.lit(0).alias("way"), F.array(*keys).alias("keys"), *sketch)

    ten, half = COORDINATES // BINS, BINS // 2
    binned = hashes(wide.where(F.col("n") * 5 > SHORT * 4)).withColumn("bin", F.shiftright("h", 3).bitwiseAND(F.lit(BINS - 1)))
    binned = least(binned, ["k1", "bin"], _FACTORS[:ten])
    binned = binned.select(
        "k1", "bin", *(F.hash(F.lit(k), "bin", f"m{k}").alias(f"h{k}") for k in range(ten)), sum((three(k, k) for k in range(ten)), F.lit(0).cast("long")).alias("s")
    )
    # A band is a constant's coordinates of one half of the bins; a bin without grams adds nothing.
    keys = [F.bit_xor(F.when(F.floor(F.col("bin") / half) == side, F.col(f"h{k}")).otherwise(0)) for side in (0, 1) for k in range(ten)]
    two = _PART // ten
    sketch = [
        F.bit_or(F.when(F.floor(F.col("bin") / two) == i, F.when(F.col("bin") % two == 0, F.col("s")).otherwise(F.shiftleft("s", 3 * ten))).otherwise(F.lit(0).cast("long"))).alias(name)
        for i, name in enumerate(_SKETCH)
    ]
    long = binned.groupBy("k1").agg(*(x.alias(f"key{i}") for i, x in enumerate(keys)), *sketch)
    return short.unionByName(long.select("k1", F.lit(1).alias("way"), F.array(*(f"key{i}" for i in range(BANDS))).alias("keys"), *_SKETCH))


def grams(line: Column) -> Column:
    """Hashes of the distinct 5-grams; a shorter line is its own gram."""
    # Four bytes a character, so that a gram is a slice; the outer array has them made once a line.
    all_of = lambda wide: F.transform(F.sequence(F.lit(0), F.length(line) - GRAM), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * GRAM))))
    listed = F.transform(F.array(F.encode(line, "UTF-32")), all_of)[0]
    return F.when(F.length(line) < GRAM, F.array(F.xxhash64(line))).otherwise(F.array_distinct(listed))


def narrow_to(big: DataFrame, small: DataFrame, on: list[str], n: int) -> DataFrame:
    """Rows of ``big`` joined with ``small``, which has ``n`` rows, sent out whole only if that is little."""
    return big.join(F.broadcast(small) if n <= SMALL_SIDE else small, on)


def close(a: list[str], b: list[str]) -> Column:
    """Whether two sketches, each in the columns named, differ in at most APART coordinates."""

    def apart(p: str, q: str) -> Column:
        x = F.col(p).bitwiseXOR(F.col(q))
        return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(_THREES)))

    return sum((apart(p, q) for p, q in zip(a, b)), F.lit(0)) <= APART


def similar(pairs: DataFrame, texts: DataFrame, percent: int, at_once: int = SLICE) -> DataFrame:
    """The pairs (a, b, ...) of lines whose 5-gram sets have 100 * intersection >= percent * union.

    All pairs are compared, ``at_once`` or so at a time: so many meet their texts in one shuffle.
    """
    nodes = written(pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1"))).distinct(), "line-nodes")
    own = written(narrow_to(texts.select("k1", "line"), nodes, ["k1"], nodes.count()).dropDuplicates(["k1"]), "line-texts")
    slices, links = max(1, -(-pairs.count() // at_once)), None
    for i in range(slices):
        some = pairs.where(F.pmod(F.xxhash64(F.lit(5), "a", "b"), F.lit(slices)) == i) if slices > 1 else pairs
        both = some.join(own.select(F.col("k1").alias("a"), F.col("line").alias("la")), "a")
        both = both.join(own.select(F.col("k1").alias("b"), F.col("line").alias("lb")), "b")
        both = both.select(*pairs.columns, grams(F.col("la")).alias("ga"), grams(F.col("lb")).alias("gb"))
        both = both.select(*pairs.columns, F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("ab"))
        found = written(both.where(F.lit(100) * F.col("ab") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("ab"))).select(*pairs.columns), "line-links")
        links = found if links is None else links.unionByName(found)
    discard(nodes, own)
    return links


def parities(texts: DataFrame) -> DataFrame:
    """(k1, n, p): the number of 5-grams of each line, and which of PARITY bits, 64 in an integer, an odd number of them fall on."""
    each = texts.select("k1", F.explode(grams(F.col("line"))).alias("h"))
    bit, at = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")), F.shiftright("h", 6).bitwiseAND(F.lit(_WORDS - 1))
    words = each.groupBy("k1", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bit).alias("p"))
    whole = (F.bit_xor(F.when(F.col("at") == i, F.col("p")).otherwise(F.lit(0).cast("long"))) for i in range(_WORDS))
    return words.groupBy("k1").agg(F.sum("n").alias("n"), F.array(*whole).alias("p"))


def can_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether the parities of two lines, in columns with these endings, allow the similarity.

    Bits that differ are at most as many as the grams of one line only, and those of a similar pair are at
    most (100 - percent) / (100 + percent) of the two sizes: no similar pair is left out.
    """
    # In higher-order functions: as one expression it would be too long a method to be compiled.
    apart = F.aggregate(F.zip_with(f"p{a}", f"p{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col(f"n{a}") + F.col(f"n{b}"))


def unjoined_pairs(members: DataFrame, percent: int | None = None) -> DataFrame:
    """(a, b, ca, cb), a < b: the pairs of different components in a bucket whose sketches are close.

    ``members``: (key, k1, component, sketch).  Each pair is made once, in the first bucket it shares.  With
    ``percent`` they have parities too, and only pairs whose parities allow that similarity are made.
    """
    members = members.withColumn("way", F.shiftright("key", 5).bitwiseAND(F.lit(1)))  # each way has sketches, and a first bucket, of its own
    own = members.groupBy("k1", "way").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a key per band at most
    members = written(members.join(own, ["k1", "way"]), "line-few")
    more = (*_SKETCH, "n", "p") if percent else _SKETCH
    x, y = (members.select("key", "keys", F.col("k1").alias(n), F.col("component").alias(f"c{n}"), *(F.col(s).alias(f"{s}{n}") for s in more)) for n in ("a", "b"))
    y = y.withColumnRenamed("key", "other").withColumnRenamed("keys", "others")
    alike = close([f"{s}a" for s in _SKETCH], [f"{s}b" for s in _SKETCH])
    if percent:
        alike = alike & can_be_similar("a", "b", percent)
    first = F.get(F.array_intersect("keys", "others"), F.lit(0)) == F.col("key")
    pairs = x.join(y, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike & first).select("a", "b", "ca", "cb")
    pairs.made_of = members
    return pairs


def open_buckets(members: DataFrame) -> DataFrame:
    """The members (key, component, ...) of buckets of more than one component."""
    ends = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return members.join(written(ends, "line-open"), "key")


def with_partners(members: DataFrame) -> DataFrame:
    """The members (key, size, component, sketch) of buckets that have a close sketch of another component beside them.

    No others can be in a pair, now or when more components are joined.  Those of large open buckets all stay.
    """
    few = members.where(F.col("size") <= SMALL)
    y = few.select(F.col("key").alias("other"), F.col("component").alias("cb"), *(F.col(s).alias(f"{s}b") for s in _SKETCH))
    met = few.join(y, (F.col("key") == F.col("other")) & (F.col("component") != F.col("cb")) & close(_SKETCH, [f"{s}b" for s in _SKETCH]), "left_semi")
    return met.unionByName(open_buckets(members.where(F.col("size") > SMALL)).select(members.columns))


def many_pairs(members: DataFrame) -> bool:
    """Whether the buckets of ``members`` have more than SLICE pairs."""
    n = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    return (n or 0) > SLICE


def similar_lines(texts: DataFrame, signed: DataFrame, percent: int = 80, leaders: int = 3) -> DataFrame:
    """(k1, component): the classes of the distinct lines ``texts`` that links join, by their keys.

    The written table ``signed`` is removed when its rows are in their buckets.

    In every round each bucket's members are compared with its ``leaders`` (one in the first round), of
    components other than their own; then the leaders leave the bucket, since all their pairs in it are
    done.  When few pairs are left, or a round no longer joins a twentieth of the components that still
    share buckets, all pairs that are left are compared.  Only lines that still have a partner after the
    first round get parities, which then hold for all later pairs.
    """
    own_sketch, parts, stars = signed.select("k1", "way", *_SKETCH), [], []
    way = F.shiftright("key", 5).bitwiseAND(F.lit(1)).cast("int").alias("way")
    for start in range(0, BANDS, BANDS_AT_ONCE):
        rows = signed.select("k1", "way", F.posexplode(F.slice("keys", start + 1, BANDS_AT_ONCE)).alias("band", "key"))
        rows = rows.select("k1", (F.col("key").cast("long") * 64 + F.col("way") * 32 + F.col("band") + start).alias("key"))
        bucket = Window.partitionBy("key")
        rows = rows.withColumn("size", F.count(F.lit(1)).over(bucket)).withColumn("lead", F.min("k1").over(bucket))
        # The lead's comparisons are these rows; it takes no part in later rounds, so buckets of two are done.
        rows = written(rows.where("size > 1 and k1 != lead"), "line-members")
        parts.append(rows)
        stars.append(written(rows.select(F.col("lead").alias("a"), F.col("k1").alias("b"), way).distinct(), "line-stars"))
    both = stars[0]
    for more in stars[1:]:
        both = both.unionByName(more)
    both = written(both.distinct(), "line-stars")
    discard(*stars)
    for n in ("b", "a"):
        both = both.join(own_sketch.select(F.col("k1").alias(n), "way", *(F.col(x).alias(f"{x}{n}") for x in _SKETCH)), [n, "way"])
    both = both.where(close([f"{x}a" for x in _SKETCH], [f"{x}b" for x in _SKETCH]))
    stars = written(both.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "line-stars")
    bare = parts[0]
    for more in parts[1:]:
        bare = bare.unionByName(more)
    bare = bare.where("size > 2").select("key", "k1", "size", way)
    at = written(bare.join(own_sketch, ["k1", "way"]).drop("way").withColumn("component", F.col("k1")), "line-members")
    discard(*parts, signed)
    at_once = max(SLICE, texts.count() // 4)
    joined = tried = None

    def link(pairs: DataFrame, leads: DataFrame | None = None, last: bool = False) -> int:
        """Compares the pairs (a, b, ca, cb) not compared before, and joins their components; ``leads`` (key, lead) are done."""
        nonlocal joined, tried, at
        pairs = pairs.dropDuplicates(["a", "b"])  # a pair may share many buckets
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        before = at
        with scratch() as keep:
            pairs = keep(written(pairs, "line-pairs"))
            tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
            links = similar(pairs, texts, percent, at_once)
            over = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            over = written(over.select(F.col("node").alias("old"), F.col("component").alias("new")), "line-joined")
            if joined is None:
                joined = keep(over).select(F.col("old").alias("k1"), F.col("new").alias("component"))
            else:
                moved = joined.join(over, F.col("component") == F.col("old"), "left").select("k1", F.coalesce("new", "component").alias("component"))
                fresh = over.join(joined.select("k1"), F.col("old") == F.col("k1"), "left_anti").select(F.col("old").alias("k1"), F.col("new").alias("component"))
                joined = keep(written(moved.unionByName(fresh), "line-components"))
            if last:
                return 0
            # Of the members, only those of buckets that still have more than one component go on, at first only those with partners.
            now = at if leads is None else at.join(leads.select("key", F.col("lead").alias("k1")), ["key", "k1"], "left_anti")
            now = now.join(F.broadcast(over) if over.count() <= SMALL_SIDE else over, F.col("component") == F.col("old"), "left")
            now = written(now.withColumn("component", F.coalesce("new", "component")).drop("old", "new"), "line-placed")
            at = keep(written(with_partners(now) if leads is None else open_buckets(now), "line-unjoined"))
            discard(before)
            return over.where("old != new").count()

    n = link(stars)
    nodes = written(at.select("k1").distinct(), "line-nodes")
    marks = written(parities(narrow_to(texts.select("k1", "line"), nodes, ["k1"], nodes.count()).dropDuplicates(["k1"])), "line-parities")
    turn = 1
    while n and many_pairs(at) and n * 20 >= at.select("component").distinct().count():
        seeds = range(leaders * turn, leaders * (turn + 1))
        leads = at.groupBy("key").agg(*(F.min_by(F.struct("k1", "component", *_SKETCH), F.xxhash64(F.lit(s), "k1")).alias(f"l{s}") for s in seeds))
        leads = leads.select("key", F.explode(F.array_distinct(F.array(*(f"l{s}" for s in seeds)))).alias("l"))
        leads = written(leads.select("key", F.col("l.k1").alias("lead"), F.col("l.component").alias("cl"), *(F.col(f"l.{x}").alias(f"l{x}") for x in _SKETCH)), "line-leads")
        meet = at.join(leads, "key").where((F.col("component") != F.col("cl")) & close(_SKETCH, [f"l{x}" for x in _SKETCH]))
        first = F.col("k1") < F.col("lead")
        meet = meet.select(
            F.least("k1", "lead").alias("a"), F.greatest("k1", "lead").alias("b"),
            F.when(first, F.col("component")).otherwise(F.col("cl")).alias("ca"), F.when(first, F.col("cl")).otherwise(F.col("component")).alias("cb"),
        ).dropDuplicates(["a", "b"])
        for x in ("a", "b"):
            meet = meet.join(marks.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")), x)
        n = link(meet.where(can_be_similar("a", "b", percent)).select("a", "b", "ca", "cb"), leads)
        discard(leads)
        turn += 1
    few = at.where(F.col("size") <= SMALL).select("key", "k1", "component", *_SKETCH)
    # Buckets meet their parities so many rows at a time, which bounds what is shuffled at once.
    slices, pairs = max(1, -(-few.count() // MEMBERS_AT_ONCE)), None
    for i in range(slices):
        some = few.where(F.pmod(F.xxhash64(F.lit(6), "key"), F.lit(slices)) == i) if slices > 1 else few
        found = unjoined_pairs(some.join(marks, "k1"), percent)
        made = written(found, "line-pairs")
        discard(found.made_of)
        pairs = made if pairs is None else pairs.unionByName(made)
    discard(nodes, marks)
    large = written(at.where(F.col("size") > SMALL).select("k1", "component").distinct(), "line-large")
    if n := large.count():
        each = narrow_to(texts.select("k1", "line"), large, ["k1"], n).dropDuplicates(["k1"])
        each = each.select(F.col("k1").alias("c"), "component", grams(F.col("line")).alias("all"))
        each = written(each.select("c", "component", F.size("all").alias("n"), F.explode("all").alias("s")), "line-grams")
        found = prefix_pairs(each, percent)
        found = found.join(large.select(F.col("k1").alias("a"), F.col("component").alias("ca")), "a").join(large.select(F.col("k1").alias("b"), F.col("component").alias("cb")), "b")
        pairs = pairs.unionByName(found.select("a", "b", "ca", "cb"))
    link(pairs, last=True)
    return joined


def repeated_lines(documents: DataFrame, percent: int = 80, fuzzy: bool = True) -> DataFrame:
    """(doc_id, row, pos, keep_doc_id, keep_pos): every line to drop, with the line that stays for it.

    Of the lines of a component, the one of the smallest (doc_id, pos) stays; rows that share a doc_id
    are told apart by ``row``, the key of doc_id and text, which also breaks that tie.  Lines of white
    space only are never dropped; a null text has no lines; a null doc_id comes after all others.  Rows
    equal in doc_id and text count as one.  Written before it is returned.
    """
    with scratch() as keep:
        return keep(_repeated_lines(documents, percent, fuzzy))


def _repeated_lines(documents: DataFrame, percent: int, fuzzy: bool) -> DataFrame:
    lines = lines_of(documents)
    # The line is of the key, so that no sort is needed to keep it.
    classes = lines.groupBy("k1", "k2", *(["line"] if fuzzy else [])).agg(F.count(F.lit(1)).alias("copies"))
    lines = written(lines.drop("line"), "lines")
    if fuzzy:
        texts = written(classes, "line-texts")
        signed = written(signed_lines(texts), "line-signatures")
        joined = similar_lines(texts, signed, percent)
        classes = texts.select("k1", "k2", "copies").join(joined, "k1", "left")
        told = classes.where("copies > 1 or component is not null").select("k1", "k2", F.coalesce("component", "k1").alias("component"))
    else:
        told = classes.where("copies > 1").select("k1", "k2", F.col("k1").alias("component"))
    last = F.lit((1 << 63) - 1)
    place = F.struct(F.coalesce("doc_id", last).alias("d"), F.col("pos").alias("p"), F.col("row").alias("r"))
    # Both sides of each join come from tables, so that the rows of a frequent line can be split.
    told = written(told, "line-classes")
    found = written(lines.select("doc_id", "row", "pos", "k1", "k2").join(told, ["k1", "k2"]).select("component", "doc_id", "row", "pos"), "line-copies")
    keep = written(found.groupBy("component").agg(F.min(place).alias("keep")), "line-kept")
    drop = found.join(keep, "component").where(place != F.col("keep"))
    return written(drop.select("doc_id", "row", "pos", F.nullif(F.col("keep.d"), last).alias("keep_doc_id"), F.col("keep.p").alias("keep_pos")), "line-drops")


def drop_lines(documents: DataFrame, drops: DataFrame) -> DataFrame:
    """``documents`` without the lines of ``drops``, with n_lines and n_dropped; other columns unchanged.

    Lines that stay keep their order.  A text that loses all its lines is empty.  Rows that share a
    doc_id lose each its own lines; rows equal in doc_id and text lose the same.  Columns of those two
    names in ``documents`` are replaced.
    """
    own = [c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped", "_gone", "_row", "_id")]
    some_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    per_row = drops.groupBy(some_id.alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("pos").alias("_gone"))  # lines of one text
    per_row = written(per_row, "gone")
    out = documents.select(*own, some_id.alias("_id"), row_key().alias("_row")).join(per_row, ["_id", "_row"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in own),
        n_lines.alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )

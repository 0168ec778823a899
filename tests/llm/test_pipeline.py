"""The pipeline against a brute-force version of its stages, and the registered queries."""

import glob
import os

import pytest

from . import brute

P = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    source = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    def stage(name, docs):
        out = stages[name](spark, docs, sf)
        assert out.columns == source.columns, name
        return out

    # Each stage against its plain version on its own input.
    found = stage("language ID", source)
    docs = texts(found)
    assert docs == {i: t for i, t in texts(source).items() if t and any(c.isalpha() for c in t)}

    want = brute.repeated(docs)
    found = stage("line dedup", found)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in found.collect()}
    missed = 0
    for i, t in docs.items():
        lines, left, gone = t.split("\n"), kept.get(i, ("", 0))[0].split("\n"), []
        at = 0
        for p, line in enumerate(lines):
            if at < len(left) and left[at] == line and i in kept:
                at += 1
                missed += (i, p) in want
            else:
                gone.append(p)
                # Where lines of one text are equal, it is the later ones that go.
                assert (i, p) in want or not line.strip(" ") or line in lines[p + 1 :] or i not in kept
        assert i not in kept or kept[i][1] == len(kept[i][0])
    assert missed <= 0.02 * len(want), "candidates are found by banding; see the README"
    docs = {i: t for i, (t, _) in kept.items()}

    of = brute.near(docs, 5)
    found = stage("MinHash near-dedup", found)
    docs = {i: t for i, t in docs.items() if of[i] == i}
    assert texts(found) == docs

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = stage("benchmark decontamination", found)
    docs = {i: t for i, t in docs.items() if not brute.hits(t, items)[1]}
    assert texts(found) == docs

    packed = corpus_pipeline.run(spark, sf).toPandas()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in docs.items()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == sizes


def test_stages_on_odd_rows(spark, sf):
    """Rows of one doc_id, exact repeats, rows without doc_id, null and empty texts, and columns with clashing names."""
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    prose = " ".join(f"word{i} of some text" for i in range(30))
    rows = [
        (1, prose, None, "a", 5), (1, "another text altogether under the same number\nand a second line of it", "en", "a", 5),
        (2, prose + " more", "en", "b", 5), (2, "what is said here is said nowhere else in this table", "en", "b", 5),
        (3, item, "en", "c", 5), (3, "clean words under the number of a dirty text, quite enough of them", "en", "c", 5),
        (None, "a text without a number stays where it is", "en", "d", 5), (4, None, "en", "d", 5), (5, "", "en", "d", 5),
        (6, "twice the same row", "en", "e", 5), (6, "twice the same row", "en", "e", 5),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, component string, n_dropped int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    want = [rows[0], rows[1], rows[3], rows[5], rows[6], rows[9], rows[10]]
    assert got == sorted(((r[0], r[1]) for r in want), key=str)
    assert corpus_pipeline.packing_stage(spark, docs, sf).count() == 7


def test_stages_take_nothing(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stages_remove_their_tables(spark, sf):
    """What a stage has written goes when its result no longer needs it: rows to leave out stay, texts and postings do not."""
    import corpus_pipeline
    from tidelog.llm.shared import new_folder, written

    shared = os.path.dirname(new_folder(spark, "x")).removeprefix("file://")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = set(os.listdir(shared))
        docs = written(stage(spark, docs, sf), "result")
        left = {x.rpartition("-")[0] for x in set(os.listdir(shared)) - before}
        assert left <= {"result", "gone", "near-copies", "contaminated", "test-windows", "windows"}, left
        assert ("gone", "near-copies", "contaminated")[k - 1] in left or not k
    assert docs.count()


def test_tables_written_in_a_scope_are_removed(spark):
    from tidelog.llm.shared import scratch, written

    one = lambda n: written(spark.range(n), "scoped")
    there = lambda df: os.path.exists(df.written_to.removeprefix("file://"))
    with scratch() as keep:
        with scratch() as keep_inner:
            a, b = keep_inner(one(3)), one(4)
        assert there(a) and not there(b)
        c = keep(one(5))
    assert not there(a) and there(c) and c.count() == 5
    with pytest.raises(ValueError), scratch():
        d = one(2)
        raise ValueError
    assert not there(d) and there(one(1))


def test_queries_agree_with_their_sql(spark, sf):
    import duckdb

    from tidelog.llm.queries import ORACLE_SQL, QUERIES

    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, sf)
        want = con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda d: sorted(tuple(str(None if v != v else v) for v in r) for r in d[columns].astype(object).itertuples(index=False))
        tidy = lambda d: d.assign(**{c: d[c].map(lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v) for c in d})
        assert rows(tidy(got.toPandas())) == rows(tidy(want)), name

"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document: a shard holds, for about ``shard_words`` words of text, all its
terms and the ascending positions of each.  A window of test words is looked up from its rarest term in
the shard: the positions, each moved back by the term's place in the window, are intersected with those
of the next rarest term, until no position or no term is left.  A position that survives all terms starts
an exact occurrence.  With ``slop``, a term may stand up to that many words away from its place, which
gives proximity matches.

The test windows reach the tasks as blocks of about ``block_words`` words in the shared folder, written
by tasks and read one after another, so neither a task nor the driver holds a test set of any size.  Of
a block only the windows whose terms are all in the shard are looked up.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import row_key
from .shared import new_folder, open_shared, replace_file, task_label, written

#: Word characters are 0-9, a-z after lower-casing A-Z, and everything past ASCII; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Between two documents of a shard, so that no window spans both.
_GAP = 128


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Terms(dict):
    """Numbers terms as they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _load(path: str):
    fs, place = open_shared(path)
    with fs.open_input_file(place) as f:
        return pickle.loads(f.read())


def store_windows(benchmark: DataFrame, folder: str, window: int, block_words: int = 200_000) -> list[str]:
    """Writes the blocks of windows; returns their paths.

    A block has its terms, a row of term numbers per window (-1 after the last of a shorter one) and the
    item_ids per window.  An item of fewer words than ``window``, but not none, is one window.  Null texts
    have no words.  An item without item_id hits words, but is no item to be listed or counted.
    """
    import pyarrow as pa

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, attempt = task_label()
        terms, found, held, made = _Terms(), {}, 0, 0

        def flush():
            nonlocal terms, found, held, made
            path, made = f"{folder}/block-{part:06d}-{made:06d}", made + 1
            rows = np.full((len(found), window), -1, np.int32)
            for row, own in zip(rows, found):
                row[: len(own)] = own
            with replace_file(path, attempt) as out:
                out.write(pickle.dumps((list(terms), rows, list(found.values())), protocol=5))
            terms, found, held = _Terms(), {}, 0
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [terms[w] for w in words_of(text.encode())]
                for at in range(max(1, len(ids) - window + 1) if ids else 0):
                    items = found.setdefault(tuple(ids[at : at + window]), set())
                    if item_id is not None:
                        items.add(item_id)
                held += len(ids)
                if held >= block_words:
                    yield flush()
        if found:
            yield flush()

    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = written(items.mapInArrow(write, "path string"), "windows")
    return [r["path"] for r in blocks.orderBy("path").collect()]  # a row per block


def build_index(documents: DataFrame, shard_words: int = 600_000) -> DataFrame:
    """The shards: (shard, doc_ids, unnamed, rows, n_words, terms, counts, steps), arrays as little-endian bytes.

    ``terms`` has the terms, a line feed between two; ``steps`` are the differences of their positions,
    term after term; ``unnamed`` marks documents without doc_id.  Every document is in a shard.
    """
    import pyarrow as pa

    names = ["shard", "doc_ids", "unnamed", "rows", "n_words", "terms", "counts", "steps"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, _ = task_label()
        made = 0

        def shard(documents, terms, found):
            nonlocal made
            n_words = np.array([len(f) for f in found], np.int64)
            begin = np.cumsum(n_words + _GAP) - n_words - _GAP
            term = np.concatenate(found)
            place = np.arange(len(term)) + np.repeat(begin - (np.cumsum(n_words) - n_words), n_words)
            order = np.argsort(term, kind="stable")
            place = place[order]
            counts = np.bincount(term, minlength=len(terms))
            made += 1
            columns = [
                np.array([i or 0 for i, _ in documents], "<i8"), np.array([i is None for i, _ in documents], "u1"), np.array([r for _, r in documents], "<i8"),
                n_words.astype("<i4"), b"\n".join(terms), counts.astype("<i4"), np.diff(place, prepend=0).astype("<i4"),
            ]
            packed = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), *(pa.array([c], pa.binary()) for c in packed)], names)

        documents, terms, found, held = [], _Terms(), [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                for doc_id, row, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    documents.append((doc_id, row))
                    found.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                    held += len(words) + _GAP
                    if held >= shard_words:
                        yield shard(documents, terms, found)
                        documents, terms, found, held = [], _Terms(), [], 0
        if documents:
            yield shard(documents, terms, found)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{n} {'string' if n == 'shard' else 'binary'}" for n in names)
    return texts.mapInArrow(build, kinds)


def occurrences(lists: list, slop: int = 0):
    """Positions at which a window starts, from its terms' positions: rarest first, each moved by its place."""
    import numpy as np

    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    if slop:  # the rarest term may itself stand away from its place
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for offset in order if slop else order[1:]:
        found = lists[offset]
        at = np.searchsorted(found, starts + (offset - slop))
        inside = at < len(found)
        near = found[np.where(inside, at, 0)] - starts - offset
        starts = starts[inside & (near <= slop) & (near >= -slop)]
        if not len(starts):
            return None
    return starts


def search_index(index: DataFrame, blocks: list[str], slop: int = 0) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items, n_near_items, near_items) per document of the index.

    ``items``: the item_ids with an exact occurrence, sorted as strings, comma-joined; ``near_items``
    those with a window all of whose terms stand within ``slop`` of their places (the exact ones for 0).
    """
    import pyarrow as pa

    if slop * 4 >= _GAP:
        raise ValueError(f"slop must be less than {_GAP // 4}")
    i64, text = pa.int64(), pa.string()
    fields = "doc_id long, row long, n_words long, n_hit long, n_items long, items string, n_near_items long, near_items string"
    schema = pa.schema([(f.split()[0], text if f.endswith("string") else i64) for f in fields.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last: tuple = ("", None)
        for batch in batches:
            for shard in batch.to_pylist():
                doc_ids, rows = (np.frombuffer(shard[k], "<i8") for k in ("doc_ids", "rows"))
                n_words, counts, steps = (np.frombuffer(shard[k], "<i4") for k in ("n_words", "counts", "steps"))
                number = {t: i for i, t in enumerate(shard["terms"].split(b"\n"))} if len(counts) else {}
                place = np.cumsum(steps, dtype=np.int64)
                ends = np.cumsum(counts)
                base = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + _GAP)])
                edge = np.zeros(int(base[-1]) + 1, np.int32)
                exact: list[set] = [set() for _ in range(len(doc_ids))]
                close: list[set] = [set() for _ in range(len(doc_ids))]
                documents = lambda starts: np.unique(np.searchsorted(base, starts, side="right") - 1).tolist()
                for path in blocks:
                    if last[0] != path:
                        last = (path, _load(path))
                    terms, windows, items = last[1]
                    here = np.array([*(number.get(t, -2) for t in terms), -1], np.int64)  # the last for places after a short window
                    whole = here[windows]
                    for k in np.flatnonzero((whole > -2).all(1)).tolist():
                        lists = [place[ends[t] - counts[t] : ends[t]] for t in whole[k].tolist() if t >= 0]
                        starts = occurrences(lists)
                        if starts is not None:
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + len(lists), -1)
                            for d in documents(starts):
                                exact[d] |= items[k]
                        if slop and (starts := occurrences(lists, slop)) is not None:
                            for d in documents(np.maximum(starts, 0)):
                                close[d] |= items[k]
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
                found = [sorted(x) for x in exact]
                near = [sorted(a | b) for a, b in zip(exact, close)]
                n_hit = hit[base[1:] - _GAP] - hit[base[:-1]]
                named = [None if gone else i for i, gone in zip(doc_ids.tolist(), shard["unnamed"])]
                columns = [
                    named, rows, n_words.astype(np.int64), n_hit.astype(np.int64), [len(x) for x in found], [",".join(x) for x in found],
                    [len(x) for x in near], [",".join(x) for x in near],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return index.mapInArrow(search, fields)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items, n_near_items, near_items, contaminated) per document.

    A word is hit if it is inside any occurrence of a window of ``window`` consecutive item words.
    Null texts have no words and no hits; a null doc_id stays null, and ``row`` tells rows of one doc_id
    apart; repeated rows and repeated items are each looked at; empty tables give an empty result or no
    hits.  Other columns of either table are not read.
    """
    blocks = store_windows(benchmark, new_folder(documents.sparkSession, "test-windows"), window)
    index = written(build_index(documents), "postings")
    return search_index(index, blocks, slop).withColumn("contaminated", F.col("n_hit") > 0)

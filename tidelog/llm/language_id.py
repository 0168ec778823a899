"""Language identification by cross-parsing entropy.

For each language a suffix automaton of some labelled text is built.  A text is parsed against it
greedily: the longest stretch that occurs in the labelled text is a phrase, and the next phrase starts
after it.  Fewer phrases mean a closer language; the number of phrases times log2 of the labelled
text's length, divided by the text's length, estimates the cross entropy in bits per character.

An automaton's transitions lie in one array, each state's shifted so that none meet (row displacement),
so its size follows the labelled text and not the alphabet.  All blocks of STRETCH symbols of a batch are
first parsed at once, as if a phrase started at each.  Then every block is parsed again from the state
that the block before it ends in, only until both parses start a phrase at the same place, from where
they agree; where a block's end changes by that, the next block is parsed again.  So the result is the
greedy parse of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 256
_SPACE = 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for a in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and a not in step[p]:
            step[p][a] = new
            p = link[p]
        if p >= 0:
            q = step[p][a]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(a) == q:
                    step[p][a] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """The transitions of a suffix automaton, packed; ``start`` has those of the start by symbol."""

    def __init__(self, step: list[dict[int, int]], n_symbols: int):
        import numpy as np

        self.fresh = len(step)  # the state before any phrase: it has no transitions
        taken: dict[int, int] = {}
        base, free, least = [0] * (len(step) + 1), n_symbols, n_symbols
        for state in sorted(range(1, len(step)), key=lambda i: -len(step[i])):
            if symbols := sorted(step[state]):
                while free in taken:
                    free += 1
                # A single transition goes to the first free place; larger states do not look at the full part again.
                at = begin = (free if len(symbols) == 1 else max(free, least)) - symbols[0]
                while any(at + a in taken for a in symbols):
                    at += 1
                if at - begin > 64:
                    least = at + symbols[0]
                base[state] = at
                for a in symbols:
                    taken[at + a] = state << 32 | step[state][a]
        self.base = np.array(base, np.int64)
        self.packed = np.full(max(taken, default=0) + n_symbols + 1, -1, np.int64)
        self.packed[list(taken)] = list(taken.values())
        self.start = np.full(n_symbols, self.fresh, np.int64)
        for a, s in step[0].items():
            self.start[a] = s

    def step(self, state, symbols):
        """(the next states, whether a new phrase starts with the symbol)."""
        import numpy as np

        found = self.packed[self.base[state] + symbols]
        new = found >> 32 != state
        return np.where(new, self.start[symbols], found & 0xFFFFFFFF), new


class Languages:
    """The labelled languages: all their letters, and an automaton each."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = {ord(c) for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()}
        self.alphabet = {c: i + 2 for i, c in enumerate(sorted(letters))}
        self.other = len(self.alphabet) + 2  # a letter of no labelled text: a phrase of its own
        self.names, self.automata, self.bits = [], [], []
        for name in sorted(samples):
            streams = [self.symbols(t) for t in samples[name]]
            symbols = [s for stream in streams for s in (*stream.tolist(), _SPACE)]
            if any(s != _SPACE for s in symbols):
                import numpy as np

                self.names.append(name)
                self.automata.append(Automaton(suffix_automaton(symbols), self.other + 1))
                self.bits.append(float(np.log2(len(symbols) + 1)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_of"}

    def symbols(self, text: str):
        """Symbols of the lower-cased text; whatever is no letter is one blank."""
        import numpy as np

        if not hasattr(self, "_of"):
            of = np.full(0x110000, _SPACE, np.int32)
            of[[i for i in range(0x110000) if chr(i).isalpha()]] = self.other
            of[list(self.alphabet)] = list(self.alphabet.values())
            self._of = of
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        found = self._of[codes]
        return found[~((found == _SPACE) & (np.concatenate([[0], found[:-1]]) == _SPACE))] if len(found) else found

    def phrases(self, streams: list):
        """Phrases of each stream in each language, and symbols: (streams x languages, streams)."""
        import numpy as np

        sizes = np.array([len(s) for s in streams], np.int64)
        blocks = -(-sizes // STRETCH)
        total = int(blocks.sum())
        out = np.zeros((len(streams), len(self.automata)), np.int64)
        if not total:
            return out, sizes
        owner = np.repeat(np.arange(len(streams)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        filled = np.minimum(sizes[owner] - (np.arange(total) - first[owner]) * STRETCH, STRETCH)
        grid = np.zeros((total, STRETCH), np.int32)
        grid[np.arange(STRETCH) < filled[:, None]] = np.concatenate(streams)
        # Column i has the symbols at place i of all blocks, the longest first.
        order = np.argsort(-filled, kind="stable")
        row_of = np.empty(total, np.int64)
        row_of[order] = np.arange(total)
        columns, filled, owner = np.ascontiguousarray(grid[order].T), filled[order], owner[order]
        active = np.searchsorted(-filled, -np.arange(STRETCH), side="left")
        follows = np.flatnonzero(~np.isin(np.arange(total), first[blocks > 0]))  # blocks that go on a text
        after, before = row_of[follows], row_of[follows - 1]
        next_of = np.full(total, -1, np.int64)
        next_of[before] = after
        for k, automaton in enumerate(self.automata):
            state = np.full(total, automaton.fresh, np.int64)
            starts = np.zeros((STRETCH, total), bool)
            for i in range(STRETCH):
                n = active[i]
                if not n:
                    break
                state[:n], starts[i, :n] = automaton.step(state[:n], columns[i, :n])
            guess = np.cumsum(starts, axis=0, dtype=np.int32)
            count, ends = guess[-1].astype(np.int64), state.copy()
            rows, entry = after, state[before]
            while len(rows):
                ended = ends[rows].copy()
                self._again(automaton, columns, filled, starts, guess, state, rows, entry, count, ends)
                changed = rows[ends[rows] != ended]
                rows = next_of[changed]
                entry = ends[changed][rows >= 0]
                rows = rows[rows >= 0]
            out[:, k] = np.bincount(owner, count, len(streams)).astype(np.int64)
        return out, sizes

    @staticmethod
    def _again(automaton, columns, filled, starts, guess, guessed_end, rows, entry, count, ends) -> None:
        """Parses blocks from their true entry states; sets their numbers of phrases and their ends."""
        import numpy as np

        state, own = entry.copy(), np.zeros(len(rows), np.int64)
        for i in range(len(columns)):
            live = filled[rows] > i
            if not live.all():
                done = rows[~live]
                count[done], ends[done] = own[~live], state[~live]
                rows, state, own = rows[live], state[live], own[live]
            if not len(rows):
                return
            state, new = automaton.step(state, columns[i, rows])
            own += new
            met = new & starts[i, rows]
            if met.any():
                same = rows[met]
                count[same] = own[met] + guess[-1, same] - guess[i, same]
                ends[same] = guessed_end[same]
                rows, state, own = rows[~met], state[~met], own[~met]
        count[rows], ends[rows] = own, state

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """(language, score) of each text: the score is the margin to the next best, 0 to 1."""
        import numpy as np

        streams = [self.symbols(t) for t in texts]
        letters = np.array([bool((s > _SPACE).any()) for s in streams], bool)
        if not self.names or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        found, sizes = self.phrases(streams)
        entropy = found * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(1)
        least = entropy[np.arange(len(texts)), best]
        if len(self.names) > 1:
            second = np.partition(entropy, 1, axis=1)[:, 1]
            score = np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 0.0)
        else:
            score = np.ones(len(texts))
        names = [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, np.clip(score, 0, 1), 0.0).tolist()


def held_out(doc_id: str, remainder: int = 0):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder


def learn(
    documents: DataFrame, sample_chars: int = 40_000, sample_documents: int = 200, excerpt_chars: int = 400, max_languages: int = 500
) -> Languages:
    """Fits the languages on labelled documents that are not held out.

    The sample is bounded: about ``sample_documents`` documents of a language, at most twice as many,
    chosen by a hash of their doc_id, and of each one excerpt of ``excerpt_chars`` from a place that the
    hash chooses; of these up to ``sample_chars`` are kept.  So the driver holds at most 2 *
    sample_documents * excerpt_chars characters of a language, and no more than the ``max_languages`` most
    frequent languages.  Null or empty texts and null languages teach nothing.
    """
    labelled = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & (F.length("text") > 0))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return Languages({})
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    every = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(1, r["count"] // sample_documents)))])
    chosen = labelled.where(mixed % every[F.col("lang")] == 0)
    start = (F.floor(mixed / 4096) % F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1))).cast("int") + 1
    rows = chosen.select("lang", mixed.alias("h"), F.col("text").substr(start, F.lit(excerpt_chars)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    held: Counter = Counter()
    for lang, _, part in sorted(map(tuple, rows)):
        if held[lang] < min(sample_chars, 2 * sample_documents * excerpt_chars):
            samples.setdefault(lang, []).append(part)
            held[lang] += len(part)
    return Languages(samples)


def identify(documents: DataFrame, languages: Languages, batch_chars: int = 2_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, *carry) per row; only the text decides.

    ``und`` with score 0 for a text that is null or has no letters, or when nothing was learned.  Ties
    go to the language first in order.  Repeated rows and null doc_ids come back as they are.
    """
    import pyarrow as pa

    model = documents.sparkSession.sparkContext.broadcast(languages)  # bounded by learn()'s parameters
    kept = documents.select("doc_id", "text", *[c for c in carry if c not in ("doc_id", "text", "lang_pred", "score")])
    out = kept.schema.fields
    names = [f.name for f in out if f.name != "text" or "text" in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            sizes = batch.column("text").cast(pa.binary()).to_pylist() if batch.num_rows else []
            while start < batch.num_rows:
                end, held = start, 0
                while end < batch.num_rows and (end == start or held + len(sizes[end] or b"") <= batch_chars):
                    held += len(sizes[end] or b"")
                    end += 1
                part = batch.slice(start, end - start)
                lang, score = model.value.predict([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
                start = end

    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out if f.name in names)
    return kept.mapInArrow(run, f"{declared}, lang_pred string, score double")

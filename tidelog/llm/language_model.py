"""Scoring with a gated recurrent language model, beside a smoothed unigram base.

What is gathered from the whole training corpus: the count of every distinct token.  The most frequent
``n_frequent`` tokens (a bounded table) go to the tasks; all others are summed per document by a join.

The model: a token's probability is that of its class times its own within the class, both softmaxes over
a gated recurrent unit's state.  The frequent tokens are put into classes by the company they keep; the
last class holds every other token, unseen ones included.  The softmax within a class is over its tokens
among the ``n_output`` most frequent; the class's other tokens together have their share of its smoothed
corpus counts, and of that each its own.  So the probabilities over all tokens add up to one.

The classes come from the neighbours of the frequent tokens in all documents.  The unit is trained by
truncated backpropagation, by the tasks on all documents: each task goes on from the same weights, which a
short training on a few documents made, and the mean of their changes is taken.  In scoring the state is carried
through the whole document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import task_label, written

#: The end token; no word is empty.
END = b""


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII white space."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.lower().split()


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def count_tokens(documents: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(word, c) over all documents, ends included; holds ``most_held`` words of a task at a time."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                for text in some.column(0).cast(pa.binary()).to_pylist():
                    held.update(words_of(text))
                held[END] += some.num_rows
                if len(held) >= most_held:
                    yield out()
                    held.clear()
        if held:
            yield out()

    partial = documents.select("text").mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """Classes, the softmaxes within them, shares of the other tokens, and the recurrent unit."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, n_classes: int = 48, hidden: int = 24, n_input: int = 20_000, seed: int = 7, n_output: int = 2_000):
        import numpy as np

        self.words, self.total, self.distinct = words, total, distinct
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, float)
        self.n_input, self.hidden, self.n_classes = min(n_input, len(words)), hidden, n_classes
        self.rare_class, self.n_output = n_classes - 1, min(n_output, len(words))
        self.classes = np.zeros(len(words) + 1, np.int32)
        rng = np.random.default_rng(seed)
        self.params = {
            "x": rng.normal(0, 0.1, (self.n_input + n_classes, 3 * hidden)),  # a row per frequent token, then per class
            "u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
            "b": np.zeros(3 * hidden),
            "o": rng.normal(0, 0.1, (hidden, n_classes)),
            "c": np.zeros(n_classes),
            "w": np.zeros((self.n_output, hidden)),
            "d": np.zeros(self.n_output),
        }

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.index = {w: i for i, w in enumerate(self.words)}

    def ids(self, words: list[bytes]):
        import numpy as np

        look, rare = self.index.get, len(self.words)
        return np.array([look(w, rare) for w in words], np.int32)

    def inputs(self, ids):
        """Rows of the input table: a token's own, or its class's."""
        import numpy as np

        return np.where(ids < self.n_input, ids, self.n_input + self.classes[ids])

    def make_classes(self, stream, n_context: int = 150, rounds: int = 8) -> None:
        """Classes by the neighbours of the tokens that ``stream`` has three times at least."""
        import numpy as np

        seen = np.bincount(stream[stream < len(self.words)], minlength=len(self.words))
        known = np.flatnonzero(seen >= 3)[: self.n_placed]
        vectors = self.neighbours(np.zeros((self.n_placed, 2 * n_context), np.float32), stream)
        self.group(known, seen[known], vectors[known], rounds)

    @property
    def n_placed(self) -> int:
        """So many of the most frequent tokens are put into classes by their neighbours."""
        return min(len(self.words), 20_000)

    def neighbours(self, vectors, stream):
        """Adds to ``vectors`` how often each of the most frequent tokens stands before and after each token placed."""
        import numpy as np

        m = vectors.shape[1] // 2
        for a, b, shift in ((stream[1:], stream[:-1], 0), (stream[:-1], stream[1:], m)):
            ok = (a < len(vectors)) & (b < min(m, len(self.words)))
            np.add.at(vectors, (a[ok], b[ok] + shift), 1)
        return vectors

    def group(self, known, seen, vectors, rounds: int = 8) -> None:
        """k-means over the neighbours of the tokens ``known``, met ``seen`` times."""
        import numpy as np

        n, k = len(self.words), self.n_classes - 1
        self.classes = np.full(n + 1, self.rare_class, np.int32)
        if not n:
            return
        vectors = np.sqrt(vectors) if len(known) else np.zeros((1, 1), np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
        weight = np.sqrt(seen + 1.0) if len(known) else np.ones(1)
        centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            nearest = (vectors @ centres.T).argmax(1)
            for j in range(k):
                if (here := nearest == j).any():
                    centres[j] = (vectors[here] * weight[here, None]).sum(0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-6)
        # Tokens too rare to be placed share the class that holds most such tokens.
        self.classes[:n] = np.bincount(nearest, minlength=k).argmax() if len(known) else 0
        if len(known):
            self.classes[known] = nearest

    def finish(self) -> None:
        """Shares of the classes' smoothed counts, for the final classes."""
        import numpy as np

        smooth = self.counts + 0.5
        mass = np.bincount(self.classes[: len(self.words)], smooth, self.n_classes).astype(float)
        every = self.total + 0.5 * (self.distinct + 1)
        mass[self.rare_class] += max(every - smooth.sum(), 0.5)
        self.rare_mass = float(mass[self.rare_class])
        share = np.log10(smooth / mass[self.classes[: len(self.words)]])
        # The tokens of the softmax within a class, by class, and what they have of it together.
        head = self.classes[: self.n_output]
        self.members = [np.flatnonzero(head == c) for c in range(self.n_classes)]
        self.place = np.zeros(self.n_output, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        together = np.bincount(head, smooth[: self.n_output], self.n_classes) / np.maximum(mass, 1e-300)
        share[: self.n_output] = np.log10(np.minimum(together, 1.0)[head])
        self.log_share = np.append(share, 0.0)
        self.params["d"] = np.log(smooth[: self.n_output])  # at first the softmax within a class is that of the counts
        self.log_base = np.append(np.log10(smooth / every), 0.0)
        self.log_every = float(np.log10(every))
        self.params["c"] = np.log(np.maximum(mass, 0.5) / mass.sum())

    def within(self, states, words, params, grad=None):
        """(log probabilities, natural, of ``words`` within their classes; what the states get back): all words among n_output.

        With ``grad``, the gradients of the loss are added to its entries and the states' are returned.
        """
        import numpy as np

        out, back = np.empty(len(words), states.dtype), np.zeros_like(states) if grad is not None else None
        of = self.classes[words]
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            rows = order[cuts[c] : cuts[c + 1]]
            if not len(rows):
                continue
            m, at = self.members[c], np.arange(len(rows))
            weights, goal, h = params["w"][m], self.place[words[rows]], states[rows]
            prob = h @ weights.T
            prob += params["d"][m]
            prob -= prob.max(1, keepdims=True)
            own = prob[at, goal]
            np.exp(prob, out=prob)
            total = prob.sum(1)
            out[rows] = own - np.log(total)
            if grad is not None:
                prob[at, goal] -= total
                total = 1 / total  # taken out of the sums, which are much smaller than prob
                grad["w"][m] += prob.T @ (h * total[:, None])
                grad["d"][m] += total @ prob
                back[rows] = (prob @ weights) * total[:, None]
        return out, back

    def train(self, stream, streams: int = 48, window: int = 16, epochs: int = 3, rate: float = 0.01) -> list[float]:
        """Truncated backpropagation through time; the state runs on between windows, and is cleared at an end.

        Returns the mean loss (nats) of each epoch, of the class and of the word within it.
        """
        import numpy as np

        p, h_n = self.params, self.hidden
        length = len(stream) // streams
        if length < window + 1:
            streams = max(1, len(stream) // (window + 1))
            length = len(stream) // streams
        grid = stream[: length * streams].reshape(streams, length)
        rows, goal = self.inputs(grid), self.classes[grid]
        end = self.index.get(END, len(self.words))
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        kind, t_all, losses = p["u"].dtype, 0, []
        for _ in range(epochs):
            h, loss, n = np.zeros((streams, h_n), kind), 0.0, 0
            for at in range(0, length - 1, window):
                width = min(window, length - 1 - at)
                count = width * streams
                # Only the state goes step by step; all else is done for the window at once, in rows by step and stream.
                touched, place = np.unique(rows[:, at : at + width].T, return_inverse=True)
                place = place.reshape(-1)
                x = (p["x"][touched] + p["b"])[place].reshape(width, streams, 3 * h_n)
                alive = (grid[:, at : at + width] != end).T[..., None].astype(kind)
                before, new, c = (np.empty((width, streams, h_n), kind) for _ in range(3))
                gate, g = np.empty((width, streams, 2 * h_n), kind), np.empty((width, streams, 3 * h_n), kind)
                for t in range(width):
                    h = before[t] = h * alive[t]
                    own = g[t] = h @ p["u"]
                    gate[t] = 1 / (1 + np.exp(-(x[t, :, : 2 * h_n] + own[:, : 2 * h_n])))
                    c[t] = np.tanh(x[t, :, 2 * h_n :] + gate[t, :, h_n:] * own[:, 2 * h_n :])
                    h = new[t] = h + gate[t, :, :h_n] * (c[t] - h)
                states, aims, every = new.reshape(count, h_n), goal[:, at + 1 : at + width + 1].T.reshape(-1), np.arange(count)
                prob = states @ p["o"] + p["c"]
                prob -= prob.max(1, keepdims=True)
                np.exp(prob, out=prob)
                prob /= prob.sum(1, keepdims=True)
                loss -= np.log(prob[every, aims] + 1e-12).sum()
                n += count
                prob[every, aims] -= 1
                prob /= streams
                grad = {"w": np.zeros_like(p["w"]), "d": np.zeros_like(p["d"]), "o": states.T @ prob, "c": prob.sum(0)}
                to_state = prob @ p["o"].T
                words = grid[:, at + 1 : at + width + 1].T.reshape(-1)
                known = np.flatnonzero(words < self.n_output)
                if len(known):
                    found, own = self.within(states[known], words[known], p, grad)
                    loss -= found.sum()
                    to_state[known] += own / streams
                    grad["w"] /= streams
                    grad["d"] /= streams
                to_state = to_state.reshape(width, streams, h_n)
                z, r = gate[..., :h_n], gate[..., h_n:]
                by_c, by_z, by_r, stay = z * (1 - c * c), (c - before) * z * (1 - z), g[..., 2 * h_n :] * r * (1 - r), 1 - z
                dx, dg, back = np.empty_like(g), np.empty_like(g), np.zeros((streams, h_n), kind)
                turned = np.ascontiguousarray(p["u"].T)
                for t in range(width - 1, -1, -1):
                    dh = to_state[t] + back
                    dc = dx[t, :, 2 * h_n :] = dh * by_c[t]
                    dg[t, :, :h_n] = dh * by_z[t]
                    dg[t, :, h_n : 2 * h_n] = dc * by_r[t]
                    dg[t, :, 2 * h_n :] = dc * r[t]
                    back = (dh * stay[t] + dg[t] @ turned) * alive[t]
                dx[..., : 2 * h_n] = dg[..., : 2 * h_n]
                dx = dx.reshape(count, 3 * h_n)
                grad["b"], grad["u"] = dx.sum(0), before.reshape(count, h_n).T @ dg.reshape(count, 3 * h_n)
                order = np.argsort(place, kind="stable")
                grad["x"] = np.add.reduceat(dx[order], np.searchsorted(place[order], np.arange(len(touched))))
                t_all += 1
                for k, change in grad.items():
                    m, v = moment[k]
                    some = touched if k == "x" else slice(None)
                    change = np.clip(change, -1, 1)
                    first, second = m[some], v[some]
                    first = first + 0.1 * (change - first)
                    second = second + 0.001 * (change * change - second)
                    m[some], v[some] = first, second
                    p[k][some] -= rate * (first / (1 - 0.9**t_all)) / (np.sqrt(second / (1 - 0.999**t_all)) + 1e-8)
            losses.append(loss / max(n, 1))
        return losses

    def log10_of(self, streams: list) -> list[float]:
        """log10 of each stream's probability, ends included; tokens that are not frequent count with their class only.

        Documents step together, longest first, each from the cleared state to its end.
        """
        import numpy as np

        p = {k: np.asarray(v, np.float32) for k, v in self.params.items()}
        h_n = self.hidden
        sizes = np.array([len(s) for s in streams], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.concatenate([streams[i] for i in order]) if len(streams) else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(streams) else np.zeros(0, np.int64)
        goal = self.classes[flat]
        end = self.index.get(END, len(self.words))
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[starts] = end
        rows, inputs = self.inputs(before), p["x"] + p["b"]
        picked = np.empty(len(flat), np.float32)
        h = np.zeros((len(streams), h_n), np.float32)
        bound = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(bound), side="left")
        waiting, n_waiting = [], 0

        def words_within() -> None:
            """Adds the words' part within their classes, for the states that wait."""
            nonlocal n_waiting
            places = np.concatenate([a for a, _ in waiting])
            picked[places] += self.within(np.concatenate([h for _, h in waiting]), flat[places], p)[0]
            waiting.clear()
            n_waiting = 0

        for t in range(bound):
            n = active[t]
            at = starts[:n] + t
            x, g = inputs[rows[at]], h[:n] @ p["u"]
            gate = 1 / (1 + np.exp(-(x[:, : 2 * h_n] + g[:, : 2 * h_n])))
            z = gate[:, :h_n]
            c = np.tanh(x[:, 2 * h_n :] + gate[:, h_n:] * g[:, 2 * h_n :])
            h = h[:n] + z * (c - h[:n])
            logits = h @ p["o"] + p["c"]
            top = logits.max(1)
            picked[at] = logits[np.arange(n), goal[at]] - top - np.log(np.exp(logits - top[:, None]).sum(1))
            known = flat[at] < self.n_output
            waiting.append((at[known], h[known]))
            n_waiting += len(waiting[-1][0])
            if n_waiting >= 50_000 or t + 1 == bound:
                words_within()
        total = picked.astype(np.float64) / np.log(10) + self.log_share[flat]
        sums = np.add.reduceat(total, starts) if len(streams) else []
        out = np.empty(len(streams))
        out[order] = sums
        return out.tolist()


def refine(documents: DataFrame, model: Model, one_in: int, piece_tokens: int = 60_000, rate: float = 0.01, streams: int = 128) -> None:
    """Trains ``model`` on one in ``one_in`` of all documents, whole texts, chosen by a hash of their doc_id.

    Each task goes on from the weights it is sent, over its own documents in pieces of about
    ``piece_tokens``, of which it reads ``streams`` stretches side by side.  The weighted mean of the changes
    of all tasks is added: a row of the input table weighs as often as a task met it, others by its tokens.
    Sums are made by parameter row, so a task holds no more than the model.  The means depend a little on
    how documents lie in files.
    """
    import numpy as np
    import pyarrow as pa

    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by n_frequent and n_input
    fields = "name string, row int, weight double, change binary"
    kinds = pa.schema([("name", pa.string()), ("row", pa.int32()), ("weight", pa.float64()), ("change", pa.binary())])

    def told(rows: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 5_000):
            columns = zip(*((name, row, weight, change.tobytes()) for name, row, weight, change in rows[at : at + 5_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.__dict__.update(shared.value.__dict__)
        first = {k: v.astype(np.float32) for k, v in own.params.items()}
        own.params = {k: v.copy() for k, v in first.items()}
        met, tokens, texts, held = np.zeros(len(first["x"])), 0, [], 0

        def piece() -> None:
            nonlocal met, tokens
            stream = np.concatenate([*texts, own.ids([END])])
            own.train(stream, streams=streams, epochs=1, rate=rate)
            met += np.bincount(own.inputs(stream), minlength=len(met))
            tokens += len(stream)

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                texts.append(own.ids([END, *words_of(text)]))
                held += len(texts[-1])
                if held >= piece_tokens:
                    piece()
                    texts, held = [], 0
        if texts:
            piece()
        rows = []
        for name, old in first.items():
            change = np.atleast_2d(own.params[name] - old)
            weights = met if name == "x" else np.full(len(change), tokens)
            rows += [(name, row, float(weights[row]), (change[row] * weights[row]).astype(np.float32)) for row in np.flatnonzero(weights).tolist()]
        yield from told(rows)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for name, row, weight, change in zip(*(c.to_pylist() for c in batch.columns)):
                have = sums.setdefault((name, row), [0.0, 0])
                have[0] += weight
                have[1] = have[1] + np.frombuffer(change, np.float32)
        yield from told([(name, row, weight, change) for (name, row), (weight, change) in sums.items()])

    mixed = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(one_in))
    learned = documents.where(mixed == 0).select("text").mapInArrow(learn, fields)
    found = learned.repartition("name", "row").mapInArrow(total, fields).toArrow()  # the size of the model at most
    for name, row, weight, change in zip(*(c.to_pylist() for c in found.columns)):
        np.atleast_2d(model.params[name])[row] += np.frombuffer(change, np.float32) / weight
    shared.destroy()


def group_tokens(documents: DataFrame, model: Model, n_context: int = 150) -> None:
    """Puts the tokens of ``model`` into classes by their neighbours in all documents, whole texts.

    A task holds a row of ``2 * n_context`` counts for each of the tokens placed; sums are made by row.
    """
    import numpy as np
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by n_frequent and n_input
    size = model.n_placed

    def told(rows: dict) -> Iterator[pa.RecordBatch]:
        at = list(rows)
        for start in range(0, len(at), 2_000):
            some = at[start : start + 2_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["token", "met"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = shared.value, np.zeros((size, 2 * n_context), np.float64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own.neighbours(vectors, own.ids([END, *words_of(text), END]))
        yield from told({i: vectors[i] for i in np.flatnonzero(vectors.any(1)).tolist()})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for token, met in zip(*(c.to_pylist() for c in batch.columns)):
                sums[token] = sums.get(token, 0) + np.frombuffer(met)
        yield from told(sums)

    found = documents.select("text").mapInArrow(count, "token int, met binary").repartition("token").mapInArrow(total, "token int, met binary").toArrow()
    vectors = np.zeros((size, 2 * n_context), np.float32)
    for token, met in zip(*(c.to_pylist() for c in found.columns)):
        vectors[token] = np.frombuffer(met)
    model.group(np.arange(size), model.counts[:size], vectors)
    shared.destroy()


def fit(
    documents: DataFrame, counts: DataFrame, n_frequent: int = 200_000, sample_tokens: int = 240_000, sample_documents: int = 4_000, excerpt_chars: int = 20_000, **sizes
) -> tuple[Model, int, int]:
    """(model, N, V).  Counts, classes and the unit's weights are learned from all documents, whole texts.

    Where the weights start from is learned from about ``sample_tokens`` tokens, of at most
    ``sample_documents`` documents chosen by a hash of their doc_id; of a longer document an excerpt of
    ``excerpt_chars`` from a place that the hash chooses.  From there the tasks learn from all (see ``refine``).
    """
    import numpy as np

    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(totals[0]), int(totals[1])
    # Tokens met once or twice stay with the unseen ones, so that their class is learned from the corpus.
    top = counts.where("c > 2").orderBy(F.desc("c"), "word").limit(n_frequent).toArrow()
    model = Model([w.encode() for w in top.column("word").to_pylist()], top.column("c").to_pylist(), total, distinct, **sizes)
    n_documents = max(1, documents.count())
    share = max(1, total // max(1, 2 * sample_tokens))
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    most = max(50, 2 * n_documents // share)
    start = (F.floor(mixed / 4096) % F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1))).cast("int") + 1
    rows = documents.where(mixed % share == 0).orderBy(mixed).limit(min(most, sample_documents)).select(F.col("text").substr(start, F.lit(excerpt_chars))).collect()
    ids: list = []
    held = 0
    for (text,) in rows:
        if held < sample_tokens:
            ids.append(model.ids([END, *words_of(text)]))
            held += len(ids[-1])
    stream = np.concatenate([*ids, model.ids([END])])
    group_tokens(documents, model)
    model.finish()
    model.train(stream)
    refine(documents, model, 1)
    return model, total, distinct


def score(documents: DataFrame, train: DataFrame, batch_tokens: int = 1_000_000, **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``documents``.

    ``train``: the documents to learn from.  A null text is empty: one end token.  Repeated rows are
    scored each; with nothing to learn from, all counts are 0.  An empty table gives an empty result.
    """
    import pyarrow as pa

    counts = written(count_tokens(train), "token-counts")
    model, total, distinct = fit(train, counts, **options)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by n_frequent and n_input
    fields = "row_id long, doc_id long, n_tokens long, n_frequent long, base double, model double, rare array<string>, rare_n array<int>"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, made = shared.value, 0
        part, _ = task_label()
        n_words = len(m.words)

        def flush(doc_ids, streams, rare):
            nonlocal made
            scores = m.log10_of(streams)
            columns = [
                [(part << 36) + made + i for i in range(len(doc_ids))], doc_ids, [len(s) for s in streams],
                [int((s < n_words).sum()) for s in streams], [float(m.log_base[s].sum()) for s in streams], scores,
                [list(r) for r in rare], [list(r.values()) for r in rare],
            ]
            made += len(doc_ids)
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.binary()), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[6] = arrays[6].cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names)

        doc_ids, streams, rare, held = [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    words.append(END)
                    ids = m.ids(words)
                    doc_ids.append(doc_id)
                    streams.append(ids)
                    rare.append(Counter(words[i] for i in (ids == n_words).nonzero()[0].tolist()))
                    held += len(ids)
                    if held >= batch_tokens:
                        yield flush(doc_ids, streams, rare)
                        doc_ids, streams, rare, held = [], [], [], 0
        if doc_ids:
            yield flush(doc_ids, streams, rare)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(run, fields), "scored")

    # "c" of a frequent token never gets here; an unseen token has none.
    words = rows.select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row_id", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    words = words.join(counts, "word", "left")
    sums = words.groupBy("row_id").agg(
        F.sum("n").alias("n_rare"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_seen"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
    )
    n_rare, logs = F.coalesce("n_rare", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    import math

    return rows.join(sums, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n_rare * F.lit(model.log_every)).alias("base_score"),
        (F.col("model") + logs - n_rare * F.lit(math.log10(model.rare_mass))).alias("score"),
    )

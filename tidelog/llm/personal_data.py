"""Personal data: patterns with checks, and a linear-chain conditional random field that adds spans.

The field labels words; its features are word shapes of a word and its neighbours.  It is trained on
the small table ``LABELLED`` below and decoded by Viterbi over all words: a line is a sequence, and all
lines of a batch are decoded in step.  What a word's own features weigh is worked out once per distinct
word, and that of two neighbours' shapes once per pair.  Spans of the patterns stay as they are; the field
adds those that overlap none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_BUCKETS = 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match cannot start inside a run of digits, since it takes a run whole; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")

#: The labelled table: [kind:...] marks a span.
LABELLED = """
call me at [phone:555-123-4567] before noon
my number is [phone:(212) 555-0187] thanks
phone [phone:020 7946 0958] and ask for him
tel. [phone:0171-5550123] in the evening
mobile [phone:07700 900123] or leave word
fax [phone:(030) 5550 1234] only
reach us on [phone:+1 (415) 555-0132] any time
ring [phone:+44 20 7946 0018] today
téléphone [phone:01 70 18 55 55] merci
teléfono [phone:91 555 01 23] gracias
Telefon [phone:089 5550123] bitte
the desk is [phone:555-0144] inside
write to [email:jane.roe@example.com] please
mail [email:a_b@host] on the local net
contact [email:info@example.co.uk] for more
e-mail [email:k.muster@beispiel.de] danke
send it to [email:root@localhost] now
correo [email:juan@ejemplo.es] por favor
courriel [email:luc@exemple.fr] merci
ask [email:o'neil@example.org] about it
the server [ip:10.0.0.1] went down
from [ip:192.168.1.20] to the gateway
host [ip:172.16.254.3] port 443 open
ip [ip:8.8.8.8] answered
connect to [ip:203.0.113.77] over ssh
paid with card [card:4111 1111 1111 1111] yesterday
card number [card:5500-0000-0000-0004] on file
visa [card:4012888888881881] expires soon
charge [card:3782 822463 10005] again
carte [card:4222222222222] et code
Karte [card:6011 0009 9013 9424] gesperrt
the order 12345 was late
in 1999 there were 250 people
version 2.0.1 of the library
licensed under CC BY-NC 4.0 terms
the GNU General Public License version 3 applies
Apache License Version 2.0 applies here
chapter 12 verse 7 is read
it cost 19.99 and not 24.50
between 1914 and 1918 in Europe
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was here
key 9f86d081884c7d65 and more
on 2024-01-31 at 10:45 they met
the 3rd of May 2021 was warm
page 114 of 620 is torn
isbn 978-3-16-148410-0 was printed
serial 1234567890123456 of the box
room 101 on floor 3
@home and @work are tags
follow @someone for news
5 @ 3 euros each
about 1,000,000 rows in 7 files
item 00042 row 17 col 9
the words of this line have no number at all
and this one is plain prose too
""".strip().splitlines()


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[::2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in odd[1::2]) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (free := m.end())
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost matches per kind; a match that fails its check goes."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(word: str) -> str:
    """Digits to 9, letters to a or A, runs of letters and of more than four digits shortened."""
    flat = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word))
    return re.sub(r"9{5,}", lambda m: "9" * 5 + ("+" if len(m[0]) > 9 else ""), re.sub(r"([aA])\1+", r"\1", flat))


def _plain(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()")


def _own(word: str) -> tuple[str, ...]:
    """Features of a word alone, beside its shape."""
    d = _digits(word)
    at = "@" in word and len(word) > 2 and not word.startswith("@")
    return (
        f"d={min(len(d), 20)}", f"@={at}", f"dots={min(word.count('.'), 4)}", "bias",
        f"c={'x' if 12 <= len(d) <= 19 and luhn(d) else ''}", f"hex={bool(d) and any(c in 'abcdef' for c in word)}",
    )


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % _BUCKETS


def features(words: list[str]) -> list[list[int]]:
    """Hashed features per word: its own shape, size and marks, and its neighbours' shapes and words."""
    plain, shapes = ["<s>", *map(_plain, words), "</s>"], ["<s>", *map(shape, words), "</s>"]
    out = []
    for i, w in enumerate(words, 1):
        near = [f"p={shapes[i - 1]}", f"n={shapes[i + 1]}", f"pw={plain[i - 1]}", f"ps={shapes[i - 1]}|{shapes[i]}", f"sn={shapes[i]}|{shapes[i + 1]}"]
        out.append([_bucket(x) for x in (f"s={shapes[i]}", *_own(w), *near)])
    return out


class Weights:
    """What the features of words weigh for each label, worked out once per distinct word, shape and pair of shapes.

    ``lines(words)`` are the emission scores of all words of all lines; at most ``remember`` words are kept.
    """

    def __init__(self, emit, remember: int = 200_000):
        import numpy as np

        self._emit, self._most = np.asarray(emit, np.float64), remember
        self._forget()

    def _forget(self) -> None:
        self._word: dict[str, int] = {}
        self._shape_of, self._own_of, self._plain_of = [], [], []
        self._shapes: dict[str, int] = {}
        self._kinds: dict[tuple, int] = {}
        self._pairs: dict[int, int] = {}
        self._own, self._prev, self._next, self._both = [], [], [], []
        for edge in ("<s>", "</s>"):
            self._add(edge, edge, edge, ())

    def _add(self, word: str, plain: str, own_shape: str, own: tuple) -> int:
        e, at = self._emit, len(self._shape_of)
        if (sid := self._shapes.get(own_shape)) is None:
            sid = self._shapes[own_shape] = len(self._shapes)
            self._prev.append(e[_bucket(f"p={own_shape}")])
            self._next.append(e[_bucket(f"n={own_shape}")])
        if (kid := self._kinds.get((sid, own))) is None:
            kid = self._kinds[sid, own] = len(self._kinds)
            self._own.append(sum((e[_bucket(f)] for f in own), e[_bucket(f"s={own_shape}")]))
        self._shape_of.append(sid)
        self._own_of.append(kid)
        self._plain_of.append(_bucket(f"pw={plain}"))
        if at > 1:
            self._word[word] = at
        return at

    def _learn(self, word: str) -> int:
        bare = word.rstrip(".,;:!?")
        if bare.isascii() and bare.isalpha() and (bare.islower() or bare[1:].islower()):
            own_shape = ("a" if bare[0].islower() else "Aa" if len(bare) > 1 else "A") + word[len(bare) :]
        else:
            own_shape = shape(word)
        return self._add(word, _plain(word), own_shape, _own(word))

    def lines(self, lines: list[list[str]]):
        """(scores of all words, one line after another; the lines' numbers of words)."""
        import numpy as np

        if len(self._word) > self._most:
            self._forget()
        look, flat = self._word.get, []
        for words in lines:
            found = list(map(look, words))
            if None in found:
                for i, at in enumerate(found):
                    if at is None:
                        at = look(words[i])
                        found[i] = self._learn(words[i]) if at is None else at
            flat.append(0)
            flat += found
            flat.append(1)
        ids, sizes = np.array(flat, np.int64), np.array([len(w) for w in lines], np.int64)
        here = np.flatnonzero(ids > 1)
        shape_of, names = np.array(self._shape_of), list(self._shapes)
        sid = shape_of[ids]
        left, code = sid[here - 1], sid[:-1] << 32 | sid[1:]
        wanted = np.unique(np.concatenate([code[here - 1], code[here]]))
        for c in wanted.tolist():
            if c not in self._pairs:
                a, b = names[c >> 32], names[c & 0xFFFFFFFF]
                self._pairs[c] = len(self._both)
                self._both.append((self._emit[_bucket(f"ps={a}|{b}")], self._emit[_bucket(f"sn={a}|{b}")]))
        rows = np.array([self._pairs[c] for c in wanted.tolist()], np.int64)
        pair = rows[np.searchsorted(wanted, code)] if len(wanted) else np.zeros(len(code), np.int64)
        both = np.array(self._both).reshape(-1, 2, self._emit.shape[1])
        scores = np.array(self._own)[np.array(self._own_of)[ids[here]]]
        scores += np.array(self._prev)[left]
        scores += np.array(self._next)[sid[here + 1]]
        scores += self._emit[np.array(self._plain_of)[ids[here - 1]]]
        scores += both[pair[here - 1], 0]
        scores += both[pair[here], 1]
        return scores, sizes


def viterbi(scores, sizes, move):
    """Labels of all words: ``scores`` line after line, ``sizes`` words in each; lines leave as they end."""
    import numpy as np

    out = np.zeros(len(scores), np.int8)
    if not len(scores):
        return out
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    bound = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(bound), side="left")
    back = np.zeros((len(scores), scores.shape[1]), np.int8)
    best = scores[starts[: active[0]]]
    state = np.zeros(len(sizes), np.int64)
    for t in range(bound):
        n = active[t]
        at = starts[:n] + t
        if t:
            before, came = best[:n], np.zeros((n, scores.shape[1]), np.int8)
            best = before[:, :1] + move[0]
            for k in range(1, len(move)):  # the first of equal ways stands
                way = before[:, k : k + 1] + move[k]
                better = way > best
                np.copyto(best, way, where=better)
                np.copyto(came, np.int8(k), where=better)
            back[at] = came
            best += scores[at]
        ended = active[t + 1] if t + 1 < bound else 0
        state[ended:n] = best[ended:n].argmax(1)
    for t in range(bound - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = state[:n]
        state[:n] = np.where(t < sizes[:n], back[at, state[:n]], state[:n])
    return out


class Field:
    """Emission weights per feature and label, and transition weights."""

    def __init__(self, steps: int = 120, rate: float = 0.15, decay: float = 1e-3):
        import numpy as np

        rows = [self._read(line) for line in LABELLED]
        n = len(LABELS)
        self.emit, self.move = np.zeros((_BUCKETS, n)), np.zeros((n, n))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move)]
        for t in range(1, steps + 1):
            grads = [decay * self.emit, decay * self.move]
            for feats, gold in rows:
                self._gradient(np.array(feats), np.array(gold), grads)
            for p, g, (m, v) in zip((self.emit, self.move), grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    @staticmethod
    def _read(line: str) -> tuple[list[list[int]], list[int]]:
        words, gold = [], []
        for m in re.finditer(r"\[(\w+):([^\]]*)\]|\S+", line):
            parts = m[2].split() if m[1] else [m[0]]
            words += parts
            gold += [LABELS.index(f"{'I' if k else 'B'}-{m[1]}") if m[1] else 0 for k in range(len(parts))]
        return features(words), gold

    def _gradient(self, feats, gold, grads) -> None:
        """Adds the gradient of the negative log-likelihood: forward-backward over one row."""
        import numpy as np

        score = self.emit[feats].sum(1)
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[0] = score[0]
        for i in range(1, len(score)):
            fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + self.move, 0) + score[i]
        for i in range(len(score) - 2, -1, -1):
            bwd[i] = np.logaddexp.reduce(self.move + score[i + 1] + bwd[i + 1], 1)
        total = np.logaddexp.reduce(fwd[-1])
        node = np.exp(fwd + bwd - total)
        node[np.arange(len(gold)), gold] -= 1
        for k in range(feats.shape[1]):
            np.add.at(grads[0], feats[:, k], node)
        for i in range(1, len(score)):
            grads[1] += np.exp(fwd[i - 1][:, None] + self.move + score[i] + bwd[i] - total)
            grads[1][gold[i - 1], gold[i]] -= 1

    def decode(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Viterbi over all sequences in step; they leave as they end."""
        import numpy as np

        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in order])
        out: list[list[int]] = [[] for _ in sequences]
        if not sizes.size or not sizes[0]:
            return out
        best = back = None
        pointers, last = [], np.zeros(len(order), int)
        for t in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            here = self.emit[np.array([sequences[i][t] for i in order[:n]])].sum(1)
            if t:
                ways = best[:n, :, None] + self.move
                back = ways.argmax(1)
                here = here + ways.max(1)
                pointers.append(back)
            ended = np.arange(n)[sizes[:n] == t + 1]
            last[ended] = here[ended].argmax(1)
            best = here
        for row, i in enumerate(order):
            state, path = int(last[row]), []
            for t in range(int(sizes[row]) - 1, -1, -1):
                path.append(state)
                if t:
                    state = int(pointers[t - 1][row, state])
            out[i] = path[::-1]
        return out


def _accepted(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+", found))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", found)) and all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and not re.search(r"[^\W\d_]", found)


def _trimmed(text: str, start: int, end: int, kind: int) -> list[tuple[int, int]]:
    """The stretch without the marks around it, if it can be of the kind."""
    raw = text[start:end]
    left = len(raw) - len(raw.lstrip(".,;:!?\"'<>[]{}#&*%$|=" + ("" if kind == 3 else "(")))
    right = len(raw.rstrip(".,;:!?\"'<>[]{}#&*%$|=()"))
    return [(start + left, start + right)] if left < right and _accepted(KINDS[kind], raw[left:right]) else []


def find(texts: list[str], field: Field, weights: Weights) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    import numpy as np

    base = [base_spans(t) if re.search("[0-9@]", t) else [] for t in texts]
    lines, owner = [], []
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            if words := line.split():
                lines.append(words)
                owner.append(i)
    added: list[list] = [[] for _ in texts]
    scores, sizes = weights.lines(lines)
    labels = viterbi(scores, sizes, field.move)
    ends = np.cumsum(sizes)
    words_before = np.zeros(len(texts), np.int64)  # of each text in the batch
    np.add.at(words_before, np.array(owner, np.int64), sizes)
    words_before = np.cumsum(words_before) - words_before
    places: dict[int, list] = {}
    marked = np.searchsorted(ends, np.flatnonzero(labels), side="right")
    for k in np.unique(marked).tolist():  # lines with a label other than O
        i, first = owner[k], int(ends[k] - sizes[k])
        if i not in places:
            places = {i: list(_WORD.finditer(texts[i]))}
        words = places[i][first - int(words_before[i]) : int(ends[k]) - int(words_before[i])]
        path, at = labels[first : ends[k]].tolist(), 0
        while at < len(path):
            if path[at] == 0:
                at += 1
                continue
            kind, begin = (path[at] - 1) // 2, at
            at += 1
            while at < len(path) and path[at] == 2 * kind + 2:
                at += 1
            # A labelled run that is no such thing as a whole may be several, a word each.
            if not (runs := _trimmed(texts[i], words[begin].start(), words[at - 1].end(), kind)):
                runs = [x for m in words[begin:at] for x in _trimmed(texts[i], m.start(), m.end(), kind)]
            added[i] += [(x, kind, y) for x, y in runs if all(y <= a or x >= b for a, _, b in base[i])]
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(documents: DataFrame, batch_bytes: int = 3_000_000) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans), a row per document.

    The counts are of the patterns' spans; ``spans`` has those and what the field adds.  Offsets are
    code points, ends exclusive.  A null text is empty; null doc_ids and repeated rows come back as
    they are; an empty table gives an empty result.  A task holds ``batch_bytes`` of text at a time, or one
    longer text.
    """
    import pyarrow as pa

    field = documents.sparkSession.sparkContext.broadcast(Field())  # its size is fixed by _BUCKETS
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(field.value.emit)
        for batch in batches:
            start = 0
            sizes = batch.column(1).cast(pa.binary()).to_pylist() if batch.num_rows else []
            while start < batch.num_rows:
                end, held = start, 0
                while end < batch.num_rows and (end == start or held + len(sizes[end] or b"") <= batch_bytes):
                    held += len(sizes[end] or b"")
                    end += 1
                found = find([t or "" for t in batch.column(1).slice(start, end - start).to_pylist()], field.value, weights)
                columns: list[list] = [[] for _ in names[1:]]
                for base, every in found:
                    counts = [0] * len(KINDS)
                    for _, kind, _ in base:
                        counts[kind] += 1
                    for column, v in zip(columns, (*counts, joined(base), joined(every))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)
                start = end

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")

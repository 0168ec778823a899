"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def similar(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    n = len(a & b)
    return 100 * n >= percent * (len(a) + len(b) - n)


def joined(sets: dict, percent: int = 80) -> dict:
    """Component (least key) of each key of {key: set}; by prefix filtering, exact."""
    uf = Sets(sets)
    counts = Counter(x for s in sets.values() for x in s)
    index: dict = {}
    for k in sorted(sets, key=lambda k: len(sets[k])):
        s = sets[k]
        if not s:
            continue
        order = sorted(s, key=lambda x: (counts[x], str(x)))
        prefix = order[: len(order) - math.ceil(percent * len(order) / 100 - 1e-9) + 1]
        for c in {c for x in prefix for c in index.get(x, ())}:
            if similar(s, sets[c], percent):
                uf.join(k, c)
        for x in prefix:
            index.setdefault(x, []).append(k)
    return {k: uf.find(k) for k in sets}


def shingles(text, size: int) -> frozenset:
    w = SPACE_WORD.findall(lower(text or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < size else frozenset(zip(*(w[k:] for k in range(size))))


def near(docs: dict, size: int) -> dict:
    return joined({i: shingles(t, size) for i, t in docs.items()})


def repeated(docs: dict) -> set:
    """Places (doc_id, position) of lines to drop."""
    places: dict = {}
    for i, t in docs.items():
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                places.setdefault(line, []).append((i, p))
    grams = {min(v): frozenset([x]) if len(x) < 5 else frozenset(x[k : k + 5] for k in range(len(x) - 4)) for x, v in places.items()}
    of = joined(grams)
    return {p for v in places.values() for p in v if p != of[min(v)]}


def hits(text, items: dict, window: int = 10):
    """(n_words, n_hit, item_ids) of a text."""
    wanted: dict = {}
    for i, t in items.items():
        w = TEST_WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(i)
    words, hit, found = TEST_WORD.findall(lower(text or "")), set(), set()
    for n in {len(k) for k in wanted}:
        for k in range(len(words) - n + 1):
            if own := wanted.get(tuple(words[k : k + n])):
                hit.update(range(k, k + n))
                found |= own
    return len(words), len(hit), sorted(map(str, found))


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def personal(t: str) -> list:
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()

"""Exact tokenizers encodings, with the encodings of frequent pieces remembered.

A text is cut only where the vocabulary's own pre-tokenizer is certain to cut too, so the ids of the
pieces, one after another, are the ids of the text.  Any text in which that is not certain (runs of
blanks, unusual white space, control characters, special tokens) goes to the tokenizer whole.  Of the
pieces not remembered, a run of Latin letters or of ASCII marks is one word to the pre-tokenizer and
goes to the vocabulary's model directly; every other piece goes to the tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

from .shared import remembered

#: Bytes of texts that need no closer look: printable ASCII, line feed, and UTF-8 of U+00C0 to U+024F.
_PLAIN = bytes([10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
#: White space (by either library's notion) other than blank and line feed, NUL, joiners, and the one
#: letter of the Latin blocks whose lower case ends in a mark.
_ODD = re.compile("[" + "".join(map(chr, (0x00, 0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x0130, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")
#: Characters past the Latin blocks, where lower-casing and composition may interact.
_PAST_LATIN = re.compile("[ɐ-\U0010ffff]")
#: Punctuation that ends a run of Latin letters before it.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: One word to either pre-tokenizer (an apostrophe may start a contraction).
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@[-`{-~]+")
#: What a remembered piece takes besides its ids, in bytes, about.
_EACH = 170


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Remembered pieces; asks ``learn`` for one that is missing."""

    def __init__(self, learn):
        self._learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self._learn(chunk)


class Encoder:
    """``encode_batch(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    Special tokens in a text become their ids, as in the library's plain call.  The remembered pieces
    take at most about twice ``remember_bytes``, whatever the corpus: when one generation is full it
    becomes the old one, and of that only what comes again is kept.
    """

    def __init__(self, vocabulary: str, remember_bytes: int = 80 << 20, piece_chars: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._special = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._blank = self._tokenizer.normalizer is None  # byte-level: a blank belongs to the word after it
        self._feed = self._ids("\n")
        self._now, self._old, self._leave = _Known(self._learn), {}, []
        self._held, self._most, self._piece_chars = 0, remember_bytes, piece_chars

    def _ids(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, text: str) -> list[str] | None:
        """Chunks of a text; None if it has to be encoded whole."""
        plain = not text.encode().translate(None, _PLAIN) and "\u0130" not in text
        if not plain and _ODD.search(text) or any(s in text for s in self._special):
            return None
        if not self._blank:
            return (text.lower() if plain or not _PAST_LATIN.search(text) else text).split()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in " \n" or text[:1] in " \n":
            return None
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = "\x00" + chunks[0]  # the only chunk with no blank or line feed before it
        return chunks

    def _encode(self, piece: str) -> bytes:
        """Ids of a piece; it starts with NUL if no blank is before it (byte-level only)."""
        lead = self._blank and piece[0] != "\x00"
        text = piece[1:] if self._blank and not lead else piece
        if text.isascii() and text.isalpha() and (self._blank or text.islower()):
            data = "\u0120" + text if lead else text
            return array("I", [t.id for t in self._model.tokenize(data)]).tobytes()
        if not _WORD.fullmatch(text) or not self._blank and text != text.lower():
            return self._ids(" " + text if lead else text)
        data = (" " + text if lead else text).encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(data)]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk that is not in the newer generation, where it is put."""
        now, old, most = self._now, self._old, self._piece_chars
        if (ids := old.get(chunk)) is None and chunk.isalpha():  # nothing before it and no marks after it: most chunks
            if chunk.isascii() and (self._blank or chunk.islower()):
                found = self._model.tokenize("\u0120" + chunk if self._blank else chunk)
                ids = b"".join([t.id.to_bytes(4, "little") for t in found])
            else:
                ids = self._encode(chunk)
        elif ids is None:
            blank = self._blank
            nul = "\x00" if blank else ""
            fed = blank and chunk[0] == "\n"
            word, marks = nul + chunk[1:] if fed else chunk, ""
            bare = word.rstrip(_MARKS)
            if len(bare) < len(word) and bare and bare[-1].isalpha() and bare[-1] < "\u0250":
                word, marks = bare, nul + word[len(bare) :]
            if not fed and not marks:
                ids = self._encode(word)
            else:
                if (ids := now.get(word) or old.get(word)) is None:
                    ids = self._encode(word)
                    if len(word) <= most:
                        now[word] = ids
                        self._held += len(ids) + _EACH
                    self._leave.append(chunk)  # only a word met for the second time is likely to come again with marks
                if marks:
                    if (tail := now.get(marks) or old.get(marks)) is None:
                        tail = self._encode(marks)
                        if len(marks) <= most:
                            now[marks] = tail
                            self._held += len(tail) + _EACH
                    ids += tail
                if fed:
                    ids = self._feed + ids
        now[chunk] = ids
        self._held += len(ids) + _EACH
        if len(chunk) > most:
            self._leave.append(chunk)
        return ids

    def encode_batch(self, texts: list[str], block: int = 256) -> list[bytes]:
        """Memory beside the result: the remembered pieces and one text's chunks."""
        out: list[bytes] = []
        for start in range(0, len(texts), block):
            if self._held > self._most:
                self._old, self._now, self._held = self._now, _Known(self._learn), 0
            known = self._now.__getitem__
            for text in texts[start : start + block]:
                chunks = self._split(text)
                out.append(self._ids(text) if chunks is None else b"".join(map(known, chunks)))
            for chunk in self._leave:
                if (ids := self._now.pop(chunk, None)) is not None:
                    self._held -= len(ids) + _EACH
            self._leave.clear()
        return out


def encoder_for(vocabulary: str) -> Encoder:
    """The worker process's own encoder: what one task learned serves the next."""
    return remembered(("encoder", vocabulary), lambda: Encoder(vocabulary))

"""Token ids of whole texts through the tokenizers library, cached by chunk.

A text is cut where the tokenizer's own pre-tokenizer always cuts (so that ids
of the chunks, joined, are the ids of the text), and ids of chunks seen before
come from a bounded cache in the worker. Tokenizers of other kinds than the
two known here encode whole texts.
"""

from __future__ import annotations

import json
import re
from functools import cache
from struct import pack

import numpy as np

CACHE_CHUNKS = 400_000
_JOINED = re.compile(r"(?:^|\s) ")
#: Latin letters that normalisation keeps and whose lower case is one letter.
_L = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_P = r"[.,!?;:*$%&#|)\]}]+"
#: A word, punctuation, and the same again after a line end.
_PLAIN = re.compile(f"({_L})?({_P})?(?:(?<!^)(\n)(?!$)({_L})?({_P})?)?")


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the others as the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_chars()
_MARKS = frozenset(".,!?;:*$%&#|)]}")


class _Little(dict):
    """Ids as four bytes; there are no more than a vocabulary has."""

    def __missing__(self, i: int) -> bytes:
        self[i] = b = pack("<I", i)
        return b


_LITTLE = _Little()


class _Chunks(dict):
    """Chunk to little-endian uint32 ids; a miss asks the tokenizer. Holds two generations of CACHE_CHUNKS at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


def _caseless(norm: dict) -> bool:
    """Whether the Replace step of the normalizer has no letter in its pattern, which it reads before Lowercase."""
    replaced = [n["pattern"] for n in norm["normalizers"] if n["type"] == "Replace"]
    return not any(c.isalpha() for p in replaced for c in "".join(p.values()).replace("\\s", ""))


class Encoder:
    """ids(text) as little-endian uint32 bytes, equal to encode(text, add_special_tokens=False).

    Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre, norm = form.get("pre_tokenizer") or {}, form.get("normalizer")
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        self.lower = False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.ids = self._by_spaces
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.ids, self.lower = self._by_words, True
        else:
            self.ids = self._whole
        #: A-Z may be lowered first where nothing else in the normalizer tells cases apart.
        self.ascii_lower = self.lower and _caseless(norm)
        self.bare, self.spaced = _Chunks(self._bare), _Chunks(self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_words(self, text: str) -> bytes:
        """White space is in no token: chunks lie between spaces and line ends. Of ASCII texts both cases of a word are one chunk."""
        if self.ascii_lower and text.isascii():
            text = text.lower()
        return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))

    def _by_spaces(self, text: str) -> bytes:
        """A token holds a space only at its start or in a run of white space: cut before a space that follows anything else."""
        first, *parts = text.split(" ")
        if _JOINED.search(text):
            merged, cut = [first], parts
            for p in cut:
                if (last := merged[-1]) and not last[-1].isspace():
                    merged.append(p)
                else:
                    merged[-1] = f"{last} {p}"
            first, *parts = merged
        return self._bare(first) + b"".join(map(self.spaced.__getitem__, parts))

    def _word(self, word: str, before: str) -> bytes:
        """Ids of one word of Latin letters, which the pre-tokenizer leaves whole."""
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(_BYTES.__getitem__, word.encode()))
        return b"".join([_LITTLE[t.id] for t in self.model.tokenize(before + word)])

    def _bare(self, chunk: str) -> bytes:
        if chunk.isascii():  # most are letters alone, or with one mark: no need for the pattern
            if chunk.isalpha():
                return self._word(chunk, "")
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                return self.bare[chunk[:-1]] + self.bare[chunk[-1]]
        if not (m := _PLAIN.fullmatch(chunk)):
            return self._whole(chunk)
        word, marks, end, word2, marks2 = m.groups()
        if not (marks or end):
            return self._word(word, "") if word else b""
        if not (word or end):
            return self._whole(chunk)
        return b"".join(self.bare[x] for x in (word, marks) if x) + (self._after(end, word2, marks2) if end else b"")

    def _spaced(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if not m or not m[1] and (not m[2] or m[3]):
            return self._whole(f" {chunk}")
        word, marks, end, word2, marks2 = m.groups()
        if not word:
            return self._whole(f" {marks}")
        if not (marks or end):
            return self._word(word, _BYTES[32])
        return self.spaced[word] + (self.bare[marks] if marks else b"") + (self._after(end, word2, marks2) if end else b"")

    def _after(self, end: str, word: str | None, marks: str | None) -> bytes:
        """The line end and what follows it; at a chunk's end or start line ends may join other white space, so those chunks are whole."""
        if not (word or marks):
            raise ValueError("a line end at a chunk's end")
        return b"".join(self.bare[x] for x in (end, word, marks) if x)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    return Encoder(path)

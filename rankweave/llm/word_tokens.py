"""Exact token ids of a ``tokenizers`` file with a lower-casing word BPE, at several times the library's speed.

The library spends most of its time on normalising and splitting.  For Latin-1 text, which normalisation leaves alone
and whose classes and lower case are the same in every Unicode version, the split is a plain pattern here, and the library's model encodes each distinct word once; the words are kept up to a bound.  Any other
text, and one that spells a special token, goes through the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

CACHED_WORDS = 80_000  # in each of two generations, together about 32 MB a Python worker
LONGEST_CACHED = 64

# The normaliser and the split that the plain way stands for.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_split() -> re.Pattern:
    """The split above for characters of Latin-1."""
    kinds = {"L": "", "N": "", "Z": "\t\n\v\f\r\x85"}
    for c in map(chr, range(256)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    letters, numbers, spaces = (re.escape(kinds[k]) for k in "LNZ")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level BPE: printable bytes for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Lower-case word -> its ids as bytes.  A full memory becomes the old generation, from which words come back when used."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        part = lambda p: json.loads(p.__getstate__()) if p is not None else {}
        split = [s.get("pattern", {}).get("Regex") for s in part(self.tokenizer.pre_tokenizer).get("pretokenizers", []) if s["type"] == "Split"]
        kinds = [n["type"] for n in part(self.tokenizer.normalizer).get("normalizers", [])]
        self.known_form = split == [SPLIT] and kinds == NORMALIZERS
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_in = dict(enumerate(_byte_letters()))

    def plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return self.known_form and not any(s in text for s in self.special)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self._encoded(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.stand_in)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


_SPLIT = _plain_split()


def encode_text(text: str, path: str, end_id: int | None = None) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers, with the end id after them if one is given."""
    words = _words(path)
    if words.plain(text):
        ids = b"".join(map(words.__getitem__, _SPLIT.findall(text.lower())))
    else:
        ids = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if end_id is not None:
        ids += int(end_id).to_bytes(4, "little")
    return np.frombuffer(ids, "<u4")

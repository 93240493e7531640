"""Token ids of whole texts, by the tokenizers library, with a memory for repeated words.

A tokenizer that drops white space and never lets a token cross it gives the same ids
for a text as for its space-separated chunks one after the other. Chunks recur, so each
Python worker keeps the ids of chunks that it has met, in two generations of ``MEMORY``
chunks each: what the older one has and is met again moves to the younger. Where the
tokenizer also lowers case and cuts between letters and signs, a text of Latin-1
characters is lowered and gets a space there first, so more chunks are alike. The
memory saves time only: the ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Chunks in a generation, the longest that is kept, in characters, and characters of texts that are worked on together.
MEMORY, LONGEST, GROUP = 120_000, 48, 4_000

# kinds of Latin-1 characters: letters and numbers, signs but for the apostrophe, and the rest
_KIND = np.zeros(256, np.uint8)
for _i in range(33, 256):
    if chr(_i).isalnum():
        _KIND[_i] = 1
    elif _i < 127 and _i != 39:
        _KIND[_i] = 2

# how byte-level tokenizers write bytes: printable ones as they are, the others from 256 on
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary) as f:
            told = json.load(f)
        normalizers = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers", [])]
        patterns = [(p.get("pattern") or {}).get("Regex", "") for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.words = normalizers == ["NFC", "Replace", "Lowercase"] and any(p.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for p in patterns) and "ByteLevel" in [p.get("type") for p in told["pre_tokenizer"]["pretokenizers"]]
        self.special = [t["content"][:2] for t in told.get("added_tokens", [])]
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        if self.words and not any(s in text for s in self.special):
            try:
                b = np.frombuffer(text.lower().encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                pass
            else:
                k = _KIND[b]
                at = np.flatnonzero((k[:-1] == 1) & (k[1:] == 2)) + 1
                text = np.insert(b, at, 32).tobytes().decode("latin-1")
        return text.replace("\n", " ").split(" ")

    def ids(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) without special tokens."""
        return self._group([text or ""])[0]

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; texts are worked on in groups of about ``GROUP`` characters."""
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        chunks = [self._chunks(t) for t in texts]
        young, old, tokenize = self.young, self.old, self.tokenizer.model.tokenize
        long: list[str] = []
        if missing := set().union(*chunks).difference(young):
            fresh = []
            for c in missing:
                known = old.get(c)
                if known is None:
                    fresh.append(c)
                else:
                    young[c] = known
            other = []
            for c in fresh:
                if c.isalpha() and c == c.lower() and max(c) < "\u0100":  # one word, as the model gets it: no need to normalise and cut
                    young[c] = array("I", [t.id for t in tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(_BYTES))]).tobytes()
                else:
                    other.append(c)
            for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
                young[c] = array("I", e.ids).tobytes()
            long += [c for c in fresh if len(c) > LONGEST]
        out = [b"".join(map(young.__getitem__, c)) for c in chunks]
        for c in long:
            del young[c]
        if len(young) > MEMORY:
            self.old, self.young = young, {"": b""}
        return out


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file; every node has the file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

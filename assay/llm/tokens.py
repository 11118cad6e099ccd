"""Token ids of whole texts, with the ids of repeated words kept in the worker.

A pre-token of the vocabularies used here never spans ASCII white space, so the ids of a text are the ids of its
white-space separated chunks in order.  A Python worker keeps the ids of the chunks it has met; what it keeps is bounded
and never changes a result.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

# Chunks whose ids a worker keeps, and the longest chunk that is kept.
KEPT_CHUNKS, KEPT_BYTES = 400_000, 64

# Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}

_ENCODERS: dict[str, "ChunkEncoder"] = {}


# Characters whose normal form, lower case and class are beyond doubt; other chunks go through the whole tokenizer.
_SIMPLE = re.compile("[\x21-\x7e\xa1-\u024f]*")

# The pattern that the vocabularies used here split by; a run of letters is one piece, and so is a mark after it, but for an apostrophe.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = frozenset(".,;:!?")


# A byte as its character; decoding by Latin-1 and translating takes no loop over the bytes.
_AS_CHARS = {b: c for b, c in _BYTE_CHARS.items() if chr(b) != c}


class _Made(dict):
    """Values by key, each made when it is first asked for; keys of more than ``longest`` go to ``long``, which its owner empties."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest, self.long = make, longest, {}

    def __missing__(self, key):
        if len(key) <= self.longest:
            value = self[key] = self.make(key)
        else:
            value = self.long.get(key)
            if value is None:
                value = self.long[key] = self.make(key)
        return value


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = _Made(self._chunk, KEPT_BYTES)
        self.pieces: dict[str, bytes] = _Made(self._piece, KEPT_BYTES)
        self.split = self._splitter(path)
        self.by_words = self.split is not None and self.split.__self__.pattern == _WORDS

    @staticmethod
    def _splitter(path: str):
        """The pre-tokens of a simple chunk, if the file lower-cases, splits by one pattern and maps bytes to characters."""
        import json

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return None
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        import regex

        return regex.compile(cuts[0]["pattern"]["Regex"]).findall

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_AS_CHARS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.by_words:
            low, mark = text.lower(), text[-1]
            word = low[:-1] if mark in _MARKS else low
            # Letters up to U+024F are simple; some, like a capital I with a dot, are no letters only in lower case.
            if word.isalpha() and (text.isascii() or max(text) <= "\u024f"):
                found = self.pieces[word]
                return found if word is low else found + self.pieces[mark]
        if self.split and _SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens of the tokenizer's own."""
        kept, pieces, out = self.kept, self.pieces, []
        of = kept.__getitem__
        for text in texts:
            if len(kept) > KEPT_CHUNKS:
                kept.clear()
            if len(pieces) > KEPT_CHUNKS:
                pieces.clear()
            # bytes.split() knows ASCII white space only
            out.append(b"".join(map(of, (text or "").encode().split())))
            kept.long.clear()
            pieces.long.clear()
        return out


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def document_ids(path: str, texts: list[str], end_id: int) -> list[np.ndarray]:
    """Ids of each text with ``end_id`` appended."""
    end = array("I", [end_id]).tobytes()
    return [np.frombuffer(raw + end, "<u4") for raw in encoder(path).encode(texts)]


def default_vocabulary() -> str:
    """Path of the 49k word vocabulary; any other ``tokenizers`` file can be named instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once while it is remembered."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from tonearc.llm.common import distinct_pieces, prefix, quiet_tokenizers, ragged, space_chunks

_GPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes chunks. Chunks of code points below U+0100 without a special string go straight to the library's BPE
    model, one pre-token at a time; all others through its whole pipeline."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str, remember: int = 300_000):
        quiet_tokenizers()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.tokenize = self.model.tokenize
        #: What all special strings have in common at their start.
        self.mark = os.path.commonprefix([x["content"] for x in spec["added_tokens"]])
        self.kind, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size(True) <= 65536 else (np.uint32, "I")
        self.lower = spec["normalizer"] is not None
        self.pattern = regex.compile(_CLIP if self.lower else _GPT)
        found = spec["pre_tokenizer"].get("use_regex") or any(_CLIP == p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", []))
        self.direct = bool(found) and spec["model"]["type"] == "BPE" and bool(self.mark)
        self.remember, self.young, self.old = remember, {}, {}

    @classmethod
    def of(cls, path: str, remember: int = 300_000) -> Encoder:
        """One a worker process; remember: pre-tokens that it keeps, twice over (some 200 bytes each)."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        cls._kept[path].remember = remember
        return cls._kept[path]

    def encode(self, piece: bytes) -> list[int]:
        if self.direct and piece[1:].isalpha() and piece[0] == 32:  # a space and ASCII letters, the most common kind
            return [t.id for t in self.tokenize(piece[1:].lower().decode() if self.lower else "Ġ" + piece[1:].decode())]
        text = piece.decode("utf-8", "replace")
        plain = text.isascii()
        if not self.direct or len(piece) > 256 or not (plain or max(text) < "Ā") or self.mark in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.lower:
            text = text.lower()
        one = text[1:].isalpha() and text[0] == " "
        found = ((text[1:] if self.lower else text),) if one else self.pattern.findall(text)
        ids: list[int] = []
        for word in found:
            word = word.replace(" ", "Ġ") if plain and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.tokenize(word)]
        return ids

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as uint16 or, if the vocabulary needs it, uint32."""
        young, old, encode, code = self.young, self.old, self.encode, self.code
        found = [young.get(p) for p in pieces]
        for k, x in enumerate(found):
            if x is None:
                p = pieces[k]
                x = old.get(p)
                found[k] = young[p] = array(code, encode(p)).tobytes() if x is None else x
        if len(young) > self.remember:
            self.old, self.young = young, {}
        return found

    def encode_rows(self, buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and where each row starts, one more than rows."""
        starts, ends, first = space_chunks(buf, rows)
        code, pieces = distinct_pieces(buf, starts, ends)
        found = self.many(pieces)
        size = np.array([len(x) for x in found], np.int64) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        each = size[code]
        return flat[ragged(prefix(size)[:-1][code], each)], prefix(each)[first]


def path(name: str) -> str:
    return public_tokenizers.path(name)

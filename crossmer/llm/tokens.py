"""Token ids of whole texts with a public tokenizer file.

Words repeat, so ids are remembered per white-space-free piece of text. This is
exact for tokenizers whose result on a text is the concatenation of their
results on the parts between spaces, tabs and line breaks, as for the word-level
BPE file used here (it drops white space before its merges).
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Sequence

import numpy as np

END_ID = 1
REMEMBERED = 400_000     # pieces held per Python worker: some 100 MB; then the store starts anew


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenEncoder:
    """Little-endian unsigned 32-bit ids of texts; null and empty texts have no ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._known: dict[str, bytes] = {}
        self._ends: dict[str, bytes] = {}
        self._letters = _byte_letters()
        rules = json.loads(self._tokenizer.to_str())
        self._lowers = any(step.get("type") == "Lowercase" for step in
                           (rules.get("normalizer") or {}).get("normalizers", []))

    def _full(self, parts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _learn(self, unknown: list[str]) -> None:
        """Ids of new pieces; a lower-case Latin-1 word is one pre-token and goes to the merges at once."""
        rest, known, tokenize = [], self._known, self._model.tokenize
        for piece in unknown:
            word = piece.rstrip(".,")
            if self._lowers and word.isalpha() and word == word.lower() and _latin(word):
                end = piece[len(word):]
                if end not in self._ends:
                    self._ends[end] = self._full([end])[0] if end else b""
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
                ids = [t.id for t in tokenize(letters)]
                known[piece] = _pack(ids) + self._ends[end]
            else:
                rest.append(piece)
        for start in range(0, len(rest), 10_000):
            part = rest[start:start + 10_000]
            known.update(zip(part, self._full(part), strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        split = [self._pieces(t) if t else () for t in texts]
        unknown = [p for p in set().union(*split) if p not in self._known]
        if unknown:
            if len(self._known) + len(unknown) > REMEMBERED:
                self._known.clear()
                unknown = list(set().union(*split))
            self._learn(unknown)
        known = self._known
        return [b"".join([known[p] for p in parts]) for parts in split]

    def _pieces(self, text: str) -> list[str]:
        if self._lowers and "<|" not in text and _latin(text):
            text = text.lower()     # in Latin-1 case is one letter to one, so this is the tokenizer's own step
        return text.replace("\n", " ").replace("\t", " ").split(" ")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + k for k, b in enumerate(others)}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """The worker's encoder of a tokenizer file; Spark reuses the worker for many tasks."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]

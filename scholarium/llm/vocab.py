"""Public vocabularies, with bounded caches for repeated words.

The vocabulary files stay where they are installed; their paths are parameters.
Everything here is a small per-task helper: Spark deals out the documents.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Entries of a cache before it starts anew: some 20 MB of words, in each of an executor's workers.
CACHE_ENTRIES = 100_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """A dict that computes missing values and never holds more than CACHE_ENTRIES."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = value
        return value


_TWO_BLANKS = re.compile(r"\s\s")


class ByteBpe:
    """Ids of the byte-level BPE vocabulary whose ranks stand at ``path``."""

    def __init__(self, path: str):
        self.path = path
        self.words = Cache(lambda word: self.packed(" " + word.decode("utf-8", "replace")))

    def _encoding(self, pattern: str):
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(f"byte_bpe_{len(pattern)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def encoding(self):
        import public_tokenizers

        return self._encoding(public_tokenizers.PATTERN)

    @cached_property
    def single(self):
        """For texts without two white-space characters in a row: only there the look-ahead matters, and without it cutting is much faster."""
        import public_tokenizers

        return self._encoding(public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))

    @cached_property
    def dtype(self) -> np.dtype:
        return np.dtype(np.uint16 if self.single.n_vocab <= 1 << 16 else np.uint32)

    def packed(self, text: str) -> bytes:
        encoding = self.encoding if _TWO_BLANKS.search(text) else self.single
        return array(self.dtype.char, encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        encoding = self.encoding if _TWO_BLANKS.search(text) else self.single
        return np.frombuffer(array(self.dtype.char, encoding.encode_ordinary(text)), self.dtype)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, each taken after a space."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.dtype)


class PieceBpe:
    """A SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.falls = Cache(lambda c: bool(self.is_byte[self.model.encode(c, num_threads=1)].any()) if c.strip() else False)

    def fallback_share(self, text: str) -> float:
        """Byte-fallback pieces by all pieces.  Only characters without a piece fall back; a text without any has share 0."""
        if not any(map(self.falls.__getitem__, set(text))):
            return 0.0
        ids = self.model.encode(text, num_threads=1)
        return float(self.is_byte[ids].mean()) if ids else 0.0


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def release() -> None:
    """Drop loaded vocabularies and their caches, at the end of a task."""
    byte_bpe.cache_clear()
    piece_bpe.cache_clear()

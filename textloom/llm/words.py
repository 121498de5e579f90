"""Hashed words of a text, for the operators that compare or score by words."""

from __future__ import annotations

import numpy as np

#: Words whose hash a worker remembers.
CACHE_WORDS = 100_000
_SPACE = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """uint64 hash of each word: lower case, cut at white space and ASCII punctuation."""
    words = text.lower().encode().translate(_SPACE).split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))

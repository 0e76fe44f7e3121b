"""Words of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: words a worker remembers; then it starts anew
CACHE = 200_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = WordHashes()


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without ASCII white space, in UTF-8 (A-Z lower-cased if
    ``lower``); a null text has none."""
    if not text:
        return []
    b = text.encode()
    return (b.lower() if lower else b).split()


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def distinct(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and the place of every word among them."""
    at = pa.array(found, pa.large_binary()).dictionary_encode().indices.to_numpy()  # numbered as they first come
    first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1)).tolist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(found.__getitem__, first)), np.uint64, len(first)), at


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts, A-Z lower-cased: the hashes of the distinct ones, the
    place of every word among them, and the number of words of every text.  The
    texts are gone through as one array of bytes."""
    raw = [t.encode() if t else b"" for t in texts]
    b = np.frombuffer(b"\n".join([*raw, b""]).lower(), np.uint8)  # a line end after every text
    space = (b == 32) | (b - np.uint8(9) < 5)
    inside = ~space
    first = np.flatnonzero(inside & np.concatenate([[True], space[:-1]])[:len(b)])
    last = np.flatnonzero(inside[:-1] & space[1:])
    offsets = np.concatenate([[0], np.cumsum(last + 1 - first)])
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])]).dictionary_encode()
    n, (_, at, data) = len(found.dictionary), found.dictionary.buffers()
    at = np.frombuffer(at, np.int64, n + 1).tolist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, map(memoryview(data).__getitem__, map(slice, at, at[1:]))), np.uint64, n)
    ends = np.searchsorted(first, np.cumsum([len(x) + 1 for x in raw]))
    return h, found.indices.to_numpy(), np.diff(ends, prepend=0)

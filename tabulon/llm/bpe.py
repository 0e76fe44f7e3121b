"""Token ids of whole texts with a public tokenizer file.

The tokenizer in question drops white space between pre-tokens, and neither
its normalizer nor its pre-tokenizer looks across ASCII white space, so the
ids of a text are the ids of its white-space separated chunks in order.  Every
worker keeps the ids of chunks seen, up to ``CACHE`` of them; then it starts
anew.  A chunk of plain letters followed by ASCII punctuation goes straight to
the library's BPE model, any other chunk through the whole tokenizer."""

from __future__ import annotations

import re

import numpy as np

CACHE = 700_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 up, in order."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ChunkCache(dict):
    """Chunk (bytes without ASCII white space) -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        letters = _byte_letters()
        self.spell = {i: letters[i] for i in range(256)}

    def part(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spell)
            got = self.parts[piece] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return got

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        m = _PLAIN.fullmatch(text)
        if m:
            word, marks = m.groups()
            ids = (self.part(word.lower()) if word else b"") + (self.part(marks) if marks else b"")
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


_CACHES: dict[str, ChunkCache] = {}


def chunk_cache(path: str) -> ChunkCache:
    """The worker's cache for a tokenizer file (kept between tasks)."""
    if path not in _CACHES:
        _CACHES[path] = ChunkCache(path)
    return _CACHES[path]


def encode(text: str | None, cache: ChunkCache) -> bytes:
    """Ids of a whole text, as little-endian uint32 bytes (null: none)."""
    return b"".join([cache[c] for c in text.encode().split()]) if text else b""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

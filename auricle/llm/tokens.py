"""Token ids of a public word-piece vocabulary, at the cost of its distinct chunks.

The vocabulary drops white space, never merges across it, and marks the last id of every pre-token.
So a text's ids are the ids of its space-separated chunks in order, a chunk's ids those of its
pre-tokens, and many distinct pre-tokens are encoded as one string that is cut at the marked ids.
A bounded cache keeps chunks from slice to slice.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import Words

CACHE_CHUNKS = 300_000
#: Pre-tokens of the vocabulary, for text whose other characters are letters (fixed value).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
_NOT_LETTERS = {c: None for c in range(128) if not chr(c).isalpha()}
WORD_END = "</w>"  # fixed value
#: Lower-case letters of Latin-1, which the vocabulary's normalizer leaves as they are.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


class Encoder:
    """ids of whole texts by the vocabulary file at ``path`` (at most 65,536 ids)."""

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids above 65,535 need a wider type")
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.limit, self.cache = cache, {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _pieces(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a chunk; None when it holds what only the tokenizer can classify."""
        if not chunk.isascii():
            if _PLAIN(chunk):
                return [chunk]
            chunk = self.tokenizer.normalizer.normalize_str(chunk)
        if chunk.isalpha():
            return [chunk]
        letters = chunk.translate(_NOT_LETTERS)
        if (letters and not letters.isalpha()) or not chunk.isprintable():
            return None
        return PIECES.findall(chunk)

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        cut = [self._pieces(c) for c in chunks]
        pieces = list({p for ps in cut if ps for p in ps})
        known: dict[str, bytes] = {}
        for i in range(0, len(pieces), 10_000):
            part = pieces[i : i + 10_000]
            coded = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(coded[0].ids, np.uint16)
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) != len(part):
                known.update((p, self._alone(p)) for p in part)
                continue
            raw, places = ids.tobytes(), [0, *(ends * 2).tolist()]
            known.update(zip(part, [raw[i:j] for i, j in zip(places, places[1:])]))
        return [
            self._alone(c) if ps is None else known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
            for c, ps in zip(chunks, cut)
        ]

    def _encode(self, keys: list[int], data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """ids of chunks known by their hashes; only those not in the cache are read and encoded."""
        out = [self.cache.get(k) for k in keys]
        missing = [i for i, ids in enumerate(out) if ids is None]
        spans = zip(starts[missing].tolist(), ends[missing].tolist())
        fresh = self._fresh([data[s:e].decode() for s, e in spans])
        for i, ids in zip(missing, fresh):
            out[i] = ids
        room = max(0, self.limit - len(self.cache))
        self.cache.update((keys[i], ids) for i, ids in zip(missing[:room], fresh))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 bounds)."""
        words = Words(texts)
        if not len(words.hashes):
            return np.zeros(0, np.uint16), np.zeros(len(words.bounds), np.int64)
        codes, distinct = pd.factorize(words.hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            known = self._encode(distinct.tolist(), words.data.tobytes(), words.starts[first], words.ends[first])
        finally:
            if collecting:
                gc.enable()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        ids = np.frombuffer(b"".join(known), np.uint16)
        lengths = sizes[codes]
        tokens = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=tokens[1:])
        shift = (np.cumsum(sizes) - sizes)[codes] - tokens[:-1]
        out = ids[np.repeat(shift, lengths) + np.arange(tokens[-1])]
        return out, tokens[words.bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

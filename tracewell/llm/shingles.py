"""Word n-grams as 64-bit hashes, and MinHash band signatures, in numpy batches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

from .worker import keeps

GRAM = 5
_RNG = np.random.default_rng(7)
_PLACE = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, kept for frequent ones."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


WORDS = WordHashes()
keeps("shingles", WORDS.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def grams(words: list[bytes], n: int = GRAM) -> np.ndarray:
    """Hashes of a text's n-grams in order; of a shorter text that of all its words, of an empty one none."""
    w = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if len(w) < n:
        return mixed((w * _PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))) if len(w) else w
    out = w[: len(w) - n + 1] * _PLACE[0]
    for j in range(1, n):
        out += w[j : len(w) - n + 1 + j] * _PLACE[j]
    return mixed(out)


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows a band for which pairs at the threshold are found with the recall, within so many hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.x = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band hashes, a row for each text; its n-grams are hashes from its start to the next's."""
        small = np.empty((len(starts), self.bands * self.rows), np.uint64)
        for k in range(self.bands * self.rows):
            v = hashes ^ self.x[k]
            v *= self.a[k]
            small[:, k] = np.minimum.reduceat(v, starts)
        small = small.reshape(len(starts), self.bands, self.rows)
        return mixed((small * self.c).sum(axis=2, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64))

    def of(self, texts: list[np.ndarray], block: int = 32_768) -> np.ndarray:
        """Signatures of texts that have n-grams; one with very many is taken in blocks."""
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > block:
                parts = [texts[at][i : i + block] for i in range(0, len(texts[at]), block)]
                small = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
                for p in parts:
                    for k in range(len(small)):
                        small[k] = min(small[k], ((p ^ self.x[k]) * self.a[k]).min())
                out.append(mixed((small.reshape(1, self.bands, self.rows) * self.c).sum(axis=2, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64)))
                at += 1
                continue
            stop, held = at, 0
            while stop < len(texts) and len(texts[stop]) <= block and (stop == at or held + len(texts[stop]) <= block):
                held += len(texts[stop])
                stop += 1
            sizes = np.array([len(t) for t in texts[at:stop]])
            out.append(self.signatures(np.concatenate(texts[at:stop]), np.cumsum(sizes) - sizes))
            at = stop
        return np.concatenate(out) if out else np.empty((0, self.bands), np.uint64)

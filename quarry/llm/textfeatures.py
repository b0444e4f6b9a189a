"""Hashed token features of many texts at once: one pass of numpy over the joined bytes of a batch, no loop per word.

A token is a maximal run of letters (A-Z, a-z, any byte from 128), of digits, or of other visible characters. The hash of a run
is the difference of two prefix sums of byte * BASE^position (mod 2^64), times BASE^-start: equal runs have equal hashes wherever they stand."""

import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
CHUNK_BYTES = 1 << 19

_SPACE = re.compile(rb"\s")

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[[32, 9, 10, 11, 12, 13, 0]] = 0
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Tokens:
    """Tokens of a list of byte strings. start, end: places in the joined bytes; doc: number of the byte string; kind; hash of the
    lower-cased token; shape: 1 lower, 2 Title, 3 UPPER, 4 digits, else a hash of the characters."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        self.raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        kind = _KIND[self.raw]
        edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        ends = np.concatenate((edge[1:], [len(kind)]))
        seen = kind[edge] > 0
        self.start, self.end = edge[seen], ends[seen]
        self.kind = kind[self.start]
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        n = len(self.raw)
        low = _LOWER[self.raw]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n))))
        self._sums, self._back = sums, _powers(UNBASE, n)[self.start]
        self.hash = self._hashed(self.end)
        upper = np.concatenate(([0], np.cumsum((self.raw >= 65) & (self.raw <= 90))))
        caps = upper[self.end] - upper[self.start]
        size = self.end - self.start
        shape = np.where(caps == 0, 1, np.where((caps > 1) & (caps * 2 > size), 3, 2)).astype(np.uint64)
        self.shape = np.where(self.kind == 1, shape, np.where(self.kind == 2, np.uint64(4), self.hash))

    def _hashed(self, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[self.start]) * self._back)

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first size bytes of each token, and which tokens are longer than that."""
        return self._hashed(np.minimum(self.start + size, self.end)), self.end - self.start > size


def chunks(texts: list[bytes]):
    """(first, last) places of runs of texts of about CHUNK_BYTES; a longer text comes alone."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def pieces(text: bytes, ends: re.Pattern, size: int = CHUNK_BYTES):
    """(begin, end, whole) of stretches of at most size bytes that cover a text, each cut after the last match of ends in it, else after its last
    white space, else anywhere. whole: whether the stretch ends at a match of ends or with the text."""
    at = 0
    while len(text) - at > size:
        part = text[at : at + size]
        stop = max((m.end() for m in ends.finditer(part)), default=0)
        cut = stop or max((m.end() for m in _SPACE.finditer(part)), default=size)
        yield at, at + cut, bool(stop)
        at += cut
    yield at, len(text), True

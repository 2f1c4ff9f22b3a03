"""64-bit hashes of words and of word n-grams, computed over whole buffers of UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: bytes of text looked at together in a task
BYTES_AT_ONCE = 2 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of a hash spread once more."""
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def power(n: int, base: int = int(MULTIPLIER)) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHashes:
    """Hashes of byte ranges of a buffer: equal bytes have equal hashes wherever they stand."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(int(MULTIPLIER), n), powers(pow(int(MULTIPLIER), -1, 1 << 64), n)

    def load(self, raw: np.ndarray) -> None:
        if len(raw) + 1 > len(self.up):
            self._grow(len(raw) + 1)
        self.upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.upto[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.upto[ends] - self.upto[starts]) * self.down[starts])

    def words(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word."""
        raw = np.frombuffer(buffer, np.uint8)
        self.load(raw)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], self.of(edge[::2], edge[1::2])


def portions(texts: list[bytes], most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``most`` bytes; a longer text comes alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def documents_of_words(hasher: SpanHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its document, first word of each document and the end) over the texts joined."""
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = hasher.words(b" ".join(texts) + b" ")
    first = np.searchsorted(starts, begin)
    return hashes, np.repeat(np.arange(len(texts)), np.diff(first)), first


def texts_of(batch: pa.RecordBatch, lower: bool = False) -> list[bytes]:
    """The column ``text`` as bytes; null counts as empty."""
    rows = batch["text"].to_pylist()
    return [(t or "").lower().encode() for t in rows] if lower else [(t or "").encode() for t in rows]

"""Vectorised words and hashes of many texts at once, for use inside tasks.

A batch of texts becomes one byte array. Any substring's 64-bit hash comes from prefix sums of a polynomial in an odd base,
so hashing costs a few array operations a byte, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 2 << 20  # texts handled at once; a longer text is a part of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


class Sums:
    """Hashes of any run of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, seed: int):
        base = 0x5851F42D4C957F2D + 16 * seed  # odd
        inverse = pow(base, -1, 1 << 64)
        n = len(values)
        terms = powers(base, n)
        terms *= values
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.total[1:])
        del terms
        self.back = powers(inverse, n + 1)
        self.seed = np.uint64(seed)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[start:end]; runs of other lengths differ."""
        h = (self.total[end] - self.total[start]) * self.back[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + self.seed)


def byte_values(buffer: np.ndarray, seed: int) -> np.ndarray:
    """A fixed 64-bit value per byte."""
    return mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1))[buffer]


SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of some texts: `start`, `end` in `buffer`, and `doc`, the number of the text."""

    def __init__(self, texts: Sequence[bytes], separators: np.ndarray = SPACE_BYTES):
        self.bytes = b"\n".join([*texts, b""])
        self.buffer = np.frombuffer(self.bytes, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])
        gap = separators[self.buffer]
        gap[self.doc_start[1:] - 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        #: The number of the first word of each text, and behind the last the number of words.
        self.first = np.searchsorted(self.start, self.doc_start)

    def hashes(self, seed: int) -> np.ndarray:
        return Sums(byte_values(self.buffer, seed), seed).of(self.start, self.end)


def parts(texts: Iterable[str | None], size: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts in UTF-8 of about `size` bytes, each with the number of its first text; null as empty."""
    run, at, used = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and used + len(b) > size:
            yield at, run
            run, at, used = [], i, 0
        run.append(b)
        used += len(b)
    if run:
        yield at, run


def slices(column: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of an Arrow column of texts with about `size` bytes, read from its offsets alone."""
    n = len(column)
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), np.int64) + 16)
    at = 0
    while at < n:
        used = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, used + size, "right")))
        yield at, stop - at
        at = stop


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of at most `size` bytes, each cut after its last line end, else its last white space, else anywhere."""
    at = 0
    while len(text) - at > size:
        found = [text.rfind(c, at, at + size) for c in (b"\n", b" ")]
        cut = next((k for k in found if k > at), at + size - 1) + 1
        yield text[at:cut]
        at = cut
    yield text[at:]

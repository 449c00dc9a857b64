"""Vectorised word scanning of Arrow string columns.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).  Those bytes
never occur inside a multi-byte UTF-8 sequence, so scanning bytes gives the same words as
scanning code points.  Every function here works on a *block*: consecutive rows of one Arrow
batch of about ``BLOCK_BYTES`` bytes (one longer row is a block of its own), which bounds the
memory of a task whatever the batch holds.

Word and window identities are 64-bit fingerprints.  A word's mixes its bytes in eights, one
after the other, and a window's mixes those of its two halves; neither is linear in what it
mixes, so no two are alike by construction, however regular they are.
Stages that must be exact compare two independent ones (``seed``).

Null texts are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (murmur finaliser)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


LONG = 4096  # bytes from which a range is hashed by itself
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]


def rolled(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The fingerprint of every run of k neighbours, by doubling; shorter by k - 1 (or empty)."""
    join = lambda a, b: mix(a * U(0x9E3779B97F4A7C15) + b)
    x = mix(hashes + U(2 * k + 1000 * seed))
    size = 1
    while size * 2 <= k:
        x = join(x[:-size], x[size:])
        size *= 2
    return join(x[: max(0, len(x) - (k - size))], x[k - size :]) if size < k else x


class Block:
    """Words of some consecutive texts.

    ``data``: their bytes; ``row``: offsets of texts in ``data`` (one more than texts);
    ``start``/``end``: byte ranges of words; ``first``: index of the first word of each text,
    and at last the number of words.
    """

    def __init__(self, data: np.ndarray, row: np.ndarray):
        self.data, self.row = data, row
        n = len(data)
        solid = ~SPACE[data]
        edge = np.empty(n + 1, bool)
        edge[1:] = ~solid
        edge[0] = True
        cut = row[row <= n]
        edge[cut] = True
        self.start = np.flatnonzero(solid & edge[:n])
        after = np.empty(n, bool)
        if n:
            after[:-1] = ~solid[1:]
            after[-1] = True
            inner = cut[(cut > 0)] - 1
            after[inner] = True
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, row)

    @property
    def n_texts(self) -> int:
        return len(self.row) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.n_words)

    def spans(self, start: np.ndarray, end: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
        """Fingerprints of byte ranges."""
        data = np.concatenate([LOWER[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        size = end - start
        out = mix((eight[start] & MASKS[np.minimum(size, 8)]) + U((2 * seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at, more = 8, np.flatnonzero((size > 8) & (size <= LONG))
        while len(more):
            out[more] = mix(out[more] * U(0xD6E8FEB86659FD93) + (eight[start[more] + at] & MASKS[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
        return mix(out ^ size.astype(np.uint64))

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """Fingerprints of words."""
        return self.spans(self.start, self.end, seed, lower)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, fingerprint) of every run of k words within one text."""
        at = runs(self.first[:-1], np.maximum(self.n_words - (k - 1), 0))
        return at, rolled(hashes, k, seed)[at] if len(at) else np.zeros(0, np.uint64)


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... (count[i] of them), for each i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    row = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, row


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, last row + 1, block) over a column, in order; every row is in one block."""
    data, row = buffer_of(texts)
    lo, n = 0, len(row) - 1
    while lo < n:
        hi = int(np.searchsorted(row, row[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, Block(data[row[lo] : row[hi]], row[lo : hi + 1] - row[lo])
        lo = hi

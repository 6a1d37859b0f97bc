"""Vectorised byte kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns and are handled as one byte buffer with
row offsets, so no Python string is made per word. A word is a maximal run of
bytes outside 0x20 and 0x09-0x0D, which never splits a UTF-8 character.

Hashes: every byte is replaced by a random 64-bit value, a word's hash is the
polynomial of these values at an odd point modulo 2**64 (from a prefix sum, so
any word costs two lookups), finished by a bijective mixer. A window's hash is
the same construction over its words' hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time, so that the 8-byte-per-byte arrays stay small.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and all bytes of other characters: the words that letters_only asks for.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POINT = U64(0x9E3779B97F4A7C15)
_WORD_POINT = U64(0xD1342543DE82EF95)


def release() -> None:
    """Gives freed memory back to the system, so that an idle worker holds little."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, point: np.uint64) -> None:
        p, inverse = int(point), 1
        for _ in range(6):
            inverse = inverse * (2 - p * inverse) % (1 << 64)
        self.bases = (p, inverse)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            tables = []
            for base in self.bases:
                t, step = np.ones(1, U64), base
                while len(t) < n:
                    t = np.concatenate([t, t * U64(step)])
                    step = step * step % (1 << 64)
                tables.append(t)
            self.up, self.down = tables
        return self.up[:n], self.down[:n]


_powers, _word_powers = Powers(_POINT), Powers(_WORD_POINT)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 row offsets into them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of some texts: byte ranges, hashes, and word offsets by text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool, letters_only: bool = False) -> None:
        self.data, self.offs = data, offs
        inside = _LETTER[data] if letters_only else ~_SPACE[data]
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            inner = offs[(offs > 0) & (offs < len(data))]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: n + 1 offsets into the words
        self.of = np.searchsorted(self.start, offs)
        self.hash = self._hashes(_LOWER if lower else _BYTE)

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        up, down = _powers.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(table[self.data] * down[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * up[self.start]
        return mix64(h + (self.end - self.start).astype(U64) * U64(0xA0761D6478BD642F))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text, and the index of their first words."""
    n = len(words.hash)
    if n < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    up, down = _word_powers.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(words.hash * down[:n], out=total[1:])
    fits = np.zeros(n, bool)
    first = np.repeat(words.of[1:], np.diff(words.of))  # for each word the end of its text
    at = np.arange(n)
    fits = at + k <= first
    at = at[fits]
    h = (total[at + k] - total[at]) * up[at]
    return mix64(h + U64((k * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF)), at


def sequence_hash(words: Words) -> np.ndarray:
    """A hash for the whole word sequence of each text."""
    n = len(words.hash)
    up, down = _word_powers.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(words.hash * down[:n], out=total[1:])
    h = (total[words.of[1:]] - total[words.of[:-1]]) * up[words.of[:-1]]
    return mix64(h + np.diff(words.of).astype(U64) * U64(0xE7037ED1A0B428DB))


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (a longer row is a run of its own)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j

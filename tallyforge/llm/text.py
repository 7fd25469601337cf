"""Words of many texts at once: byte offsets and 64-bit hashes, computed on whole Arrow columns with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the largest temporaries take eight times as much.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BYTE_BASE, _WORD_BASE = _U(0x9E3779B97F4A7C15 | 3), _U(0xC2B2AE3D27D4EB4F | 3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


class _Powers:
    """base**k and its inverse modulo 2**64 for k below a length that grows on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.n, self.up, self.down = base, 0, np.ones(0, _U), np.ones(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                x = np.full(self.n, b, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_bytes_pow, _words_pow, _other_pow = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_U(0xA24BAED4963EE407 | 3))
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]

#: Bytes of words: all but ASCII white space; and digits, letters and whatever is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most `most` bytes; a longer text is alone. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of some texts: starts, ends (bytes), hashes, and first[i]: the number of words before text i."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray, lower: bool = False, cut: np.ndarray | None = None):
        self.data = data
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.first = np.zeros(0, _U), np.zeros(len(offs), np.int64)
            return
        mark = inside[data]
        edge = np.empty(n + 1, bool)  # edge[i]: between bytes i-1 and i something begins or ends
        edge[0] = edge[n] = True
        np.not_equal(mark[1:], mark[:-1], out=edge[1:n])
        edge[offs] = True
        if cut is not None:
            edge[:n] |= cut
        cuts = np.flatnonzero(edge)
        word = mark[cuts[:-1]]
        self.starts, self.ends = cuts[:-1][word], cuts[1:][word]
        self.first = np.searchsorted(self.starts, offs)
        self.hashes = self._hash(_LOWER if lower else _TABLE)

    def _hash(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), _U)
        a = 0
        while a < len(out):  # blocks of whole words, so that one very long text needs no more memory than many short ones
            at = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, at + SLICE_BYTES, "right")))
            s, e = self.starts[a:b] - at, self.ends[a:b] - at
            up, down = _bytes_pow.upto(int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, _U)
            np.cumsum(table[self.data[at : at + int(e[-1])]] * up[:-1], out=total[1:])
            out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
            a = b
        return out

    def __len__(self) -> int:
        return len(self.starts)


def window_hashes(hashes: np.ndarray, width: int, other: bool = False) -> np.ndarray:
    """Hashes of all runs of `width` words; entry i is of words i to i + width - 1, whatever texts they belong to. other: by another function."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    powers = _other_pow if other else _words_pow
    if other:
        hashes = mix(hashes ^ _U(0x589965CC75374CC3))
    out = np.empty(n, _U)
    step = 1 << 19
    for a in range(0, n, step):
        b = min(n, a + step)
        up, down = powers.upto(b - a + width)
        total = np.zeros(b - a + width, _U)
        np.cumsum(hashes[a : b + width - 1] * up[:-1], out=total[1:])
        out[a:b] = mix((total[width:] - total[: b - a]) * down[: b - a])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)

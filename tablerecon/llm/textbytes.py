"""Whole-column text work on Arrow buffers with numpy: word bounds, hashes, shingles.

Every function takes many texts at once as one byte buffer, so the cost per text is a few
vector passes and no Python loop over words. Words are runs of bytes other than the ASCII
white space 0x20 and 0x09-0x0D; UTF-8 keeps those bytes out of longer characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M
    x ^= x >> np.uint64(33)
    x *= _N
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LOWER_BYTE = _BYTE[_LOWER]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _powers or len(_powers["r"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("r", _R), ("i", _RINV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["r"][:n], _powers["i"][:n]


_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*range(9), *range(14, 32), 127, 0xC0, 0xC1, *range(0xCB, 0xE2), *range(0xE3, 256)]] = True
_ODD_AFTER_C2 = np.ones(256, bool)
_ODD_AFTER_C2[0xA1:0xC0] = False
_ODD_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True


def plain(column: pa.Array) -> np.ndarray:
    """Which texts hold nothing but tab to carriage return, printable ASCII, U+00A1 to U+02AF
    without U+0130 and the digits and fractions among them, U+2010 to U+2027, U+2030 to U+205E
    and U+20AC: characters that tokenizers lower-case and split as Python does. Null is plain."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs = column.buffers()
    at = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    odd = [np.flatnonzero(_ODD_BYTE[d])]
    for lead, bad in ((0xC2, lambda x, y: _ODD_AFTER_C2[x]), (0xC4, lambda x, y: x == 0xB0), (0xCA, lambda x, y: x > 0xAF), (0xE2, lambda x, y: ~((x == 0x80) & ((y >= 0x90) & (y <= 0xA7) | (y >= 0xB0)) | (x == 0x81) & (y <= 0x9E) | (x == 0x82) & (y == 0xAC)))):
        found = np.flatnonzero(d == lead)
        odd.append(found[bad(d[found + 1], d[np.minimum(found + 2, len(d) - 1)])])
    out = np.ones(len(column), bool)
    out[np.searchsorted(at, np.concatenate(odd), "right") - 1] = False
    return out


class Texts:
    """Texts ``lo:hi`` of a column: ``data`` holds them one after another, each ended by a
    line break; text i is ``data[at[i]:at[i + 1] - 1]``."""

    def __init__(self, column: pa.Array, lo: int):
        column = pc.binary_join_element_wise(column.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        bufs = column.buffers()
        at = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.lo, self.n = lo, len(column)
        self.data = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (n + 1 values)."""
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.at)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte spans; with ``lower``, A-Z count as a-z."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        r, inv = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[self.data] * r[:-1], out=sums[1:])
        out = (sums[ends] - sums[starts]) * inv[starts]
        out += (ends - starts).astype(np.uint64)
        return mix(out)


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[Texts]:
    """The column's texts in runs of about ``max_bytes``; null counts as empty. One longer
    text makes a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    size = np.cumsum(np.asarray(pc.binary_length(column), np.int64) + 1)
    lo = 0
    while lo < len(column):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + max_bytes, "right")))
        yield Texts(column.slice(lo, hi - lo), lo)
        lo = hi


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, lower-cased
    (A-Z). A text of 1 to k - 1 words has one shingle, the whole; one without words none."""
    starts, ends, first = texts.words()
    h = texts.span_hashes(starts, ends, lower=True)
    roll = h.copy()
    for j in range(1, k):
        if len(h) > j:
            roll[:-j] = mix(roll[:-j] * np.uint64(_R) + h[j:])
    out = []
    for i in range(texts.n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(roll[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in h[a:b]:
                x = mix(x * np.uint64(_R) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Vectorised tokenisation and hashing of Arrow string columns with numpy.

A *word* is a maximal run of bytes that are not ASCII white space (space, tab, LF, VT, FF, CR).
Every helper works on whole texts; slices only bound the working memory of one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE_BYTE = 0x9E3779B97F4A7C15 | 1
_BASE_TOKEN = 0xD6E8FEB86659FD93 | 1
_SEGMENT = 1 << 20
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd base modulo 2**64 and of its inverse, kept per worker."""
    have = cache.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=U64)
            p[0], filled = 1, 1
            while filled < size:
                k = min(filled, size - filled)
                p[filled : filled + k] = p[:k] * U64(pow(b, filled, 1 << 64))
                filled += k
            both.append(p)
        have = cache[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the MurmurHash3 finaliser)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(raw: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole texts of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """Words of a run of texts: byte starts and ends, and the word range of every text."""

    __slots__ = ("doc", "ends", "raw", "starts")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None):
        self.raw = raw
        tok = ~SPACE[raw] if mask is None else mask
        n = len(raw)
        start = tok.copy()
        start[1:] &= ~tok[:-1]
        edge = offsets[:-1][offsets[:-1] < n]
        start[edge] = tok[edge]
        end = tok.copy()
        end[:-1] &= ~tok[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        end[last] = tok[last]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, the same wherever the word stands."""
        s, e = self.starts, self.ends
        out = np.empty(len(s), dtype=U64)
        a = 0
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(s, s[a] + _SEGMENT)))
            lo, hi = int(s[a]), int(e[b - 1])
            p, q = _powers(_BASE_BYTE, hi - lo)
            h = np.empty(hi - lo + 1, dtype=U64)
            h[0] = 0
            np.cumsum(_BYTE_VALUES[self.raw[lo:hi]] * p, out=h[1:])
            out[a:b] = (h[e[a:b] - lo] - h[s[a:b] - lo]) * q[s[a:b] - lo]
            a = b
        return mix64(out)


def window_hashes(th: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width k, the hash of every run of k consecutive token hashes (length max(0, n-k+1))."""
    n = len(th)
    p, q = _powers(_BASE_TOKEN, max(n, 1))
    g = np.empty(n + 1, dtype=U64)
    g[0] = 0
    np.cumsum(th * p[:n], out=g[1:])
    return [mix64((g[k:] - g[: n + 1 - k]) * q[: n + 1 - k]) if n >= k else np.zeros(0, U64) for k in widths]


def window_starts(doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k tokens that stay inside their text, and how many each text has."""
    counts = np.maximum(np.diff(doc) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), counts
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(doc[:-1] - before, counts), counts


NORMAL_CLASS = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
_NORMAL = np.zeros(256, dtype=bool)
_NORMAL[48:58] = _NORMAL[65:91] = _NORMAL[97:123] = _NORMAL[128:] = True


def normal_mask(raw: np.ndarray) -> np.ndarray:
    """Bytes inside words of NORMAL_CLASS: ASCII letters and digits, and other characters but punctuation blocks."""
    tok = _NORMAL[raw]
    c2 = np.flatnonzero(raw == 0xC2)
    tok[c2] = tok[c2 + 1] = False
    for lead, ranges in ((0xE2, (0x80, 0x81)), (0xE3, (0x80, 0x80))):
        at = np.flatnonzero(raw == lead)
        at = at[(raw[at + 1] >= ranges[0]) & (raw[at + 1] <= ranges[1])]
        tok[at] = tok[at + 1] = tok[at + 2] = False
    return tok


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]

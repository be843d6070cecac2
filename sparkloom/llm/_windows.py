"""Windows of words at chosen places of texts: their keys, and runs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._tokens import Words, mix64, slices, window_hashes

RANGES = "__rid long, extra binary"


def window_runs(count: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged positions that stay inside a row: (row, first position in it, end position in it, first position in all)."""
    doc = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    new = np.ones(len(flag), bool)
    new[1:] = (doc[1:] != doc[:-1]) | ~flag[:-1]
    start = np.flatnonzero(flag & new)
    last = np.ones(len(flag), bool)
    last[:-1] = (doc[1:] != doc[:-1]) | ~flag[1:]
    end = np.flatnonzero(flag & last) + 1
    return doc[start], start - base[doc[start]], end - base[doc[start]], start


def packed_ranges(rid: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """RANGES columns of ranges a..b of rows, rows ascending: int32 pairs of each row."""
    by = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    pairs = np.stack([a, b], 1).astype(np.int32)
    return {"__rid": pa.array(rid[row[by]], pa.int64()), "extra": pa.array([p.tobytes() for p in np.split(pairs, by[1:])] if len(by) else [], pa.binary())}


def range_windows(notes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, number of them in each text) of packed ranges of starts."""
    spans = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in notes]
    counts = np.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], np.int64)
    at = np.concatenate([np.arange(x, y) for s in spans for x, y in s.tolist()]) if spans else np.zeros(0, np.int64)
    return at, counts


def whole_window_keys(threshold: int, n_buckets: int):
    """128-bit keys of the windows of ``threshold`` words that start in the ranges of each text."""

    def keys(raw: np.ndarray, off: np.ndarray, extra: pa.Array) -> Iterator[tuple]:
        for a, b, r, o in slices(raw, off):
            words = Words(r, o)
            inside, counts = range_windows(extra[a:b].to_pylist())
            at = inside + np.repeat(words.doc[:-1], counts)
            th = words.hashes()
            (h,) = window_hashes(th, (threshold,))
            (g,) = window_hashes(mix64(th ^ np.uint64(0x5BD1E9955BD1E995)), (threshold,))
            h = h[at]
            yield a, h % np.uint64(n_buckets), h & np.uint64(0xFFFFFFFFFFFFFFFE), g[at], counts

    return keys


def runs_at(notes: list[bytes], flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows that start in the ranges of texts: (text, first start, end of starts, first place among all windows)."""
    at, counts = range_windows(notes)
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    piece = np.flatnonzero(new)
    _, a, b, start = window_runs(np.diff(np.concatenate([piece, [len(at)]])), flag)
    return doc[start], at[start], at[start] + (b - a), start

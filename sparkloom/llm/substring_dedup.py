"""Operator 5: repeated passages by fixed-block anchors.

Texts are cut into non-overlapping reference blocks of ``(threshold + 1) // 2`` words, so that any
repeat of ``threshold`` words holds a whole block of either side. All blocks are indexed in hash
buckets and probed with every rolling window of that width (no block or partner is left out); a block and a window
that meet are anchors. Hits are then extended word by word around the anchors, as far as some other text agrees:
every window of ``threshold`` words that holds an anchor is compared over all its words with those of all other
anchors (by 127 bits of hash), and from each anchor the matching windows are followed to the left and to the
right. What they cover is a maximal exact repeat: the longest stretch of which every window of
``threshold`` words also occurs elsewhere. Extending each pair of a block and a window by itself would give
n^2 pairs in a group of n copies; all partners of an anchor are compared at once instead.

Defined results: a null or empty text, or one shorter than the threshold, has no repeat; repeated
rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import buckets, pick, with_row_key
from ._exchange import DIRECT, MULTI, doc_table, equal_runs, exchange
from ._tokens import Words, runs, slices, window_hashes, window_starts
from ._windows import RANGES, packed_ranges, runs_at, whole_window_keys, window_runs

THRESHOLD = 50
BLOCK = 2  # the bit of a key that says a reference block begins here


def anchor_keys(block: int, n_buckets: int):
    def keys(raw: np.ndarray, off: np.ndarray, _: object) -> Iterator[tuple]:
        for a, _b, r, o in slices(raw, off):
            words = Words(r, o)
            at, counts = window_starts(words.doc, block)
            (h,) = window_hashes(words.hashes(), (block,))
            h = h[at]
            inside = at - np.repeat(words.doc[:-1], counts)
            yield a, h % np.uint64(n_buckets), ((h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFC)) | ((inside % block == 0).astype(np.uint32) << np.uint32(1)), None, counts

    return keys


def probe(keys: np.ndarray, _second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose group holds a reference block and another window."""
    hit = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    k = keys[order]
    value = k >> 2
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.concatenate([start, [len(k)]]))
    bits = np.bitwise_or.reduceat(k & 3, start) if len(k) else k
    hit[order] = np.repeat(((size > 1) | (bits & MULTI > 0)) & (bits & BLOCK > 0), size)
    return hit, hit


def around(count: np.ndarray, hit: np.ndarray, block: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the starts of the windows of ``threshold`` words that hold an anchor; ``hit`` flags each window of ``block`` words."""
    row, a, b, _ = window_runs(count, hit)
    by = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x, y in zip(by, [*by[1:], len(row)]):
        last = int(count[row[x]]) + block - threshold  # windows of threshold words in this text
        if last > 0:
            mark = np.zeros(last + 1, np.int32)
            np.add.at(mark, np.minimum(np.maximum(a[x:y] + block - threshold, 0), last), 1)
            np.add.at(mark, np.minimum(b[x:y], last), -1)
            s, e = runs(np.cumsum(mark)[:last] > 0)
            out.append((np.full(len(s), row[x]), s, e))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 3


def anchors(docs: DataFrame, threshold: int = THRESHOLD, direct: int = DIRECT) -> DataFrame:
    """(__rid, extra): starts of the windows of ``threshold`` words that hold an anchor, as packed int32 ranges."""
    block, n = (threshold + 1) // 2, buckets(docs.sparkSession)

    def assemble(rid, did, null, count, hit, _hit, _):  # noqa: ANN001, ANN202
        return packed_ranges(rid, *around(count, hit, block, threshold))

    return exchange(doc_table(docs), anchor_keys(block, n), probe, assemble, RANGES, "uint32", n_buckets=n, either=BLOCK, direct=direct)


def agree(keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows around anchors that another one equals in all words."""
    order, again = equal_runs(keys, second, MULTI)
    both = np.zeros(len(keys), bool)
    both[order] = again | np.concatenate([again[1:], [False]]) | (keys[order] & np.uint64(MULTI)).astype(bool)
    return both, both


def substring_repeats(docs: DataFrame, threshold: int = THRESHOLD, direct: int = DIRECT) -> DataFrame:
    """Maximal exact repeats of at least ``threshold`` words in ``docs(doc_id, text)``: doc_id, start_token, end_token (exclusive), n_tokens."""
    n = buckets(docs.sparkSession)
    keyed = with_row_key(pick(docs, "doc_id", "text"))

    def extend(rid, did, null, count, matched, _matched, notes):  # noqa: ANN001, ANN202
        row, a, b, _ = runs_at(notes, matched)
        return {"doc_id": pa.array(did[row], mask=null[row]), "start_token": pa.array(a, pa.int32()), "end_token": pa.array(b + threshold - 1, pa.int32()), "n_tokens": pa.array(b - a + threshold - 1, pa.int32())}

    near = anchors(keyed, threshold, direct)
    return exchange(doc_table(keyed), whole_window_keys(threshold, n), agree, extend, "doc_id long, start_token int, end_token int, n_tokens int", "uint64", True, n_buckets=n, direct=direct, ranges=near)

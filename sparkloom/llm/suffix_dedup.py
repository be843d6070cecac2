"""Operator 2: repeated passages by a depth-limited suffix radix sort.

All suffixes of all texts are ordered, most significant digit first, only as deep as ``threshold``
words. A digit is a block of words. The first pass deals the suffixes by the hash of their first ``PREFIX`` words
into buckets (the shuffle) and orders each bucket; suffixes that stand alone there are done, as they can have no
equal deeper down. The second pass deals and orders only the others, through the threshold. Groups that
are equal at that depth are the repeated windows. Order within a digit is that of its hash: which suffixes are
equal does not depend on it. The hash of the first digit has 31 bits besides the bucket's (it only chooses what
the second pass sees), that of the last 127 bits, so groups are equal words but for a chance of about n^2 / 2^128.

Defined results: a null or empty text, or one shorter than the threshold, has no window; a null
doc_id sorts last; repeated rows are separate documents; an empty table gives no rows; other columns
are ignored here and returned unchanged by :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buckets, masked, pick, with_row_key
from ._exchange import DIRECT, MULTI, doc_table, equal_runs, exchange
from ._rewrite import without_ranges
from ._tokens import Words, slices, window_hashes, window_starts
from ._windows import RANGES, packed_ranges, range_windows, runs_at, whole_window_keys, window_runs

THRESHOLD, PREFIX = 50, 16
SPANS = "__rid long, doc_id long, start_token int, end_token int, repeated_windows int, first_windows int"


def prefix_keys(threshold: int, n_buckets: int):
    """The first digit of the suffixes that reach the threshold."""
    depth = max(1, threshold * PREFIX // THRESHOLD)

    def keys(raw: np.ndarray, off: np.ndarray, _: object) -> Iterator[tuple]:
        for a, _b, r, o in slices(raw, off):
            words = Words(r, o)
            at, counts = window_starts(words.doc, threshold)
            (h,) = window_hashes(words.hashes(), (depth,))
            h = h[at]
            yield a, h % np.uint64(n_buckets), (h >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE), None, counts

    return keys


def not_alone(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A digit pass in a bucket: (in a group of equals, first of its group)."""
    order, again = equal_runs(keys, second, MULTI)
    grouped = again | np.concatenate([again[1:], [False]]) | (keys[order] & keys.dtype.type(MULTI)).astype(bool)
    repeated, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    repeated[order[grouped]] = True
    first[order[grouped & ~again]] = True
    return repeated, first


def deep_sort(keyed: DataFrame, threshold: int, assemble, schema: str, direct: int) -> DataFrame:  # noqa: ANN001
    """Both passes over ``keyed`` (which has __rid); ``assemble`` gets the groups of the second one."""
    n = buckets(keyed.sparkSession)

    def survivors(rid, did, null, count, repeated, first, _):  # noqa: ANN001, ANN202
        row, a, b, _ = window_runs(count, repeated)
        return packed_ranges(rid, row, a, b)

    some = exchange(doc_table(keyed), prefix_keys(threshold, n), not_alone, survivors, RANGES, "uint32", n_buckets=n, direct=direct)
    return exchange(doc_table(keyed), whole_window_keys(threshold, n), not_alone, assemble, schema, "uint64", True, n_buckets=n, direct=direct, ranges=some)


def repeat_runs(docs: DataFrame, threshold: int = THRESHOLD, direct: int = DIRECT) -> DataFrame:
    """Per row of ``docs`` (which has __rid): its runs of repeated windows."""

    def assemble(rid, did, null, count, repeated, first, notes):  # noqa: ANN001, ANN202
        row, a, b, start = runs_at(notes, repeated)
        n_first = np.concatenate([[0], np.cumsum(first & repeated)])
        return {"__rid": rid[row], "doc_id": pa.array(did[row], mask=null[row]), "start_token": pa.array(a, pa.int32()), "end_token": pa.array(b + threshold - 1, pa.int32()), "repeated_windows": pa.array(b - a, pa.int32()), "first_windows": pa.array(n_first[start + b - a] - n_first[start], pa.int32())}

    return deep_sort(docs, threshold, assemble, SPANS, direct)


def suffix_repeats(docs: DataFrame, threshold: int = THRESHOLD, direct: int = DIRECT) -> DataFrame:
    """Every maximal run of windows of ``threshold`` words that occur at least twice in ``docs(doc_id, text)``.

    Rows: doc_id, start_token, end_token (exclusive, in words), repeated_windows, and first_windows: how
    many of them are the first of their group in the order of the table (least doc_id first within a scan chunk).
    """
    return repeat_runs(with_row_key(pick(docs, "doc_id", "text")), threshold, direct).drop("__rid")


def later_words(notes: list[bytes], repeated: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the stretches of words in later occurrences and in no first one."""
    starts, counts = range_windows(notes)
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.zeros(len(counts), np.int64)
    np.maximum.at(size, doc, starts + threshold)
    base = np.cumsum(size) - size

    def cover(flag: np.ndarray) -> np.ndarray:
        at = np.zeros(int(size.sum()) + 1, np.int64)
        np.add.at(at, base[doc[flag]] + starts[flag], 1)
        np.add.at(at, base[doc[flag]] + starts[flag] + threshold, -1)
        return np.cumsum(at)[:-1] > 0

    row, a, b, _ = window_runs(size, cover(repeated & ~first) & ~cover(repeated & first))
    return row, a, b


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without second and later occurrences of repeated windows; columns stay, n_chars (if there) follows the text.

    Words of a later occurrence go, unless they also belong to a first one. A text of which nothing is left goes.
    """
    docs, back = masked(docs, "doc_id", "text", "n_chars")
    keyed = with_row_key(docs)

    def assemble(rid, did, null, count, repeated, first, notes):  # noqa: ANN001, ANN202
        return packed_ranges(rid, *later_words(notes, repeated, first, threshold))

    drops = deep_sort(keyed, threshold, assemble, RANGES, DIRECT)
    return back(with_lengths(without_ranges(keyed, drops), docs))


def with_lengths(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars following the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Byte-pair merges as DataFrame steps, for a few merges over a distributed word table.

A word is a string of symbols: its bytes, and from 256 on what was merged. The words are kept in the shared folder;
each step applies the merges since they were written to all words and counts all pairs again, a batch of words at
once, so only a table of pairs for each task is shuffled. For thousands of merges use ``operators.learners``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .counting import added, flat_bytes
from .shared import write_shared

CUT_EVERY = 4
_END = 65535  # stands after each word; pairs with it are none


def symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words (w, freq), each word with an end, and the frequency at each of them."""
    data, off = flat_bytes(batch.column(0))
    data, size = data.view(np.uint16), np.diff(off) // 2
    s = np.full(len(data) + len(size), _END, np.uint16)
    s[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    return s, np.repeat(batch.column(1).to_numpy(), size + 1)


def merged(s: np.ndarray, freq: np.ndarray, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair a, b replaced by ``new``, from left to right without overlap."""
    hit = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
    if a == b and len(hit):  # of a run of hits, every second
        start = np.r_[True, np.diff(hit) > 1]
        hit = hit[(hit - hit[start][np.cumsum(start) - 1]) % 2 == 0]
    s[hit] = new
    keep = np.ones(len(s), bool)
    keep[hit + 1] = False
    return s[keep], freq[keep]


def _merging(rules: list[tuple[int, int, int]], give: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, freq = symbols(batch)
            for rule in rules:
                s, freq = merged(s, freq, *rule)
            yield give(s, freq)

    return run


def _pairs(s: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    inside = (s[:-1] != _END) & (s[1:] != _END)
    keys, counts = (s[:-1].astype(np.int64) << 16 | s[1:])[inside], freq[:-1][inside]
    if len(keys):
        keys, counts = added(keys, counts)
    return pa.record_batch({"pair": keys, "cnt": counts})


def _words(s: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    ends = np.flatnonzero(s == _END)
    size = np.diff(ends, prepend=-1) - 1
    off = pa.array(np.r_[0, np.cumsum(2 * size)].astype(np.int32)).buffers()[1]
    return pa.record_batch([pa.Array.from_buffers(pa.binary(), len(ends), [None, off, pa.py_buffer(s[s != _END].tobytes())]), pa.array(freq[ends])], names=["w", "freq"])


def learn_merges(words: DataFrame, k: int, max_bytes: int = 18) -> DataFrame:
    """(step, a, b, cnt) of the first k merges: the most frequent pair that stays within ``max_bytes``, ties by the bytes of a, then of b."""
    if k > _END - 256:
        raise ValueError(f"more than {_END - 256} merges")
    spark = ship(words.sparkSession)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(0))
            w = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.array((2 * off).astype(np.int32)).buffers()[1], pa.py_buffer(data.astype(np.uint16).tobytes())])
            yield pa.record_batch([w, batch.column(1)], names=["w", "freq"])

    kind = "w binary, freq long"
    state, _ = write_shared(words.where("word is not null").select(F.encode("word", "UTF-8").alias("w"), F.col("freq").cast("long").alias("freq")).mapInArrow(wide, kind))
    text = [f"{b:02X}" for b in range(256)]
    out: list[tuple[int, str, str, int]] = []
    rules: list[tuple[int, int, int]] = []
    for step in range(1, k + 1):
        pairs = state.mapInArrow(_merging(rules, _pairs), "pair long, cnt long").groupBy("pair").agg(F.sum("cnt").cast("long").alias("cnt")).where("cnt > 0")
        names = spark.createDataFrame(list(enumerate(text)), "id int, s string")
        left, right = (F.broadcast(names.select(F.col("id").alias(f"{x}_id"), F.col("s").alias(x))) for x in "ab")
        pairs = pairs.join(left, F.shiftright("pair", 16).cast("int") == F.col("a_id")).join(right, F.col("pair").bitwiseAND(65535).cast("int") == F.col("b_id"))
        top = pairs.where(F.length("a") + F.length("b") <= 2 * max_bytes).orderBy(F.desc("cnt"), "a", "b").first()
        if top is None:
            break
        out.append((step, top["a"], top["b"], top["cnt"]))
        rules.append((top["a_id"], top["b_id"], len(text)))
        text.append(top["a"] + top["b"])
        if step % CUT_EVERY == 0 and step < k:
            state, _ = write_shared(state.mapInArrow(_merging(rules, _words), kind))
            rules = []
    return spark.createDataFrame(out, "step int, a string, b string, cnt long")

"""Operator 4: packing texts into fixed windows by an order-preserving dynamic program.

Texts are taken in the order of doc_id and cut into sentences (a word that ends in . ! ? or their
full-width forms, or is followed by a line feed, ends one). A window takes consecutive sentences;
its cuts are at sentence or document ends, and after any word of a sentence longer than a window, the
rest of which opens the next one. No window overflows, so every word is in exactly one. A window of s
words of capacity w costs w - s for padding, plus ``split`` where it cuts a document and ``truncation``
where it cuts a sentence. With prefix sums S, the best total over the first j units (sentences, or words
of the over-long ones) is the minimum of f(i) + S(i) over the window S(i) >= S(j) - w, held in a
monotone queue: linear time, and optimal for the stream. A stream is a stretch of the ordered corpus of
about ``STREAM_BYTES`` bytes of text (more where that would give over ``MAX_STREAMS`` streams), whatever the values
of doc_id are, so that streams run in parallel and at most one window of each is cut short by its end. Streams
are found by running sums: keys and sizes of the texts, without the texts, are ordered in ranges, and the sums of
ranges before each are added; the first keys of the streams are then broadcast to the one shuffle of the texts.

Defined results: null or empty texts take no room and appear in no window; ``truncated``, the words
lost, is always 0; rows of one doc_id are ordered by a hash of the text, then as in the table; rows without doc_id come
last; an empty table gives no rows; other columns are ignored. Equal totals: the earliest cut is taken.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, lean, pick, ship, with_row_key
from ._tokens import Words, slices, string_buffers

CAPACITY, TRUNCATION, SPLIT, STREAM_BYTES, MAX_STREAMS = 2048, 8, 16, 8_000_000, 200_000
SCHEMA = "stream long, window int, n_tokens int, padding int, truncated int, doc_ids array<long>, starts array<int>, ends array<int>, text string"

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentence_ends(words: Words) -> np.ndarray:
    """Whether each word ends a sentence (the last word of a text does)."""
    s, e, raw = words.starts, words.ends, words.raw
    end = _STOP[raw[e - 1]]
    for tail in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"):
        at = np.flatnonzero((e - s >= 3) & (raw[e - 1] == tail[2]))
        end[at] |= (raw[e[at] - 2] == tail[1]) & (raw[e[at] - 3] == tail[0])
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    nxt = np.concatenate([s[1:], [len(raw)]])
    end |= feeds[nxt] > feeds[e]
    last = words.doc[1:][np.diff(words.doc) > 0] - 1
    end[last] = True
    return end


def best_cuts(sizes: list[int], at_document: list[bool], capacity: int, truncation: int, split: int, inside: list[bool] | None = None) -> list[int]:
    """End positions (in units) of the windows of the cheapest packing.

    With ``inside`` (whether the end of each unit is inside a sentence) no window overflows, and a cut there costs
    ``truncation``; no unit may be larger than a window. Without it, each word that overflows costs ``truncation``.
    """
    n = len(sizes)
    total, best, came = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + S, position), increasing
    enter = 0  # positions before it have left the fitting range
    over, over_at = None, 0
    s = 0
    for j in range(1, n + 1):
        s += sizes[j - 1]
        total[j] = s
        low = s - capacity
        while enter < j and total[enter] < low:
            v = best[enter] - truncation * total[enter]
            if inside is None and (over is None or v < over):
                over, over_at = v, enter
            enter += 1
        while queue and queue[0][1] < enter:
            queue.popleft()
        cost, at = (queue[0][0] + capacity - s, queue[0][1]) if queue else (None, -1)
        if over is not None:
            v = over + truncation * low
            if cost is None or v < cost or (v == cost and over_at < at):
                cost, at = v, over_at
        if not at_document[j - 1]:
            cost += split
        if inside is not None and inside[j - 1]:
            cost += truncation
        best[j], came[j] = cost, at
        key = cost + s
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts = []
    j = n
    while j > 0:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def pack_stream(texts: list[tuple[int | None, str]], capacity: int, truncation: int, split: int) -> list[tuple]:
    """Windows of one stream of (doc_id, text) in order: (n_tokens, padding, truncated, doc_ids, starts, ends, text)."""
    sizes, at_doc, inside, doc_of, first = [], [], [], [], []
    where: list[tuple[np.ndarray, np.ndarray, bytes]] = []
    raw, off = string_buffers(pa.array([t for _, t in texts], pa.large_string()))
    for a, b, r, o in slices(raw, off):
        words = Words(r, o)
        ends = np.flatnonzero(sentence_ends(words)) + 1 if len(words.starts) else np.zeros(0, int)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        # each word of a sentence longer than a window is a unit of its own
        units = np.where(ends - begin > capacity, ends - begin, 1)
        word = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        begin, last, alone = np.repeat(begin, units) + word, np.repeat(ends, units), np.repeat(units > 1, units)
        ends = np.where(alone, begin + 1, last)
        doc = np.searchsorted(words.doc, begin, "right") - 1
        sizes += (ends - begin).tolist()
        at_doc += (ends == words.doc[doc + 1]).tolist()
        inside += (ends < last).tolist()
        doc_of += (doc + a).tolist()
        first += (begin - words.doc[doc]).tolist()
        for i in range(b - a):
            x, y = words.doc[i], words.doc[i + 1]
            where.append((words.starts[x:y] - o[i], words.ends[x:y] - o[i], r[o[i] : o[i + 1]]))
    out, i = [], 0
    for j in best_cuts(sizes, at_doc, capacity, truncation, split, inside):
        ids, starts, ends, pieces = [], [], [], []
        size = sum(sizes[i:j])
        while i < j:
            d, s, e = doc_of[i], first[i], first[i]
            while i < j and doc_of[i] == d:
                e, i = first[i] + sizes[i], i + 1
            ids.append(texts[d][0])
            starts.append(s)
            ends.append(e)
            at, to, body = where[d]
            pieces.append(body[at[s] : to[e - 1]].tobytes().decode())
        out.append((size, capacity - size, 0, ids, starts, ends, "\n".join(pieces)))
    return out


def stream_of(few: DataFrame, stream_bytes: int) -> Column:
    """The stream of each row of few(doc_id, text, h, __rid), in the order of doc_id (null last), h, __rid."""
    spark = few.sparkSession
    keys = ("none", "doc_id", "h", "__rid")
    light = few.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h", "__rid", F.octet_length("text").cast("long").alias("size"))
    total = light.agg(F.sum("size")).first()[0] or 0
    stream_bytes = max(stream_bytes, -(-total // MAX_STREAMS))
    if total <= stream_bytes:
        return F.lit(0).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = cut(light.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["size"] for r in light.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    before, at = [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    order = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = light.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    placed = placed.withColumn("own", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.withColumn("stream", F.expr(f"(before + own) div {stream_bytes}"))
    firsts = sorted(tuple(r["k"]) + (r["stream"],) for r in placed.groupBy("stream").agg(F.min(F.struct(*keys)).alias("k")).collect())
    shared = spark.sparkContext.broadcast((np.array([f[1] for f in firsts if not f[0]], np.int64), firsts))

    @F.arrow_udf("long")
    def find(doc_id: pa.Array, h: pa.Array, rid: pa.Array) -> pa.Array:
        ids, first = shared.value
        null, did = np.asarray(doc_id.is_null()), doc_id.fill_null(0).to_numpy()
        at = np.where(null, len(first), np.searchsorted(ids, did, "left")) - 1
        tie = np.flatnonzero(null | (np.searchsorted(ids, did, "right") - 1 != at))  # a stream begins inside this doc_id
        for i in tie.tolist():
            at[i] = bisect_right(first, (bool(null[i]), int(did[i]), h[i].as_py(), rid[i].as_py()), key=lambda f: f[:4]) - 1
        return pa.array(np.array([f[4] for f in first], np.int64)[np.maximum(at, 0)])

    return find("doc_id", "h", "__rid")


def pack(docs: DataFrame, capacity: int = CAPACITY, truncation: int = TRUNCATION, split: int = SPLIT, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """Windows of ``docs(doc_id, text)``: stream, window, n_tokens, padding, truncated, doc_ids with word ranges starts and ends, text."""
    ship(docs.sparkSession)
    few = with_row_key(pick(docs, "doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__rid").where("text is not null")
    few = few.withColumn("h", F.xxhash64("text"))
    few = few.withColumn("stream", stream_of(few, stream_bytes))

    def run(t: pa.Table) -> pa.Table:
        lean()
        did, h, rid = (t[c].to_pylist() for c in ("doc_id", "h", "__rid"))
        by = sorted(range(len(did)), key=lambda i: (did[i] is None, did[i] or 0, h[i], rid[i]))
        text = t["text"]
        out = pack_stream([(did[i], text[i].as_py()) for i in by], capacity, truncation, split)
        stream = t["stream"][0].as_py()
        cols = list(zip(*out)) if out else [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        names = ("n_tokens", "padding", "truncated", "doc_ids", "starts", "ends", "text")
        return pa.table({"stream": pa.array([stream] * len(out), pa.int64()), "window": pa.array(range(len(out)), pa.int32())} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    return few.groupBy("stream").applyInArrow(run, SCHEMA)

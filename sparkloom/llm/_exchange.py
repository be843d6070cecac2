"""A compact all-to-all exchange of position keys.

Each scan task turns its texts into one key per token position (32 or 64 bits, or 128 in two parts), deals the
keys into hash buckets and sends every bucket *one binary message* with its keys in position order. A bucket
groups equal keys with numpy and answers each message with two bits per key. The order of the
positions is not sent with the keys: a directory row of the chunk (documents, window counts, bucket
of each position) travels beside them and, with the answers, is enough to place every bit. So a
position costs its key and about log2(buckets) bits of shuffle, and nothing is collected or cached.

There are as many buckets as shuffle partitions. Up to ``DIRECT`` of them a chunk sends to each. With more, messages
would become small and their number would grow with the square of the input; then a chunk deals to about the
square root of that many groups of buckets, and a second hop, of the same form, deals what a group got from a
stretch of chunks to the buckets of the group; answers return by the same way. Messages then hold thousands of
keys at any size of the input, and their number grows in proportion to it.

Equal keys of a chunk are sent once, with bit 0 (``MULTI``) set, so a passage that occurs a billion times
loads its bucket with one key a chunk. Keys therefore leave bit 0 free; bits of ``either`` are facts about
a position that are joined by OR and do not make keys differ.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buckets, lean, ship
from ._lookup import in_ranges
from ._tokens import string_buffers

MESSAGE = "dest int, chunk long, ord long, kind byte, blob binary"
CHUNK_KEYS, DIRECT = 1_000_000, 2048
MULTI = 1
KEYS, DIRECTORY, OUTER = 0, 1, 2  # kinds of messages; OUTER: a directory of the first hop on its way through the second


def pack(x: object) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> object:
    return pickle.loads(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True))


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.binary()))], names=["dest", "chunk", "ord", "kind", "blob"])


def _message_schema() -> pa.Schema:
    return pa.schema([("dest", pa.int32()), ("chunk", pa.int64()), ("ord", pa.int64()), ("kind", pa.int8()), ("blob", pa.binary())])


def _message_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_message_batch(rows)] if rows else [], _message_schema())


def labels(n: int) -> np.ndarray:
    """n distinct ints, the i-th of which Spark's hash partitioning puts into partition i of n.

    Plain bucket numbers would fall on the partitions at random, up to four or five on one. With another number
    of partitions these are as good as any numbers.
    """

    def rotate(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    out, at = np.full(n, -1, np.int64), 0
    while (out < 0).any():
        x = np.arange(at, at + 16 * n + 64, dtype=np.uint32)
        h = np.uint32(42) ^ (rotate(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = rotate(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(mult)
        h ^= h >> np.uint32(16)
        part = np.mod(h.view(np.int32).astype(np.int64), n)
        where, first = np.unique(part, return_index=True)
        new = out[where] < 0
        out[where[new]] = x[first[new]]
        at += len(x)
    return out.astype(np.int32)


def equal_runs(key: np.ndarray, second: np.ndarray | None, ignore: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, positions ascending among equals, and whether each in it equals the one before."""
    bits = key & key.dtype.type(~ignore & int(np.iinfo(key.dtype).max))
    order = np.argsort(bits, kind="stable")
    k = bits[order]
    again = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, bool)
    if second is not None:
        s = second[order]
        differ = again.copy()
        differ[1:] &= s[1:] != s[:-1]
        if differ.any():  # the first parts collide
            order = np.lexsort((second, bits))
            k, s = bits[order], second[order]
            again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    return order, again


def combine(bucket: np.ndarray, key: np.ndarray, second: np.ndarray | None, either: int) -> tuple[np.ndarray, np.ndarray]:
    """Mark in ``key`` (in place) the first of equal keys, and return the others with the place of their first."""
    kind = key.dtype.type
    order, again = equal_runs(key, second, MULTI | either)
    if len(order):
        again[1:] &= bucket[order[1:]] == bucket[order[:-1]]
    starts = np.flatnonzero(~again)
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    inside = np.repeat(sizes > 1, sizes)
    spots = order[inside]
    at = np.cumsum(sizes[many]) - sizes[many]
    first = np.minimum.reduceat(spots, at)
    key[first] |= np.bitwise_or.reduceat(key[spots], at) & kind(either) | kind(MULTI)
    of = np.repeat(first, sizes[many])
    rest = spots != of
    return spots[rest].astype(np.int32), of[rest].astype(np.int32)


def dealt(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by bucket, in order among equals, and the bounds of the buckets."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


class Blob:
    """Arrays of one length as bytes: keys, their second part, and the bucket inside the group of the first hop."""

    def __init__(self, dtype: str, second: bool, inner: bool):
        self.kinds = [np.dtype(dtype), *[np.dtype("uint64")] * second, *[np.dtype("uint32")] * inner]
        self.second, self.inner = second, inner

    def read(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
        """(keys, second parts, inner buckets, keys of each blob) of blobs end to end."""
        width = sum(k.itemsize for k in self.kinds)
        counts = np.array([len(b) // width for b in blobs], np.int64)
        cols, skip = [], 0
        for k in self.kinds:
            cols.append(np.concatenate([np.frombuffer(b, k, n, skip * n) for b, n in zip(blobs, counts.tolist())]) if blobs else np.zeros(0, k))
            skip += k.itemsize
        return cols[0], cols[1] if self.second else None, cols[-1] if self.inner else None, counts

    @staticmethod
    def write(arrays: list[np.ndarray | None], at: slice) -> bytes:
        return b"".join(a[at].tobytes() for a in arrays if a is not None)


def messages(docs: DataFrame, keys: Callable, n_buckets: int, either: int = 0, span: int = 1, ranges: DataFrame | None = None) -> DataFrame:
    """docs(__rid, doc_id, text) -> message rows to groups of ``span`` buckets.

    With ``ranges(__rid, extra)``, only texts that have a row there take part, and ``keys`` gets their extras.

    ``keys(raw, offsets, extra)`` yields (first row, bucket of each position, key of each position, second part or
    None, positions of each row), covering the rows in order.
    """
    ship(docs.sparkSession)
    n_out = -(-n_buckets // span)
    label = labels(n_out)
    chosen = None if ranges is None else docs.sparkSession.sparkContext.broadcast(in_ranges(ranges))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        look = None if chosen is None else chosen.value.finder()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, seq
            note = [x for h in held for x in h[7]]
            cols = list(zip(*held))
            rid, did, null, count, bucket, key = (np.concatenate(x) for x in cols[:6])
            second = None if cols[6][0] is None else np.concatenate(cols[6])
            held = []
            chunk = (part << 24) | seq
            seq += 1
            # texts of a chunk stand in the order of doc_id (nulls last), so "first" means the least doc_id
            by = np.lexsort((rid, did, null))
            starts = np.cumsum(count) - count
            take = np.repeat(starts[by] - (np.cumsum(count[by]) - count[by]), count[by]) + np.arange(len(key))
            bucket, key, second = bucket[take], key[take], None if second is None else second[take]
            del take
            rid, did, null, count = rid[by], did[by], null[by], count[by]
            ord_ = int(did[0]) if len(did) and not null[0] else (1 << 62)
            notes = [note[i] for i in by] if note else None
            copy, of = combine(bucket, key, second, either)
            if len(copy):
                sent = np.ones(len(key), bool)
                sent[copy] = False
                bucket, key, second = bucket[sent], key[sent], None if second is None else second[sent]
            outer = (bucket // np.uint32(span)).astype(np.uint16 if n_out < 65536 else np.uint32)
            inner = None if span == 1 else bucket % np.uint32(span)
            rows = [(int(label[(part + 7919 * seq) % n_out]), chunk, ord_, DIRECTORY, pack((rid, did, null, count, outer, copy, of, notes)))]
            order, cut = dealt(outer, n_out)
            arrays = [None if a is None else a[order] for a in (key, second, inner)]
            del order, key, second, bucket, outer, inner
            size = 0
            for b in range(n_out):
                if cut[b] < cut[b + 1]:
                    blob = Blob.write(arrays, slice(cut[b], cut[b + 1]))
                    rows.append((int(label[b]), chunk, ord_, KEYS, blob))
                    size += len(blob)
                    if size > 4_000_000:
                        yield _message_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _message_batch(rows)

        n = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rid, extra = t["__rid"].to_numpy(), None
            if look is not None:
                extra = look(rid)
                some = extra.is_valid()
                t, extra = t.filter(some), extra.filter(some)
                rid = rid[np.asarray(some)]
            null = np.asarray(t["doc_id"].is_null())
            did = t["doc_id"].fill_null(0).to_numpy().astype(np.int64)
            raw, off = string_buffers(t["text"])
            for first, bucket, key, second, count in keys(raw, off, extra):
                sl = slice(first, first + len(count))
                live = count > 0
                if live.any():
                    own = [] if extra is None else [x.as_py() for x in extra[first : first + len(count)].filter(pa.array(live))]
                    held.append((rid[sl][live], did[sl][live], null[sl][live], count[live], bucket.astype(np.uint32), key, second, own))
                    n += len(key)
                    if n >= CHUNK_KEYS:
                        yield from flush()
                        n = 0
        if held:
            yield from flush()

    return docs.mapInArrow(scan, MESSAGE)


def answers(sent: DataFrame, judge: Callable, form: Blob) -> DataFrame:
    """Messages to buckets -> a reply to each, with the directories as they were."""

    def answer(t: pa.Table) -> pa.Table:
        lean()
        kind, chunk, ord_ = (t[c].to_numpy() for c in ("kind", "chunk", "ord"))
        blobs = t["blob"].to_pylist()
        bucket = int(t["dest"][0].as_py())
        rows = [(bucket, int(chunk[i]), 0, int(kind[i]), blobs[i]) for i in np.flatnonzero(kind != KEYS)]
        own = np.flatnonzero(kind == KEYS)
        own = own[np.lexsort((chunk[own], ord_[own]))]
        if len(own):
            key, second, _, counts = form.read([blobs[i] for i in own])
            del blobs
            a, b = judge(key, second)
            at = 0
            for i, n in zip(own.tolist(), counts.tolist()):
                rows.append((bucket, int(chunk[i]), 0, KEYS, _bits(a[at : at + n], b[at : at + n])))
                at += n
        return _message_table(rows)

    return sent.groupBy("dest").applyInArrow(answer, MESSAGE)


def _bits(a: np.ndarray, b: np.ndarray) -> bytes:
    return np.packbits(a).tobytes() + np.packbits(b).tobytes() if a.any() else b""


def _flags(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    half = np.frombuffer(blob, np.uint8)
    k = (n + 7) // 8
    if len(half) != 2 * k:
        raise RuntimeError("the scan gave other texts than before; store the input first")
    return np.unpackbits(half[:k], count=n).astype(bool), np.unpackbits(half[k:], count=n).astype(bool)


def placed(replies: list[tuple[int, bytes]], bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of each position, from (bucket, reply) pairs."""
    order, cut = dealt(bucket, n)
    a, b = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
    for k, blob in replies:
        if blob:
            at = order[cut[k] : cut[k + 1]]
            a[at], b[at] = _flags(blob, len(at))
    return a, b


def two_hops(sent: DataFrame, judge: Callable, dtype: str, second: bool, span: int, n_out: int) -> DataFrame:
    """Replies to messages to groups of buckets, by way of a second hop inside the groups."""
    outer, final = Blob(dtype, second, True), Blob(dtype, second, False)
    place = {int(x): g for g, x in enumerate(labels(n_out))}
    stretch = max(1, n_out // 4)  # scan tasks whose messages are dealt together

    def deal(t: pa.Table) -> pa.Table:
        lean()
        kind, chunk, ord_, dest = (t[c].to_numpy() for c in ("kind", "chunk", "ord", "dest"))
        blobs = t["blob"].to_pylist()
        rows = [(int(dest[i]), int(chunk[i]), 0, OUTER, blobs[i]) for i in np.flatnonzero(kind == DIRECTORY)]
        own = np.flatnonzero(kind == KEYS)
        own = own[np.lexsort((chunk[own], ord_[own]))]
        if len(own):
            g = int(dest[own[0]])
            key, extra, inner, counts = outer.read([blobs[i] for i in own])
            order, cut = dealt(inner, span)
            arrays = [a if a is None else a[order] for a in (key, extra)]
            me, first = -1 - ((place[g] << 32) | int(t["bin"][0].as_py())), int(ord_[own[0]])
            rows.append((g, me, first, DIRECTORY, pack((g, chunk[own], counts, inner))))
            rows += [(place[g] * span + b, me, first, KEYS, Blob.write(arrays, slice(cut[b], cut[b + 1]))) for b in range(span) if cut[b] < cut[b + 1]]
        return _message_table(rows)

    def undeal(t: pa.Table) -> pa.Table:
        kind, dest, blobs = t["kind"].to_numpy(), t["dest"].to_numpy(), t["blob"].to_pylist()
        rows = [(int(dest[i]), int(t["chunk"][int(i)].as_py()), 0, DIRECTORY, blobs[i]) for i in np.flatnonzero(kind == OUTER)]
        for here in np.flatnonzero(kind == DIRECTORY):
            g, chunk, counts, inner = unpack(blobs[here])
            a, b = placed([(int(dest[i]) - place[g] * span, blobs[i]) for i in np.flatnonzero(kind == KEYS)], inner, span)
            ends = np.cumsum(counts)
            rows += [(g, int(c), 0, KEYS, _bits(a[e - n : e], b[e - n : e])) for c, n, e in zip(chunk.tolist(), counts.tolist(), ends.tolist())]
        return _message_table(rows)

    binned = sent.withColumn("bin", F.expr(f"(chunk >> 24) div {stretch}"))
    inside = binned.groupBy("dest", "bin").applyInArrow(deal, MESSAGE)
    return answers(inside, judge, final).groupBy("chunk").applyInArrow(undeal, MESSAGE)


def exchange(docs: DataFrame, keys: Callable, judge: Callable, assemble: Callable, schema: str, dtype: str = "uint64", second: bool = False, n_buckets: int | None = None, either: int = 0, direct: int = DIRECT, ranges: DataFrame | None = None) -> DataFrame:
    """Run keys -> buckets -> answers -> chunks.

    ``judge(keys, second parts)`` gets the keys of one bucket in table order and returns two boolean arrays. The first is
    the answer for all positions of a key in a chunk, the second for the first of them.
    ``assemble(rid, doc_id, doc_id is null, counts, first flags, second flags, extras)`` returns a dict of columns.
    """
    n_buckets = n_buckets or buckets(docs.sparkSession)
    span = 1 if n_buckets <= direct else math.isqrt(n_buckets - 1) + 1
    n_out = -(-n_buckets // span)
    bucket_of = {int(x): b for b, x in enumerate(labels(n_out))}

    def gather(t: pa.Table) -> pa.Table:
        lean()
        kind, dest = t["kind"].to_numpy(), t["dest"].to_numpy()
        blobs = t["blob"].to_pylist()
        here = int(np.flatnonzero(kind == DIRECTORY)[0])
        rid, did, null, count, bucket, copy, of, notes = unpack(blobs[here])
        a, b = placed([(bucket_of[int(dest[i])], blobs[i]) for i in np.flatnonzero(kind == KEYS)], bucket, n_out)
        if len(copy):
            sent = np.ones(len(a) + len(copy), bool)
            sent[copy] = False
            wide_a, wide_b = np.zeros(len(sent), bool), np.zeros(len(sent), bool)
            wide_a[sent], wide_b[sent] = a, b
            wide_a[copy] = wide_a[of]
            a, b = wide_a, wide_b
        cols = assemble(rid, did, null, count, a, b, notes)
        return pa.table(cols)

    sent = messages(docs, keys, n_buckets, either, span, ranges)
    replies = answers(sent, judge, Blob(dtype, second, False)) if span == 1 else two_hops(sent, judge, dtype, second, span, n_out)
    return replies.groupBy("chunk").applyInArrow(gather, schema)


def doc_table(docs: DataFrame) -> DataFrame:
    """The columns that a scan needs; everything else is pruned from it."""
    return docs.select("__rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

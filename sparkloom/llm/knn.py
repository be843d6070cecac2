"""Operator 6: exact top-k search with a KD-tree in each shard.

Median splits of a bounded sample (``SAMPLE`` vectors; it decides only how even the shards are) cut
space into shards of about ``SHARD_ROWS`` vectors, or into ``MAX_SHARDS`` larger ones, which bounds the
boxes that are broadcast. Equal vectors, which no split can part, are one point with the k + 1 least of their
rows; a task joins those of its own rows before anything is shuffled. Each shard builds a KD-tree: median
splits on the widest side down to leaves of ``LEAF`` points, with the tight bounding box of every node.
The queries are the rows whose vec_id is divisible by ``EVERY``, against all rows; equal queries are
searched once. A query is searched in its own shard first; its k-th distance there is propagated: of the other
shards it visits the ``NEAREST`` ones whose boxes are within it, and then, with the k-th distance so tightened,
the rest whose boxes still are. A block of neighbouring queries traverses a tree best first by the distance
from box to query, and leaves out each node that is farther than a query's present k-th distance. Leaf distances
are screened with a matrix product and then computed as plain sums of squared differences, so the result is
exact. A shard that many queries visit is searched in parts of about ``MAX_QUERIES`` queries.

Defined results: Euclidean distance; ties by vec_id, then by distinct rows; a row is not its own
neighbour, but repeated rows are each other's; fewer than k others give fewer rows; null or empty vectors, and
those with null or non-finite entries, take no part; vectors of different length are not compared; a
null vec_id sorts last and is no query; vectors are told apart by a 128-bit hash; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, ship, stored, with_row_key

K, EVERY, SHARD_ROWS, MAX_SHARDS, LEAF, SAMPLE, BLOCK, NEAREST, MAX_QUERIES = 10, 20, 32_768, 65_536, 128, 131_072, 128, 4, 65_536
NONE = np.iinfo(np.int64).max


class Tree:
    """Nodes in arrays; a leaf holds rows order[a:b]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.kids: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        lo, hi = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.span)
            if parent >= 0:
                self.kids[parent] = (me, self.kids[parent][1]) if side == 0 else (self.kids[parent][0], me)
            rows = x[self.order[a:b]]
            low, high = rows.min(0), rows.max(0)
            lo.append(low)
            hi.append(high)
            self.span.append((a, b))
            self.kids.append((-1, -1))
            if b - a > leaf and (high > low).any():
                dim = int((high - low).argmax())
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, dim], m)]
                todo += [(a, a + m, me, 0), (a + m, b, me, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.norm = (x * x).sum(1)

    def search(self, q: np.ndarray, rid: np.ndarray, vid: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block of queries: (squared distance, vec_id, row key) of the nearest points, k columns, inf where there is none within the bound."""
        m = len(q)
        best = (np.full((m, k), np.inf), np.full((m, k), NONE), np.full((m, k), NONE))
        kth, qn = bound.copy(), (q * q).sum(1)
        slack = 1e-9 * (1 + qn.max() + self.norm.max())

        def gap(node: int, rows: np.ndarray) -> np.ndarray:
            d = np.maximum(np.maximum(self.lo[node] - q[rows], q[rows] - self.hi[node]), 0)
            return (d * d).sum(1)

        every = np.arange(m)
        g = gap(0, every)
        heap = [(float(g.min()), 0, every[g <= kth], g[g <= kth])]
        while heap:
            _, node, rows, g = heapq.heappop(heap)
            rows = rows[g <= kth[rows] + slack]
            if not len(rows):
                continue
            if self.kids[node][0] >= 0:
                for kid in self.kids[node]:
                    g = gap(kid, rows)
                    ok = g <= kth[rows] + slack
                    if ok.any():
                        heapq.heappush(heap, (float(g[ok].min()), kid, rows[ok], g[ok]))
                continue
            a, b = self.span[node]
            at = self.order[a:b]
            near = qn[rows][:, None] + self.norm[at][None] - 2 * (q[rows] @ self.x[at].T)
            i, j = np.nonzero(near <= kth[rows][:, None] + slack)
            if not len(i):
                continue
            diff = q[rows[i]] - self.x[at[j]]
            d = (diff * diff).sum(1)
            self._merge(best, kth, bound, rows[i], d, vid[at[j]], rid[at[j]], k)
        return best

    @staticmethod
    def _merge(best: tuple, kth: np.ndarray, bound: np.ndarray, row: np.ndarray, d: np.ndarray, v: np.ndarray, r: np.ndarray, k: int) -> None:
        touched = np.unique(row)
        old = [a[touched] for a in best]
        row = np.concatenate([np.repeat(touched, k), row])
        d, v, r = (np.concatenate([o.ravel(), n]) for o, n in zip(old, (d, v, r)))
        order = np.lexsort((r, v, d, row))
        row, d, v, r = row[order], d[order], v[order], r[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        take = (first[:, None] + np.arange(k)[None]).ravel()  # each row has k entries at least
        for a, n in zip(best, (d, v, r)):
            a[touched] = n[take].reshape(-1, k)
        kth[touched] = np.minimum(bound[touched], best[0][touched, k - 1])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    n = len(col)
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(n, -1)


def _flat(lists: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def joined(h1: np.ndarray, h2: np.ndarray, sizes: np.ndarray, vid: np.ndarray, rid: np.ndarray, asked: np.ndarray, keep: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Equal keys made one: (index of one entry of each, its ``keep`` least (vec_id, row key), whether any is asked). Entry i has sizes[i] of vid and rid."""
    order = np.lexsort((h2, h1))
    new = np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])
    group = np.empty(len(h1), np.int64)
    group[order] = np.cumsum(new) - 1
    owner = np.repeat(group, sizes)
    by = np.lexsort((rid, vid, owner))
    owner, vid, rid = owner[by], vid[by], rid[by]
    start = np.searchsorted(owner, np.arange(owner[-1] + 2))
    return order[new], [vid[a : min(b, a + keep)] for a, b in zip(start, start[1:])], [rid[a : min(b, a + keep)] for a, b in zip(start, start[1:])], np.bincount(group, asked) > 0


def nearest_rows(tree: Tree, vids: list[np.ndarray], rids: list[np.ndarray], q: np.ndarray, k: int, bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest rows (squared distance, vec_id, row key) of each query, of points that stand for rows: in order, within the bound."""
    vid, rid = np.array([v[0] for v in vids]), np.array([r[0] for r in rids])
    point = np.argsort(rid)
    sorted_rid = rid[point]
    out: list = [None] * len(q)
    by = Tree(q, BLOCK).order if len(q) > BLOCK else np.arange(len(q))
    for a in range(0, len(q), BLOCK):
        rows = by[a : a + BLOCK]
        for i, d, v, r in zip(rows, *tree.search(q[rows], rid, vid, k, bound[rows])):
            n = int(np.isfinite(d).sum())
            at = point[np.searchsorted(sorted_rid, r[:n])]
            if sum(len(rids[j]) for j in at) > n:  # some points are several rows
                d = np.repeat(d[:n], [len(rids[j]) for j in at])
                v, r = np.concatenate([vids[j] for j in at]), np.concatenate([rids[j] for j in at])
                o = np.lexsort((r, v, d))[:k]
                d, v, r = d[o], v[o], r[o]
                n = len(d)
            out[i] = (d[:n], v[:n], r[:n])
    return out


def split_space(sample: np.ndarray, shards: int) -> list[tuple]:
    """Median splits as nodes (dimension, value, left, right), or (-1, shard, 0, 0)."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, first: int, count: int) -> int:
        me = len(nodes)
        nodes.append((-1, first, 0, 0))
        if count > 1 and len(rows) > 1 and (spread := np.ptp(rows, axis=0)).max() > 0:
            dim, left = int(spread.argmax()), count // 2
            cutoff = float(np.quantile(rows[:, dim], left / count))
            side = rows[:, dim] <= cutoff
            nodes[me] = (dim, cutoff, build(rows[side], first, left), build(rows[~side], first + left, count - left))
        return me

    build(sample, 0, shards)
    return nodes


def shard_of(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        dim, value, left, right = nodes[node]
        if dim < 0:
            out[rows] = value
        elif len(rows):
            side = x[rows, dim] <= value
            todo += [(left, rows[side]), (right, rows[~side])]
    return out


POINTS = "dims int, shard int, h1 long, h2 long, x {x}, vids array<long>, rids array<long>, asked boolean"
HOME = POINTS + ", dist array<double>, near array<long>, near_rid array<long>"
FOUND = "h1 long, h2 long, dist array<double>, near array<long>, near_rid array<long>"


def _found(h1: pa.Array, h2: pa.Array, got: list[tuple]) -> dict:
    return {"h1": h1, "h2": h2} | {name: _flat([g[i] for g in got]).cast(pa.list_(kind)) for i, (name, kind) in enumerate((("dist", pa.float64()), ("near", pa.int64()), ("near_rid", pa.int64())))}


def top_k(embeddings: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, every: int = EVERY, nearest: int = NEAREST, max_queries: int = MAX_QUERIES) -> DataFrame:
    """The k nearest other vectors of each row of ``embeddings(vec_id, embedding)`` whose vec_id is divisible by ``every``: vec_id, rank (from 1), neighbor_id, distance (6 digits)."""
    spark = embeddings.sparkSession
    ship(spark)
    v = pick(embeddings, "vec_id", "embedding")
    kind = v.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    v = with_row_key(v).select(F.col("__rid").alias("rid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NONE) - 1)).alias("vec_id"), F.coalesce(F.col("vec_id").cast("long") % every == 0, F.lit(False)).alias("asked"), F.col("embedding").cast(kind).alias("x"))
    v = v.where(F.size("x") > 0).where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    v = v.withColumn("x", F.transform("x", lambda e: e + zero)).withColumns({"dims": F.size("x"), "h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(7), "x")})  # -0.0 + 0.0 is 0.0
    plans, asked = {}, 0
    for r in v.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("asked")).collect():  # one row for each length of vectors
        asked += r["asked"]
        shards = min(MAX_SHARDS, -(-r["n"] // shard_rows))
        share = min(1.0, min(SAMPLE, 64 * shards) / r["n"])
        sample = v.where((F.col("dims") == r["dims"]) & (F.xxhash64("rid") <= int((share - 0.5) * (2.0**64 - 4096)))).select("x").collect() if shards > 1 else []
        plans[r["dims"]] = split_space(np.array([s["x"] for s in sample], np.float64).reshape(-1, r["dims"]), shards)
    layout = spark.sparkContext.broadcast(plans)
    shards_in_all = sum(sum(n[0] < 0 for n in p) for p in plans.values())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t["dims"].to_numpy()
            for d in np.unique(dims):
                part = t.filter(pa.array(dims == d))
                h1, h2, vid, rid, ask = (part[c].to_numpy() for c in ("h1", "h2", "vec_id", "rid", "asked"))
                one, vids, rids, any_ = joined(h1, h2, np.ones(len(h1), int), vid, rid, ask, k + 1)
                part = part.take(pa.array(one))
                shard = shard_of(_matrix(part["x"]), layout.value[int(d)])
                yield from pa.table([part["dims"], pa.array(shard), part["h1"], part["h2"], part["x"], _flat(vids), _flat(rids), pa.array(any_)], names=["dims", "shard", "h1", "h2", "x", "vids", "rids", "asked"]).combine_chunks().to_batches()

    def home(t: pa.Table) -> pa.Table:
        lists = {c: t[c].combine_chunks() for c in ("vids", "rids")}
        sizes = np.asarray(lists["vids"].value_lengths())
        one, vids, rids, ask = joined(t["h1"].to_numpy(), t["h2"].to_numpy(), sizes, *(x.flatten().to_numpy() for x in lists.values()), t["asked"].to_numpy(), k + 1)
        t = t.take(pa.array(one))
        x, q = _matrix(t["x"]), np.flatnonzero(ask)
        empty = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        got: list = [empty] * len(t)
        if len(q):
            for i, g in zip(q, nearest_rows(Tree(x), vids, rids, x[q], k + 1, np.full(len(q), np.inf))):
                got[i] = g
        return pa.table({"dims": t["dims"], "shard": t["shard"], "x": t["x"], "vids": _flat(vids), "rids": _flat(rids), "asked": pa.array(ask)} | _found(t["h1"], t["h2"], got)).select([c.split()[0] for c in HOME.split(", ")])

    first = stored(v.mapInArrow(place, POINTS.format(x=kind)).groupBy("dims", "shard").applyInArrow(home, HOME.format(x=kind)))
    found = first.where("asked").select("h1", "h2", "dist", "near", "near_rid")
    if shards_in_all > len(plans):
        found = elsewhere(first, kind, k, nearest, max(1, math.ceil(asked / max_queries)))
    queries = v.where("asked").select("rid", "vec_id", "h1", "h2")
    out = queries.join(found.select("h1", "h2", F.arrays_zip("dist", "near", "near_rid").alias("p")), ["h1", "h2"])
    out = out.select("vec_id", F.posexplode(F.slice(F.filter("p", lambda p: p["near_rid"] != F.col("rid")), 1, k)).alias("i", "p"))
    real = lambda c: F.when(c < int(NONE) - 1, c)
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("rank"), real(F.col("p.near")).alias("neighbor_id"), F.round(F.sqrt("p.dist"), 6).alias("distance"))


def elsewhere(first: DataFrame, kind: str, k: int, nearest: int, blocks: int) -> DataFrame:
    """(h1, h2, dist, near, near_rid) of each query in the points of all shards, from the results of ``home``: two waves over the other shards."""
    spark = first.sparkSession

    def box(t: pa.Table) -> pa.Table:
        x = _matrix(t["x"])
        return pa.table({"dims": t["dims"][:1], "shard": t["shard"][:1], "lo": pa.array([x.min(0).tolist()]), "hi": pa.array([x.max(0).tolist()])})

    def boxes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t["dims"].to_numpy().astype(np.int64) << 32 | t["shard"].to_numpy()
            for one in np.unique(key):
                yield from box(t.filter(pa.array(key == one))).combine_chunks().to_batches()

    # a box of each batch of a shard; at most MAX_SHARDS boxes of each length after the union of these
    part = first.select("dims", "shard", "x").mapInArrow(boxes_of, "dims int, shard int, lo array<double>, hi array<double>")
    sides = part.select("dims", "shard", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "s")).groupBy("dims", "shard", "i").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    rows = sides.groupBy("dims", "shard").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b")).collect()
    boxes: dict[int, tuple] = {}
    for d in {r["dims"] for r in rows}:
        mine = sorted((r for r in rows if r["dims"] == d), key=lambda r: r["shard"])
        boxes[d] = (np.array([r["shard"] for r in mine], np.int32), np.array([[s["lo"] for s in r["b"]] for r in mine]), np.array([[s["hi"] for s in r["b"]] for r in mine]))
    shapes = spark.sparkContext.broadcast(boxes)
    schema = f"dims int, shard int, block int, h1 long, h2 long, x {kind}, kth double"

    def route(wave: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = pa.Table.from_batches([batch])
                dims, own, kth, h1 = (t[c].to_numpy() for c in ("dims", "shard", "kth", "h1"))
                start = t["start"].to_numpy()
                for d in np.unique(dims):
                    ids, lo, hi = shapes.value[int(d)]
                    every, x = np.flatnonzero(dims == d), _matrix(t.filter(pa.array(dims == d))["x"])
                    step = max(1, 4_000_000 // lo.size)
                    for a in range(0, len(every), step):
                        rows, q = every[a : a + step], x[a : a + step]
                        gap = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0)
                        gap = np.einsum("qsd,qsd->qs", gap, gap)
                        gap[ids[None] == own[rows][:, None]] = np.inf
                        # the nearest boxes within the bound of the first wave are what that wave visited
                        rank = np.argsort(np.argsort(gap, 1, kind="stable"), 1, kind="stable")
                        early = (rank < nearest) & (gap <= start[rows][:, None] * (1 + 1e-9))
                        go = early if wave == 0 else (gap <= kth[rows][:, None] * (1 + 1e-9)) & ~early
                        i, s = np.nonzero(go & np.isfinite(gap))
                        if len(i):
                            p = t.take(pa.array(rows[i]))
                            yield from pa.table([p["dims"], pa.array(ids[s]), pa.array((h1[rows[i]] % blocks).astype(np.int32)), p["h1"], p["h2"], p["x"], p["kth"]], names=["dims", "shard", "block", "h1", "h2", "x", "kth"]).combine_chunks().to_batches()

        return run

    def visit(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return pa.table(_found(pa.array([], pa.int64()), pa.array([], pa.int64()), []))
        lists = [np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (points["vids"].combine_chunks(), points["rids"].combine_chunks())]
        got = nearest_rows(Tree(_matrix(points["x"])), *lists, _matrix(queries["x"]), k + 1, queries["kth"].to_numpy() * (1 + 1e-9))
        return pa.table(_found(queries["h1"], queries["h2"], got))

    points = first.select("dims", "shard", "x", "vids", "rids").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kth = F.when(F.size("dist") > k, F.element_at("dist", k + 1)).otherwise(F.lit(float("inf"))).alias("kth")
    asks = first.where("asked").select("dims", "shard", "h1", "h2", "x", kth)
    found = first.where("asked").select("h1", "h2", "dist", "near", "near_rid")
    for wave in range(2):
        if wave:
            asks = asks.withColumnRenamed("kth", "start").join(found.select("h1", "h2", kth), ["h1", "h2"])
        else:
            asks = asks.withColumn("start", F.col("kth"))
        sent = asks.select("dims", "shard", "h1", "h2", "x", "kth", "start").mapInArrow(route(wave), schema)
        away = points.groupBy("dims", "shard", "block").cogroup(sent.groupBy("dims", "shard", "block")).applyInArrow(visit, FOUND)
        both = found.union(away.where(F.size("dist") > 0)).groupBy("h1", "h2").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("dist", "near", "near_rid")))), 1, k + 1).alias("p"))
        found = stored(both.select("h1", "h2", *[F.col(f"p.{c}").alias(c) for c in ("dist", "near", "near_rid")]))
        asks = asks.drop("start") if wave == 0 else asks
        if max(len(b[0]) for b in boxes.values()) - 1 <= nearest:
            break  # the first wave had all boxes
    return found

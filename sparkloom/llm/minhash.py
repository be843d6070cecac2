"""Operator 9: near-duplicate documents by circulant MinHash.

Shingles are runs of ``SHINGLE`` lower-cased words. Two permutations of the 2**32 hash values make
all signature coordinates (Li and Li, C-MinHash): sigma is applied once, and coordinate k is the
minimum of pi circularly shifted by k, i.e. of pi(sigma(x) + k mod 2**32). Both are bijections
computed in 32-bit lanes, so no table of them is kept. Signatures are cut into bands; texts that
share a band are candidates. Texts with equal shingle sets are joined first, whatever their number, and only one
of them goes through the bands. In a bucket of a band, texts are linked that agree in ``PLAUSIBLE`` of their
coordinates (one byte of each), far below the threshold, so that chance candidates do not grow into large groups;
buckets of more than ``BUCKET`` texts are linked whole. The groups so connected are verified with exact Jaccard
similarities of the whole shingle sets, breadth first: each text that was reached is compared with all
that were not, so the components are those of all pairs at or above the threshold, without listing the
pairs of a large group. A group of over ``BLOCK`` texts is verified in blocks, each beside the first text of the group;
texts that are not linked to that one are then compared, in batches, with all blocks, which leaves out no pair
that could join two components.

:func:`near_duplicates` also counts the links of each document, i.e. all other documents at or above the threshold in its
group, copies included: all pairs of different texts of a group are compared, in a group of over ``BLOCK`` texts
every two of its half blocks. None of them is written out. :func:`near_dedup` needs no counts and leaves these comparisons out.

Defined results: a text of fewer than ``SHINGLE`` words is one shingle of all its words; null and
empty texts belong to no group and have no row; repeated rows are copies of each other; a group keeps the row of the
least doc_id (null last, then table order); other columns are ignored, or kept by :func:`near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, lean, masked, pick, ship, stored, with_row_key
from ._lookup import looked_up
from ._tokens import Words, mix64, slices, string_buffers, window_hashes
from .components import components

SHINGLE, BANDS, ROWS, JACCARD, PLAUSIBLE, BUCKET, BLOCK = 3, 48, 4, 0.5, 0.3, 20_000, 4096
BITMAP = 64 << 20  # bytes
SIGNED = "__rid long, doc_id long, f1 long, f2 long, bands array<long>, sig binary"


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit values."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return x


def signatures(x: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Circulant MinHash: row i is the i-th coordinate of every set; sets are runs of x that begin at ``starts``."""
    x = sigma(x)
    y, z = np.empty_like(x), np.empty_like(x)
    out = np.empty((k, len(starts)), np.uint32)
    for i in range(k):
        np.add(x, np.uint32(i), out=y)  # the circular shift
        for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(y, np.uint32(shift), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(mult), out=y)
        np.right_shift(y, np.uint32(16), out=z)
        np.bitwise_xor(y, z, out=y)
        np.minimum.reduceat(y, starts, out=out[i])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, one row per set."""
    key = np.empty((sig.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(sig.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r].astype(np.uint64))
        key[:, b] = h
    return key


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Words(raw, off)
    th = words.hashes()
    (h,) = window_hashes(th, (n,))
    out = []
    for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist()):
        if b - a >= n:
            x = np.sort(h[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(window_hashes(th[a:b], (b - a,))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Key, fingerprint of the shingle set and band keys of each text that has words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rid, did = batch.column(0), batch.column(1)
            raw, off = string_buffers(batch.column(2))
            for a, b, r, o in slices(raw, off, 400_000):
                sets = shingle_sets(r, o, shingle)
                live = np.flatnonzero([len(s) > 0 for s in sets])
                if not len(live):
                    continue
                sizes = np.array([len(sets[i]) for i in live])
                starts = np.cumsum(sizes) - sizes
                x = np.concatenate([sets[i] for i in live])
                sig = signatures((x >> np.uint64(32)).astype(np.uint32), starts, bands * rows)
                keys = band_keys(sig, bands, rows)
                low = pa.array([c.tobytes() for c in sig.T.astype(np.uint8)], pa.binary())
                f1 = np.add.reduceat(mix64(x ^ np.uint64(0x1234567)), starts)
                f2 = np.bitwise_xor.reduceat(mix64(x + np.uint64(0x7654321)), starts)
                take = pa.array(live + a)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([rid.take(take), did.take(take), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, low], names=["__rid", "doc_id", "f1", "f2", "bands", "sig"])

    return _lowered(docs).mapInArrow(run, SIGNED)


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select("__rid", F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))


def within(x: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, which: np.ndarray, jaccard: float) -> np.ndarray:
    """Those of the sets ``which`` whose Jaccard similarity with x reaches the threshold."""
    small, large = np.minimum(sizes[which], len(x)), np.maximum(sizes[which], len(x))
    near = which[small >= jaccard * large]
    hit = [np.zeros(0, np.int64)]
    for at in range(0, len(near), 256):
        part = near[at : at + 256]
        flat = np.concatenate([sets[j] for j in part])
        pos = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        starts = np.cumsum(sizes[part]) - sizes[part]
        both = np.add.reduceat((x[pos] == flat).astype(np.int64), starts)
        hit.append(part[both >= jaccard * (sizes[part] + len(x) - both)])
    return np.concatenate(hit)


def groups_in(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """Component of each set (the least index), over all pairs whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])

    def reach(i: int, left: np.ndarray) -> np.ndarray:
        return within(sets[i], sets, sizes, left, jaccard)

    return spread(len(sets), reach)


def spread(n: int, reach) -> np.ndarray:  # noqa: ANN001
    """Component of each of n items (the least index); ``reach(i, left)`` gives those of ``left`` that are linked to i."""
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        queue = [root]
        left = np.flatnonzero(label < 0)
        while queue and len(left):
            hit = reach(queue.pop(), left)
            if len(hit):
                label[hit] = root
                queue += hit.tolist()
                left = left[label[left] < 0]
    return label


def neighbours(sets: list[np.ndarray], jaccard: float, split: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Each pair of sets at or above the threshold once: (i, those after it). With ``split``, only pairs across it.

    Where many sets share few shingles, the shared ones are bits of a matrix, and a row of it is compared with all others at once.
    """
    n, sizes, bits = len(sets), np.array([len(s) for s in sets]), None
    if n > 16:
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[col]
        width = -(-(int(place.max()) + 1) // 64)
        if width * 8 * n < BITMAP and width * 64 < 800 * len(col) / n:
            bits = np.zeros((n, width * 8), np.uint8)
            for i, end in enumerate(np.cumsum(sizes).tolist()):
                row, at = np.zeros(width * 64, np.uint8), place[end - sizes[i] : end]
                row[at[at >= 0]] = 1
                bits[i] = np.packbits(row)
            bits = bits.view(np.uint64)
    for i in range(split or n):
        after = max(i + 1, split)
        if bits is None:
            yield i, within(sets[i], sets, sizes, np.arange(after, n), jaccard)
        else:
            both = np.bitwise_count(bits[after:] & bits[i]).sum(1, dtype=np.int64)
            yield i, np.flatnonzero(both >= jaccard * (sizes[after:] + sizes[i] - both)) + after


def linked_in(sets: list[np.ndarray], jaccard: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each set (the least index) and its links; ``weights`` documents share a set, and are linked to each other."""
    label, links = np.arange(len(sets)), weights - 1
    for i, hit in neighbours(sets, jaccard):
        links[i] += weights[hit].sum()
        links[hit] += weights[i]
        other = label[hit][label[hit] != label[i]]
        if len(other):
            roots = np.append(np.unique(other), label[i])
            label[np.isin(label, roots)] = roots.min()
    return label, links


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, __rid, sig) rows ordered by band -> edges (a, b) that connect what may be similar in each bucket."""

    def edges(band: np.ndarray, rid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        need = PLAUSIBLE * sig.shape[1]
        start = np.flatnonzero(np.diff(band, prepend=band[0] - 1))
        size = np.diff(np.append(start, len(band)))
        two = start[size == 2]
        ok = (sig[two] == sig[two + 1]).sum(1) >= need
        out = [np.stack([rid[two[ok]], rid[two[ok] + 1]], 1)]
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            s = sig[a : a + n]
            label = spread(n, lambda i, left, s=s: left[(s[left] == s[i]).sum(1) >= need])
            out.append(np.stack([rid[a : a + n], rid[a + label]], 1)[label != np.arange(n)])
        pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, _ = string_buffers(batch.column(2))
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw.reshape(batch.num_rows, -1))
        cols = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
        end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
        if end:
            yield edges(*(c[:end] for c in cols))
        rest = tuple(c[end:] for c in cols)
    if rest is not None:
        yield edges(*rest)


def candidates(sigs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, component) of the texts of ``sigs(__rid, bands, sig)`` that bands and signatures connect."""
    bands = sigs.select("__rid", F.explode("bands").alias("band"))
    heads = cut(bands.groupBy("band").agg(F.min("__rid").alias("head"), F.count("*").alias("n")).where("n > 1"))
    inside = bands.join(heads, "band")
    whole = inside.where((F.col("n") > bucket) & (F.col("__rid") != F.col("head"))).select(F.col("__rid").alias("a"), F.col("head").alias("b"))
    small = inside.where(F.col("n") <= bucket).select("__rid", "band").join(sigs.select("__rid", "sig"), "__rid")
    some = small.select("band", "__rid", "sig").repartition("band").sortWithinPartitions("band").mapInArrow(plausible, "a long, b long")
    return components(whole.union(some))


VERIFIED = "__rid long, doc_id long, lead long, component long, weight long, links long"


def verified(keyed: DataFrame, comp: DataFrame, weights: DataFrame, shingle: int, jaccard: float, block: int = BLOCK, counts: bool = False) -> DataFrame:
    """(__rid, doc_id, lead, weight, links): the component under the exact similarity of each text of the candidate groups, named by a member.

    ``weights(node, weight)`` says how many documents share a text, where these are several; links are null without ``counts``.
    """
    sizes = cut(comp.groupBy("component").agg(F.count("*").alias("n")))
    placed = comp.join(sizes, "component").join(weights, "node", "left").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # the first text of a group stands in each of its blocks
    part = F.explode(F.when(F.col("node") == F.col("component"), every).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))).alias("part")
    placed = placed.select("node", "component", "parts", F.coalesce("weight", F.lit(1)).alias("weight"), part)
    texts = _lowered(keyed.where(looked_up(comp.select("node", "component"), F.col("__rid")).isNotNull()))
    rows = texts.join(placed.withColumnRenamed("node", "__rid"), "__rid")

    def sets_of(t: pa.Table) -> list[np.ndarray]:
        raw, off = string_buffers(t["text"])
        return [x for _, _, r, o in slices(raw, off) for x in shingle_sets(r, o, shingle)]

    def verify(t: pa.Table) -> pa.Table:
        lean()
        t = t.sort_by("__rid")
        if counts and t["parts"][0].as_py() == 1:
            label, links = linked_in(sets_of(t), jaccard, t["weight"].to_numpy())
            links = pa.array(links)
        else:
            label, links = groups_in(sets_of(t), jaccard), pa.nulls(len(t), pa.int64())
        return pa.table({"__rid": t["__rid"], "doc_id": t["doc_id"], "lead": t["__rid"].take(pa.array(label)), "component": t["component"], "weight": t["weight"], "links": links})

    first = stored(rows.groupBy("component", "part").applyInArrow(verify, VERIFIED))
    large = sizes.where(F.col("n") > block)
    if not large.count():
        return first.drop("component")
    big = first.join(large.select("component"), "component", "left_semi")
    rest = cut(big.where("lead <> component").select("__rid", "lead", "component"))
    left = rest.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("batches"))
    members = rows.join(left, "component").join(big.select("__rid", "component", "lead").distinct(), ["__rid", "component"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    asks = texts.join(rest, "__rid").join(left, "component").join(placed.groupBy("component").agg(F.max("part").alias("last")), "component")
    asks = asks.withColumn("batch", F.pmod(F.xxhash64("__rid"), F.col("batches")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))

    def cross(a: pa.Table, b: pa.Table) -> pa.Table:
        found = set()
        if len(a) and len(b):
            sets, lead = sets_of(b), b["lead"].to_numpy()
            sizes_ = np.array([len(s) for s in sets])
            for x, mine in zip(sets_of(a), a["lead"].to_pylist()):
                found |= {(mine, int(y)) for y in np.unique(lead[within(x, sets, sizes_, np.arange(len(sets)), jaccard)]) if y != mine}
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    key = ["component", "part", "batch"]
    asks = asks.select(*[F.col(c).alias(c) for c in (*key, "text", "lead")])  # new columns, not those of members
    more = asks.groupBy(*key).cogroup(members.select(*key, "text", "lead").groupBy(*key)).applyInArrow(cross, "a long, b long")
    joined = components(big.select(F.col("__rid").alias("a"), F.col("lead").alias("b")).union(more)).withColumnRenamed("component", "joined")
    out = big.select("__rid", "doc_id", "lead", "weight").distinct().join(joined.withColumnRenamed("node", "__rid"), "__rid", "left")
    out = out.select("__rid", "doc_id", F.coalesce("joined", "lead").alias("lead"), "weight")
    if counts:
        out = cut(out)
        out = out.join(_counted(texts, out, sets_of, jaccard, block), "__rid", "left")
    else:
        out = out.withColumn("links", F.lit(None).cast("long"))
    out = out.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    return first.join(large.select("component"), "component", "left_anti").drop("component").unionByName(out)


def _counted(texts: DataFrame, members: DataFrame, sets_of, jaccard: float, block: int) -> DataFrame:  # noqa: ANN001
    """(__rid, links) to other texts of the same component, over every two half blocks of it."""
    sizes = members.groupBy("lead").agg(F.ceil(F.count("*") * 2 / block).cast("int").alias("parts"))
    placed = members.join(sizes, "lead").withColumn("part", F.pmod(F.xxhash64("__rid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("__rid", "lead", "weight", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def count(t: pa.Table) -> pa.Table:
        lean()
        t = t.sort_by("part")
        lo, hi, w = t["lo"][0].as_py(), t["hi"][0].as_py(), t["weight"].to_numpy()
        split = int((t["part"].to_numpy() == lo).sum()) if lo < hi else 0
        links = np.zeros(len(t), np.int64)
        if lo == hi or 0 < split < len(t):
            for i, hit in neighbours(sets_of(t), jaccard, split):
                links[i] += w[hit].sum()
                links[hit] += w[i]
        return pa.table({"__rid": t["__rid"], "links": links})

    return texts.select("__rid", "text").join(placed, "__rid").groupBy("lead", "lo", "hi").applyInArrow(count, "__rid long, links long").groupBy("__rid").agg(F.sum("links").alias("links"))


def classed(keyed: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, jaccard: float = JACCARD, bucket: int = BUCKET, block: int = BLOCK, counts: bool = False) -> DataFrame:
    """(__rid, doc_id, kept, kept_doc_id, links) of each row of ``keyed`` (which has __rid) in a group of two or more; links only with ``counts``."""
    sigs = stored(signed(keyed, shingle, bands, rows))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid")
    classes = sigs.groupBy("f1", "f2").agg(F.min(rank).alias("rep"), F.count("*").alias("n")).where("n > 1").select("f1", "f2", "rep", "n")
    copies = stored(sigs.join(classes, ["f1", "f2"]).select("__rid", "doc_id", F.col("rep.__rid").alias("rep"), F.col("rep.doc_id").alias("rep_doc"), "n"))
    one = sigs.where(looked_up(copies.where("__rid <> rep").select("__rid", "rep"), F.col("__rid")).isNull())
    weights = copies.where("__rid = rep").select(F.col("rep").alias("node"), F.col("n").alias("weight"))
    lead = cut(verified(keyed, candidates(one, bucket), weights, shingle, jaccard, block, counts))
    best = lead.groupBy("lead").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1")
    near = lead.join(best, "lead").select("__rid", "doc_id", F.col("kept.__rid").alias("kept"), F.col("kept.doc_id").alias("kept_doc_id"), "links", "weight")
    of = near.select(F.col("__rid").alias("rep"), "kept", "kept_doc_id", "links")
    first = F.when(F.col("kept").isNull(), F.col("rep_doc")).otherwise(F.col("kept_doc_id"))
    same = copies.join(of, "rep", "left").select("__rid", "doc_id", F.coalesce("kept", "rep").alias("kept"), first.alias("kept_doc_id"), F.when(F.col("kept").isNull(), F.col("n") - 1).otherwise(F.col("links")).alias("links"))
    return near.where("weight = 1").drop("weight").unionByName(same)


def removals(keyed: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, jaccard: float = JACCARD, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(__rid, doc_id, kept, kept_doc_id) of each row of ``keyed`` (which has __rid) that duplicates the kept row of its group."""
    return classed(keyed, shingle, bands, rows, jaccard, bucket, block).where("__rid <> kept").drop("links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, jaccard: float = JACCARD) -> DataFrame:
    """Each document of ``docs(doc_id, text)`` that has a near or exact copy: doc_id, class_id (that of the kept document), links (its copies)."""
    return classed(with_row_key(pick(docs, "doc_id", "text")), shingle, bands, rows, jaccard, counts=True).select("doc_id", F.col("kept_doc_id").alias("class_id"), "links")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, jaccard: float = JACCARD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns stay."""
    docs, back = masked(docs, "doc_id", "text")
    keyed = with_row_key(docs)
    gone = removals(keyed, shingle, bands, rows, jaccard).select("__rid", "kept")
    return back(keyed.where(looked_up(gone, F.col("__rid")).isNull()))

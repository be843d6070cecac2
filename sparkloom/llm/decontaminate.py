"""Operator 3: benchmark decontamination by a broadcast set of normalised n-grams.

Texts are lower-cased and read as words of letters and digits (``_tokens.NORMAL_CLASS``). Every
n-gram of every benchmark item is hashed; the hash set goes to each task, behind a check of its size
(``max_broadcast_grams``; above it, the n-grams are matched with a shuffled join instead, with the
same result). Each task slides over all windows of its whole texts, looks the rolling hash up in a
bit table and then in the set, and verifies each hit word by word. Overlapping hits form spans. A
text of which at least ``document_share`` of the words are in spans is removed, otherwise the spans are.

Defined results: an item of fewer than n words counts as one n-gram of its own length, one of fewer
than ``min_words`` words is ignored; null or empty texts and items have no hits; an empty benchmark
leaves all as it is; repeated rows are treated alike; a null item_id sorts last.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, masked, pick, ship
from ._tokens import NORMAL_CLASS, Words, normal_mask, slices, string_buffers, window_hashes

N, MIN_WORDS, DOCUMENT_SHARE, MAX_BROADCAST_GRAMS = 8, 5, 0.5, 2_000_000
SPANS = "doc_id long, start_token int, end_token int, n_hits int, item_id long, removal string"


def grams(benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct (width, gram, item_id: the least) of the benchmark."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(NORMAL_CLASS), F.lit(0))
    t = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), words.alias("w"))
    t = t.where(F.size("w") >= min_words).withColumn("width", F.least(F.lit(n), F.size("w")))
    t = t.select("item_id", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))).alias("gram"))
    return t.groupBy("width", "gram").agg(F.min("item_id").alias("item_id"))


def gram_index(rows: list) -> dict[int, tuple]:
    """width -> (bit table, sorted hashes, gram of each, item of each)."""
    by = defaultdict(list)
    for r in rows:
        by[r["width"]].append((r["gram"].encode(), r["item_id"]))
    index = {}
    for width, pairs in by.items():
        hs = []
        for g, _ in pairs:
            w = Words(np.frombuffer(g, np.uint8), np.array([0, len(g)]))
            hs.append(window_hashes(w.hashes(), (width,))[0][0])
        h = np.array(hs, np.uint64)
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 22, bool)
        bits[h >> np.uint64(42)] = True
        index[width] = (bits, h[order], [pairs[i][0] for i in order], [pairs[i][1] for i in order])
    return index


def hits_in(words: Words, index: dict[int, tuple]) -> dict[int, list[tuple[int, int, int | None]]]:
    """Verified hits by text: (first word, width, item)."""
    found: dict[int, list] = defaultdict(list)
    if not index or not len(words.starts):
        return found
    th = words.hashes()
    for width, (bits, hashes, texts, items) in index.items():
        (h,) = window_hashes(th, (width,))
        at = np.flatnonzero(bits[h >> np.uint64(42)])
        left = np.searchsorted(hashes, h[at], "left")
        ok = left < len(hashes)
        at, left = at[ok], left[ok]
        ok = hashes[left] == h[at]
        at, left = at[ok], left[ok]
        doc = np.searchsorted(words.doc, at, "right") - 1
        for p, k, d in zip(at.tolist(), left.tolist(), doc.tolist()):
            if p + width > words.doc[d + 1]:
                continue
            mine = b" ".join(words.raw[a:b].tobytes() for a, b in zip(words.starts[p : p + width], words.ends[p : p + width]))
            while k < len(hashes) and hashes[k] == h[p]:
                if texts[k] == mine:
                    found[d].append((p - int(words.doc[d]), width, items[k]))
                    break
                k += 1
    return found


def merge(hits: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int, int | None]]:
    """Spans (start, end, hits, least item) of the hits that overlap or touch."""
    out: list[list] = []
    for p, width, item in sorted(hits, key=lambda x: (x[0], x[1])):
        if out and p <= out[-1][1]:
            last = out[-1]
            last[1], last[2] = max(last[1], p + width), last[2] + 1
            last[3] = item if last[3] is None else last[3] if item is None else min(last[3], item)
        else:
            out.append([p, p + width, 1, item])
    return [tuple(x) for x in out]


def _lower(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__low", F.lower(F.col("text")))


def _index(benchmark: DataFrame, n: int, min_words: int, limit: int) -> dict[int, tuple] | None:
    g = grams(benchmark, n, min_words)
    rows = g.limit(limit + 1).collect()
    return None if len(rows) > limit else gram_index(rows)


def _joined_hits(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int) -> DataFrame:
    """docs with __hits, found with a shuffled join of all windows (for a benchmark too large to broadcast)."""
    from ._common import with_row_key

    g = grams(benchmark, n, min_words)
    keyed = with_row_key(docs)
    words = F.regexp_extract_all(F.lower("text"), F.lit(NORMAL_CLASS), F.lit(0))
    widths = [r[0] for r in g.select("width").distinct().orderBy("width").collect()]
    w = keyed.select("__rid", words.alias("w")).select("__rid", "w", F.explode(F.array(*[F.lit(x) for x in widths]) if widths else F.array().cast("array<int>")).alias("width"))
    w = w.where(F.size("w") >= F.col("width")).select("__rid", "width", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))).alias("pos", "gram"))
    found = w.join(g, ["width", "gram"]).groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "item_id"))).alias("__hits"))
    return keyed.join(found, "__rid", "left").drop("__rid")


def _scan(docs: DataFrame, index: dict | None, emit: Callable, schema) -> DataFrame:  # noqa: ANN001
    """Run ``emit(batch, row of each, hits of each, words of each)`` over the texts."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(index) if index is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        grams_ = shared.value if shared is not None else None
        for batch in batches:
            raw, off = string_buffers(batch.column(batch.schema.get_field_index("__low")))
            given = batch.column(batch.schema.get_field_index("__hits")).to_pylist() if grams_ is None else None
            rows, found, counts = [], [], []
            for a, b, r, o in slices(raw, off):
                if grams_ is None:
                    local = {i - a: [(h["pos"], h["width"], h["item_id"]) for h in given[i]] for i in range(a, b) if given[i]}
                    if not local:
                        continue
                    words = Words(r, o, normal_mask(r))
                else:
                    words = Words(r, o, normal_mask(r))
                    local = hits_in(words, grams_)
                for i in sorted(local):
                    rows.append(a + i)
                    found.append(local[i])
                    counts.append(int(words.doc[i + 1] - words.doc[i]))
            yield emit(batch, rows, found, counts)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, document_share: float = DOCUMENT_SHARE, max_broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """Spans of ``docs(doc_id, text)`` that repeat the benchmark: doc_id, start_token, end_token (exclusive), n_hits, item_id (the least), removal ('span' or 'document')."""
    index = _index(benchmark, n, min_words, max_broadcast_grams)
    few = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = _lower(few if index is not None else _joined_hits(few, benchmark, n, min_words)).drop("text")

    def emit(batch: pa.RecordBatch, rows: list, found: list, counts: list) -> pa.RecordBatch:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        out: list[tuple] = []
        for i, hits, n_words in zip(rows, found, counts):
            spans = merge(hits)
            all_ = sum(e - s for s, e, _, _ in spans) >= document_share * n_words
            out += [(ids[i].as_py(), s, e, k, item, "document" if all_ else "span") for s, e, k, item in spans]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        cols = list(zip(*out)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "start_token", "end_token", "n_hits", "item_id", "removal"])

    return _scan(few, index, emit, SPANS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, document_share: float = DOCUMENT_SHARE, max_broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """``docs`` without contaminated texts or spans; the columns stay, n_chars (if there) follows the text."""
    from ._rewrite import without_words_of
    from .suffix_dedup import with_lengths

    docs, back = masked(docs, "doc_id", "text", "n_chars")
    index = _index(benchmark, n, min_words, max_broadcast_grams)
    few = docs if index is not None else _joined_hits(docs, benchmark, n, min_words)
    few = few.select(*[F.col(f"`{c}`") for c in few.columns])
    keep = [c for c in few.columns if c != "__hits"]
    plan = _lower(few)
    at_text = docs.columns.index("text")

    def emit(batch: pa.RecordBatch, rows: list, found: list, counts: list) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        gone, new = np.zeros(batch.num_rows, bool), {}
        for i, hits, n_words in zip(rows, found, counts):
            spans = merge(hits)
            if sum(e - s for s, e, _, _ in spans) >= document_share * n_words:
                gone[i] = True
            else:
                new[i] = without_words_of(text[i].as_py(), [(s, e) for s, e, _, _ in spans])
        cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
        if new:
            # texts that stay are taken over by position, so that only the changed ones are built anew
            both = pa.chunked_array([text, pa.array(list(new.values()), text.type)]).combine_chunks()
            where = np.arange(batch.num_rows)
            where[list(new)] = batch.num_rows + np.arange(len(new))
            cols[at_text] = both.take(pa.array(where))
        out = pa.RecordBatch.from_arrays(cols, names=keep)
        return out.filter(pa.array(~gone)) if gone.any() else out

    return back(with_lengths(_scan(plan, index, emit, docs.schema), docs))

"""Vocabulary learners for the four methods.

The distributed part ends at a table of distinct words with frequencies (or of n-gram and piece
counts), bounded by ``min_count``. The order of merges is inherently sequential; it runs on the
driver with a heap of pair counts and an index from pairs to words, which equals a full recount.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charsmap import CharsMap, normalize
from ..functions.text import split_text, split_text_cn
from ..session import ship
from ..sources.model import BYTE, CounterSpec, Model, NormalizerSpec, Piece, assemble, meta_pieces
from .counting import ngram_logprob, raw_count, required_chars
from .counting import byte_ngrams as count_ngrams
from .shared import build_shared, read_shared, write_shared
from .unigram import Unigram, on_grid, segment

EXTRA = {"naive": 0, "piece": 3, "sentencepiece": 259, "bytepiece": 259}


class PairIndex:
    """Pair counts over weighted sequences, kept up to date through merges."""

    def __init__(self, words: Iterable[tuple[list[int], int]], allowed: Callable[[int, int], bool], key: Callable[[int, int], tuple]):
        self.seqs, self.freqs = [], []
        self.count: Counter = Counter()
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.allowed, self.key = allowed, key
        for seq, freq in words:
            i = len(self.seqs)
            self.seqs.append(seq)
            self.freqs.append(freq)
            for p in zip(seq, seq[1:]):
                if allowed(*p):
                    self.count[p] += freq
                    self.where[p].add(i)
        self.heap = [(-n, *key(*p), p) for p, n in self.count.items()]
        heapq.heapify(self.heap)

    def top(self) -> tuple[tuple[int, int], int] | None:
        """The pair of the highest count, ties by key; None when no count is above 0."""
        while self.heap:
            n, p = -self.heap[0][0], self.heap[0][-1]
            if n > 0 and self.count.get(p, 0) == n:
                return p, n
            heapq.heappop(self.heap)
        return None

    def drop(self, p: tuple[int, int]) -> None:
        self.count.pop(p, None)
        self.where.pop(p, None)

    def merge(self, p: tuple[int, int], new: int) -> None:
        """Only the pairs beside the merged ones change; ``where`` may also name words that lost the pair before."""
        a, b = p
        change: dict[tuple[int, int], int] = defaultdict(int)
        allowed: dict[tuple[int, int], bool] = {}
        for i in self.where.pop(p, ()):
            seq, freq = self.seqs[i], self.freqs[i]
            k, last, out = 0, len(seq) - 1, []
            while k <= last:
                c = seq[k]
                if c == a and k < last and seq[k + 1] == b:
                    if k:
                        change[seq[k - 1], a] -= freq
                        q = (out[-1], new)
                        if (ok := allowed.get(q)) is None:
                            ok = allowed[q] = self.allowed(*q)
                        if ok:
                            change[q] += freq
                            self.where[q].add(i)
                    out.append(new)
                    k += 2
                    if k <= last and not (seq[k] == a and k < last and seq[k + 1] == b):
                        c = seq[k]
                        change[b, c] -= freq
                        q = (new, c)
                        if (ok := allowed.get(q)) is None:
                            ok = allowed[q] = self.allowed(*q)
                        if ok:
                            change[q] += freq
                            self.where[q].add(i)
                else:
                    out.append(c)
                    k += 1
            self.seqs[i] = out
        self.count.pop(p, None)
        change.pop(p, None)
        for q, n in change.items():
            if n and (n > 0 or q in self.count):
                self.count[q] += n
                if self.count[q] > 0:
                    heapq.heappush(self.heap, (-self.count[q], *self.key(*q), q))


def f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def learn_bytes(words: Iterable[tuple[bytes, int]], merges: int, max_bytes: int) -> list[Piece]:
    """256 single bytes, then merges: most frequent first, ties by the bytes of left and right."""
    text = [bytes([b]) for b in range(256)]
    pieces = [Piece(t, -float(i)) for i, t in enumerate(text)]
    index = PairIndex(((list(w), f) for w, f in words), lambda a, b: len(text[a]) + len(text[b]) <= max_bytes, lambda a, b: (text[a], text[b]))
    while len(pieces) < merges and (top := index.top()):
        (a, b), _ = top
        new = len(text)
        text.append(text[a] + text[b])
        pieces.append(Piece(text[new], -float(len(pieces)), 1, text[a], text[b]))
        index.merge((a, b), new)
    return pieces


def learn_chars(words: Iterable[tuple[str, int]], required: list[tuple[str, int]], merges: int, max_bytes: int, unk: str) -> list[Piece]:
    """Merges over characters (ties: fewer characters, then the string), then the required characters."""
    text: list[str] = []
    ids: dict[str, int] = {}

    def char_id(c: str) -> int:
        if c not in ids:
            ids[c] = len(text)
            text.append(c)
        return ids[c]

    seqs = [([char_id(c) for c in w], f) for w, f in words]
    none = ids.get(unk, -1)
    index = PairIndex(seqs, lambda a, b: none not in (a, b) and len(text[a].encode()) + len(text[b].encode()) <= max_bytes, lambda a, b: (len(text[a]) + len(text[b]), (text[a] + text[b]).encode()))
    seen: set[str] = set()
    pieces: list[Piece] = []
    while len(pieces) < merges and (top := index.top()):
        (a, b), _ = top
        s = text[a] + text[b]
        if s in seen:  # found before by another path: not merged again
            index.drop((a, b))
            continue
        seen.add(s)
        pieces.append(Piece(s.encode(), -float(len(pieces))))
        new = len(text)
        text.append(s)
        index.merge((a, b), new)
    for c, _ in required:
        pieces.append(Piece(c.encode(), -float(len(pieces))))
    return pieces


def learn_text(text: bytes, merges: int) -> list[Piece]:
    """Merges over one whole text: the most frequent pair, the first in the text among equals, while it occurs twice."""
    names = [bytes([b]) for b in range(256)]
    ids = list(text)
    pieces = []
    for i in range(merges):
        counts: dict[tuple[int, int], int] = {}
        for p in zip(ids, ids[1:]):
            counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        best = max(counts, key=counts.__getitem__)  # dicts keep first-seen order, and max takes the first
        if counts[best] <= 1:
            break
        new = len(names)
        names.append(names[best[0]] + names[best[1]])
        pieces.append(Piece(names[new], -float(i), 1, names[best[0]], names[best[1]]))
        out, k = [], 0
        while k < len(ids):
            if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                out.append(new)
                k += 2
            else:
                out.append(ids[k])
                k += 1
        ids = out
    return pieces


def words_of(lines: DataFrame, normalizer: NormalizerSpec, min_count: int = 0, cn_dict: str | dict[bytes, float] | None = None, column: str = "line") -> DataFrame:
    """(word, freq) as the trainers see them; ``cn_dict``: None, 'no' (one token a Han character) or word frequencies."""
    from .codecs import cut_column

    if not cn_dict and CharsMap.named(normalizer.name).name == "no":
        out = raw_count(lines, normalizer.cut, normalizer.reconstruct, column=column).withColumnRenamed("token", "word")
        return out.where(F.col("freq") >= min_count) if min_count > 1 else out
    t = lines.where(F.length(column) > 0).select(normalize(F.col(column), CharsMap.named(normalizer.name), normalizer.reconstruct).alias("t"))
    if cn_dict is None or cn_dict == "":
        words = split_text(F.col("t"), normalizer.cut)
    elif cn_dict == "no":
        words = split_text_cn(F.col("t"), normalizer.cut)
    else:
        words = cut_column(F.col("t"), normalizer.cut, cn_dict)
    out = t.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return out.where(F.col("freq") >= min_count) if min_count > 1 else out


def evenly(df: DataFrame) -> DataFrame:
    """Spread a small but costly table over all tasks; adaptive execution would join its partitions by size."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def map_pieces(pieces: DataFrame, cut: Callable[[object, bytes], list[bytes]], build: Callable[[pa.Table], object], table: DataFrame) -> DataFrame:
    """(piece binary, cnt) of cutting every piece of ``pieces`` and adding up, with what ``build`` makes of the whole ``table`` in each task."""
    ship(pieces.sparkSession)
    _, files = write_shared(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = build_shared(files, build)
        for batch in batches:
            sums: dict[bytes, int] = defaultdict(int)
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in cut(value, p):
                    if t:
                        sums[t] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["piece", "cnt"])

    return evenly(pieces.select("piece", "cnt")).mapInArrow(run, "piece binary, cnt long").groupBy("piece").agg(F.sum("cnt").cast("long").alias("cnt"))


def _log_probs(t: pa.Table) -> dict[bytes, float]:
    return dict(zip(map(bytes.fromhex, t["gram"].to_pylist()), map(on_grid, t["logp"].to_pylist()))) if t.num_rows else {}


def _unigram(t: pa.Table) -> Unigram:
    return Unigram(dict(zip(t["piece"].to_pylist(), t["cnt"].to_pylist())) if t.num_rows else {})


def learn_pieces(words: DataFrame, spec: CounterSpec, room: int) -> list[Piece]:
    """Byte pieces: n-gram model, segmentation of all words, pruning to a fixpoint, then the best ``room`` pieces.

    The model and the pieces stay tables in the shared folder; only the ``room`` chosen pieces come to the driver.
    ``words`` and the counts are read several times and should be tables there too.
    """
    counts, _ = write_shared(count_ngrams(words).where((F.col("n") <= 1) | (F.col("cnt") >= spec.min_count)))
    grams = ngram_logprob(counts, spec.min_count).where("n > 0").select("gram", "logp")
    raw = words.select(F.encode("word", "UTF-8").alias("piece"), F.col("freq").alias("cnt"))
    pieces, _ = write_shared(map_pieces(raw, lambda d, p: segment(p, d), _log_probs, grams))
    good = (F.length("piece") <= spec.max_piece_size) & (F.col("cnt") >= spec.min_count)
    again = lambda keep, rest: map_pieces(rest, lambda u, p: u.tokenize(p), _unigram, keep)
    keep = pieces.where(good)
    keep, _ = write_shared(keep.union(again(keep, pieces.where(~good))).groupBy("piece").agg(F.sum("cnt").cast("long").alias("cnt")))
    size = keep.count()
    while True:
        keep, _ = write_shared(again(keep, keep))
        before, size = size, keep.count()
        if size == before:
            break
    single = F.length("piece") > 1
    best = keep.orderBy(single, F.desc("cnt"), F.desc(F.length("piece")), "piece").limit(room).collect()
    return [Piece(bytes(r["piece"]), float(r["cnt"])) for r in sorted(best, key=lambda r: (-r["cnt"], -len(r["piece"]), bytes(r["piece"])))]


def _rows(files: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """(word, freq) of a table in the shared folder, read on the driver; partitions fetched one by one would be computed one by one."""
    t = read_shared(files)
    for batch in t.to_batches():
        yield from zip(batch.column("word").to_pylist(), batch.column("freq").to_pylist())


def train(lines: DataFrame, method: str = "bytepiece", vocab_size: int = 8000, normalizer: NormalizerSpec | None = None, cn_dict: str | dict[bytes, float] | None = None, order: tuple[str, ...] = (), column: str = "line", **spec: object) -> Model:
    """Learn a model from ``lines``. ``vocab_size`` is what the user asks for; special and byte pieces come on top.

    ``order``: columns that put the lines in order for 'naive', whose ties depend on it.
    """
    normalizer = normalizer or NormalizerSpec()
    counter = replace(CounterSpec(), method=method, vocab_size=vocab_size + EXTRA[method], **spec)
    if method == "naive":
        text = lines.where(F.length(column) > 0)
        text = text.orderBy(*order) if order else text
        joined = b"".join(r[column].encode() + b"\n" for r in text.select(column).toLocalIterator())
        single = [Piece(bytes([b]), 0.0, BYTE) for b in range(256)]
        return Model(counter, NormalizerSpec(), single + learn_text(joined, vocab_size - 256))
    words = words_of(lines, normalizer, counter.min_count if method in ("piece", "sentencepiece") else 0, cn_dict if method == "piece" else None, column)
    words, files = write_shared(words)  # the corpus is read once
    if method == "piece":
        meta = meta_pieces(counter, with_bytes=False)
        rows = [(w.encode(), f) for w, f in _rows(files)]
        return assemble(counter, normalizer, meta, learn_bytes(rows, counter.vocab_size - len(meta), counter.max_piece_size))
    meta = meta_pieces(counter, with_bytes=True)
    room = counter.vocab_size - len(meta)
    if method == "sentencepiece":
        unk = chr(counter.unk_unicode)
        required = [(r["ch"], r["cnt"]) for r in required_chars(words, counter.character_coverage).orderBy(F.desc("cnt"), "cp").collect()]
        known = {c for c, _ in required}
        rows = _rows(files)
        if unk not in known:
            rows = (("".join(c if c in known else unk for c in w), f) for w, f in rows)
        rows = ((w, f) for w, f in rows if len(w.encode()) <= 65535)
        return assemble(counter, normalizer, meta, learn_chars(rows, required, room - len(required), counter.max_piece_size, unk), counter.vocab_size)
    model = assemble(counter, normalizer, meta, learn_pieces(words, counter, room))
    return model.with_specs(vocab_size=len(model))

"""Counts of pre-tokens, characters, byte n-grams and adjacent pairs.

The word-count table (word, freq) is the hub: everything after it works on distinct words weighted
by frequency, so the corpus is shuffled once, as partial counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTINEL, UNK_CHAR, chars
from ..session import ship
from .codecs import split_python

# A task's partial counts go out after so much text or so many different words; n-grams after so many bytes of words.
HELD_BYTES, HELD_WORDS, HELD_GRAMS = 64 << 20, 500_000, 1 << 20
ROWS = 50_000


def raw_count(lines: DataFrame, cut: int = 0, reconstruct: bool = False, max_bytes: int = 0, column: str = "line") -> DataFrame:
    """(token, freq) over ``lines``; tokens above ``max_bytes`` UTF-8 bytes are left out (0: none).

    Only partial counts are shuffled, never lines.
    """
    ship(lines.sparkSession)
    tokens = lines.where(F.length(column) > 0).select(F.col(column).alias("line")).mapInArrow(_token_counts(cut, reconstruct), "token string, freq long")
    if max_bytes:
        tokens = tokens.where(F.octet_length("token") <= max_bytes)
    return tokens.groupBy("token").agg(F.sum("freq").cast("long").alias("freq"))


def texts(column: pa.Array) -> list[str | None]:
    """Strings of a column; bytes that are not UTF-8 read as replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _token_counts(cut: int, reconstruct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial counts of a task. A space stands only first in a token, so what lies between spaces is counted whole and split once."""

    def flush(heads: Counter, tails: Counter) -> Iterator[pa.RecordBatch]:
        out: dict[str, int] = defaultdict(int)
        if not reconstruct:
            tails.pop("", None)  # of runs of spaces
        for words, mark in ((heads, ""), (tails, SENTINEL)):
            for w, n in words.items():
                for t in split_python(mark + w, cut):
                    out[t] += n
            words.clear()
        both = pa.table({"token": pa.array(list(out), pa.string()), "freq": pa.array(list(out.values()), pa.int64())})
        yield from both.to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, size = Counter(), Counter(), 0
        for batch in batches:
            for x in texts(batch.column(0)):
                words = (x if reconstruct else x.lstrip(" ").rstrip(" " + SENTINEL)).split(" ")
                heads[words[0]] += 1
                del words[0]
                tails.update(words)
                size += len(x)
                if size > HELD_BYTES or len(tails) + len(heads) > HELD_WORDS:
                    yield from flush(heads, tails)
                    size = 0
        yield from flush(heads, tails)

    return run


def word_table(lines: DataFrame, cut: int = 0, min_count: int = 0, reconstruct: bool = False, column: str = "line") -> DataFrame:
    """(word, freq), words below ``min_count`` dropped."""
    t = raw_count(lines, cut, reconstruct, column=column).withColumnRenamed("token", "word")
    return t.where(F.col("freq") >= min_count) if min_count > 1 else t


def char_counts(words: DataFrame) -> DataFrame:
    """(ch, cnt): characters weighted by word frequency."""
    return words.select(F.explode(chars(F.col("word"))).alias("ch"), "freq").groupBy("ch").agg(F.sum("freq").cast("long").alias("cnt"))


def code_point(ch: Column) -> Column:
    return F.ascii(ch).cast("long")


def char_coverage(words: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Characters by (cnt desc, code point) with the count before each, the total, and whether each is required.

    A character is required while the share before it, as float32, is below the coverage. The window is
    over the distinct characters only, a small table whatever the corpus.
    """
    c = char_counts(words).withColumn("cp", code_point(F.col("ch")))
    order = Window.orderBy(F.desc("cnt"), "cp")
    before = F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1))).cast("long")
    c = c.withColumns({"before": before, "total": total})
    return c.withColumn("required", (F.col("before").cast("double") / F.col("total")).cast("float") < F.lit(coverage).cast("float"))


def required_chars(words: DataFrame, coverage: float = 0.9995) -> DataFrame:
    return char_coverage(words, coverage).where("required").select("ch", "cp", "cnt")


def replace_rare_chars(words: DataFrame, coverage: float = 0.9995, unk: str = UNK_CHAR) -> DataFrame:
    """(word, freq) with characters that are not required replaced; words that become equal stay separate rows."""
    keep = required_chars(words, coverage).select("ch")
    each = words.select("word", "freq", F.posexplode(chars(F.col("word"))).alias("pos", "ch"))
    rare = each.select("ch").distinct().join(keep, "ch", "left_anti").agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("ch")), ""), F.lit("")).alias("rare"))
    out = words.crossJoin(F.broadcast(rare))  # one row
    return out.select("word", F.expr(f"translate(word, rare, repeat('{unk}', length(rare)))").alias("replaced"), "freq")


def byte_ngrams(words: DataFrame, most: int = 6) -> DataFrame:
    """(n, gram as hex, cnt): byte n-grams of the distinct words, weighted; n = 0 counts the offsets.

    Up to 6 bytes and their number are one long, which a task adds up for many words at once.
    """
    if most <= 6:
        ship(words.sparkSession)
        keys = words.select(F.encode("word", "UTF-8").alias("w"), F.col("freq").cast("long").alias("freq")).where(F.length("w") > 0)
        sums = keys.mapInArrow(_packed_grams(most), "k long, cnt long").groupBy("k").agg(F.sum("cnt").cast("long").alias("cnt"))
        n = F.shiftright("k", 48).cast("int")
        return sums.select(n.alias("n"), F.right(F.hex("k"), n * 2).alias("gram"), "cnt")
    h = words.select(F.hex(F.encode("word", "UTF-8")).alias("h"), "freq").where(F.length("h") > 0)
    n_bytes = (F.length("h") / 2).cast("int")
    at = h.select("h", "freq", F.explode(F.sequence(F.lit(1), n_bytes)).alias("i"))
    grams = at.select("freq", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), (F.length("h") / 2).cast("int") - F.col("i") + 1))).alias("n"), "h", "i")
    grams = grams.select("n", F.expr("substring(h, (i - 1) * 2 + 1, n * 2)").alias("gram"), "freq")
    return grams.groupBy("n", "gram").agg(F.sum("freq").cast("long").alias("cnt"))


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the offsets of its values."""
    words = words.cast(pa.large_binary())
    _, at, data = words.buffers()
    off = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)), off - off[0]


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _packed_grams(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, cnt): k has n from bit 48 on and the n bytes below."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, off = flat_bytes(pa.concat_arrays([b.column(0) for b in held]))
        size, freq = np.diff(off), np.concatenate([b.column(1).to_numpy() for b in held])
        weight, left = np.repeat(freq, size), np.repeat(off[1:], size) - np.arange(len(data))
        keys, counts = [np.zeros(1, np.int64)], [np.array([weight.sum()])]
        key = np.zeros(len(data), np.int64)
        for n in range(1, most + 1):
            key = (key[: len(data) - n + 1] << 8) | data[n - 1 :]
            fits = left[: len(key)] >= n
            keys.append(key[fits] | n << 48)
            counts.append(weight[: len(key)][fits])
        k, c = added(np.concatenate(keys), np.concatenate(counts))
        yield from pa.table({"k": k, "cnt": c}).to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(0).nbytes
            if size > HELD_GRAMS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def smoothed_ngrams(grams: DataFrame, min_count: int = 1) -> DataFrame:
    """byte_ngrams with every single byte counted once at least (the total grows alike), and n > 1 below ``min_count`` dropped."""
    spark = grams.sparkSession
    every = spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("gram"))
    ones = every.join(grams.where("n = 1").select("gram", "cnt"), "gram", "left")
    singles = ones.select(F.lit(1).alias("n"), "gram", F.coalesce("cnt", F.lit(1)).cast("long").alias("cnt"))
    missing = ones.where("cnt is null").agg(F.count("*").alias("k"))
    total = grams.where("n = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t")).crossJoin(missing).select(F.lit(0).alias("n"), F.lit("").alias("gram"), (F.col("t") + F.col("k")).cast("long").alias("cnt"))
    return grams.where((F.col("n") > 1) & (F.col("cnt") >= min_count)).select("n", "gram", "cnt").unionByName(singles).unionByName(total)


def ngram_logprob(grams: DataFrame, min_count: int = 1) -> DataFrame:
    """(n, gram, cnt, logp): log of the count over its prefix's count; n = 0 keeps log(total).

    A prefix is never rarer than what it begins, so an inner join on the prefix loses nothing.
    """
    g = smoothed_ngrams(grams, min_count)
    prefix = g.select((F.col("n") + 1).alias("n"), F.col("gram").alias("prefix"), F.col("cnt").alias("whole"))
    own = g.where("n > 0").withColumn("prefix", F.expr("substring(gram, 1, (n - 1) * 2)"))
    cond = own.join(prefix, ["n", "prefix"], "left").select("n", "gram", "cnt", (F.log("cnt") - F.coalesce(F.log("whole"), F.lit(0.0))).alias("logp"))
    return cond.unionByName(g.where("n = 0").select("n", "gram", "cnt", F.log("cnt").alias("logp")))


def pair_counts(words: DataFrame, tokens: Column) -> DataFrame:
    """(a, b, cnt) of adjacent elements of an array column, overlaps counted, weighted by freq."""
    t = words.select(tokens.alias("t"), "freq").where(F.size("t") > 1)
    pairs = t.select("freq", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("a"), F.element_at("t", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("freq").cast("long").alias("cnt"))


def hex_bytes(word: Column) -> Column:
    """Bytes of a word as hex strings."""
    return F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(?s).."), F.lit(0))


def byte_pairs(words: DataFrame) -> DataFrame:
    return pair_counts(words, hex_bytes(F.col("word")))


def char_pairs(words: DataFrame, unk: str = UNK_CHAR) -> DataFrame:
    """Adjacent characters; pairs with the unknown mark are never formed."""
    return pair_counts(words, chars(F.col("word"))).where((F.col("a") != unk) & (F.col("b") != unk))

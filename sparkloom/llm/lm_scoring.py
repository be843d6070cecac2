"""Operator 10: scoring of texts with a log-bilinear language model trained by noise-contrastive estimation.

Words are predicted in two steps. The classes of the model are the ``SINGLES`` most frequent lower-cased words of
the whole corpus, ``GROUPS`` groups of ``GROUP_SIZE`` words of the next frequencies, ``HASHED`` classes of
all other words (by hash) and the mark of a text's begin. The score of class w after u, v is
(c1 * R[v] + c2 * R[u]) . Q[w] + b[w] (Mnih and Teh, 2012, with diagonal context matrices); the score of a word in its
group is that of the first ``INNER_DIM`` parts of the same context vector with the word's own W and a. Both are trained by noise-contrastive
estimation, with the unigram distribution of classes, and of words in a group, as noise.

Training reads all texts. Their tokens, as 16-bit word numbers, are dealt by hash of the text into shards of about
``SHARD_TOKENS``, each in the order of the hash, so that a model does not depend on how the input is split over
files or tasks. In each round every shard starts from the same parameters and AdaGrad sums, runs on its batches (rounds
take them in turn, so all rounds together are one epoch) with random numbers that depend on the shard, and the
results are averaged by number of tokens, ``FAN`` at a time. For scoring, batched matrix products give log Z of each
context over the classes and of each group's words, so log-probabilities are normalised. A word of a hashed class gets its
share of it, (n + ``SMOOTH``) / (N + ``SMOOTH`` * (V + 1)) for a word that occurs n times in a class of N tokens and V
distinct words of the corpus, all words that are not in the corpus together counting as one with n = 0; so
probabilities are normalised over words. The counts of all words are a table that grows with the corpus:
a task sends each hash bucket of it the distinct words of a chunk of texts and gets back their shares.
What goes to the driver (parameters, log Z, totals of classes) has a fixed size; counts and training data
stay distributed. Words are told apart by 64-bit hashes. Of words of equal counts all or none are told apart from their hashed classes; equal counts are ordered by hash.

Defined results: null and empty texts have 0 tokens, log_prob 0 and null perplexity; repeated rows
give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buckets, cut, lean, pick, ship, stored
from ._exchange import DIRECTORY, KEYS, MESSAGE, _message_batch, _message_table, labels, unpack
from ._exchange import dealt as dealt_by
from ._exchange import pack as packed
from ._tokens import Words, slices, string_buffers

SINGLES, GROUPS, GROUP_SIZE, HASHED, DIM, INNER_DIM, ROUNDS, BATCH, NOISE, INNER_NOISE, RATE = 512, 448, 64, 63, 24, 8, 2, 4096, 24, 6, 0.1
SMOOTH, SHARD_TOKENS, FAN, CHUNK_TOKENS, CHUNK_ROWS, CHUNK_WORDS = 0.5, 8_000_000, 8, 1_500_000, 200_000, 2_000_000
COUNTS = 3  # a kind of messages, beside KEYS and DIRECTORY
NEVER = -1e4  # the score of a class without words


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): hash and number of every lower-cased word over all texts. A task adds up the words of a chunk before they are shuffled."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["h", "n"])

        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            for _, _, r, o in slices(raw, off):
                held.append(Words(r, o).hashes())
                size += len(held[-1])
                if size >= CHUNK_WORDS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, k: int) -> int:
    """The least t such that at most k words occur more than t times: from a histogram of powers of two, then of the counts in one of them."""

    def below(sizes: list[tuple[int, int]], room: int) -> tuple[int | None, int]:
        for at, n in sorted(sizes, reverse=True):
            if n > room:
                return at, room
            room -= n
        return None, room

    power = F.length(F.bin("n"))
    at, room = below([(r[0], r[1]) for r in counts.groupBy(power).count().collect()], k)
    if at is None:
        return 0
    at, _ = below([(r[0], r[1]) for r in counts.where(power == at).groupBy("n").count().collect()], room)
    return at


def hash_of(word: str) -> int:
    b = word.encode()
    return int(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)])).hashes()[0])


def vocabulary(texts: DataFrame, singles: int = SINGLES, groups: int = GROUPS, group_size: int = GROUP_SIZE, hashed: int = HASHED) -> tuple[dict, DataFrame, np.ndarray]:
    """Hashes of the frequent words (sorted) with their numbers, the classes and their unigram distributions, the table (h, n) of all words, log of the hashed classes' totals."""
    ship(texts.sparkSession)
    n_words, size = singles + groups * group_size, singles + groups + hashed + 1
    counts = stored(word_counts(texts))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = (batch.column(0).to_numpy().view(np.uint64) % np.uint64(hashed)).astype(int)
            sums = np.bincount(c, batch.column(1).to_numpy(), hashed)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(hashed)), pa.array(sums.astype(np.int64)), pa.array(np.bincount(c, minlength=hashed))], names=["c", "n", "v"])

    least = least_count(counts, n_words)
    top = sorted(((r["n"], r["h"] % (1 << 64)) for r in counts.where(F.col("n") > least).collect()), key=lambda x: (-x[0], x[1]))
    sums, kinds = np.zeros(hashed), np.zeros(hashed)
    for r in counts.mapInArrow(classes, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sums[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    h = np.array([x for _, x in top], np.uint64)
    freq = np.zeros(n_words)
    freq[: len(top)] = [n for n, _ in top]
    np.subtract.at(sums, (h % np.uint64(hashed)).astype(int), freq[: len(top)])
    np.subtract.at(kinds, (h % np.uint64(hashed)).astype(int), 1)
    group = np.minimum(np.arange(n_words), singles + (np.arange(n_words) - singles) // group_size)
    group[:singles] = np.arange(singles)
    mass = np.concatenate([np.bincount(group, freq, singles + groups), sums, [0.0]])
    inner = freq[singles:].reshape(groups, group_size)
    inner = inner / np.maximum(inner.sum(1, keepdims=True), 1)
    order = np.argsort(h)
    vocab = {
        "hash": h[order], "id": order.astype(np.uint16), "n_words": n_words, "singles": singles, "group_size": group_size, "hashed": hashed, "size": size,
        "class": np.concatenate([group, singles + groups + np.arange(hashed)]).astype(np.int32), "live": np.concatenate([mass[: singles + groups] > 0, np.ones(hashed, bool), [False]]),
        "unigram": np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum(), "inner": inner, "tokens": int(mass.sum()),
    }
    return vocab, counts, np.log(sums + SMOOTH * (kinds + 1))


def token_ids(words: Words, vocab: dict) -> np.ndarray:
    """Number of each word: its rank, or that of its hashed class after all ranks."""
    h = words.hashes()
    ids = (vocab["n_words"] + (h % np.uint64(vocab["hashed"])).astype(np.int32)).astype(np.uint16)
    if len(vocab["hash"]):
        at = np.minimum(np.searchsorted(vocab["hash"], h), len(vocab["hash"]) - 1)
        known = vocab["hash"][at] == h
        ids[known] = vocab["id"][at[known]]
    return ids


def contexts(ids: np.ndarray, doc: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each token; ``begin`` before a text."""
    one, two = np.full(len(ids), begin, np.int32), np.full(len(ids), begin, np.int32)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    start = doc[:-1][np.diff(doc) > 0]
    one[start] = begin
    two[start] = begin
    after = start + 1
    after = after[after < len(ids)]
    two[after] = begin
    return one, two


def initial(vocab: dict, dim: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n, m = vocab["size"], vocab["inner"].size
    p = {"R": rng.normal(0, 0.1, (n, dim)), "Q": rng.normal(0, 0.1, (n, dim)), "b": np.log(vocab["unigram"]), "c": np.stack([np.ones(dim), np.full(dim, 0.5)])}
    p |= {"W": rng.normal(0, 0.1, (m, min(dim, INNER_DIM))), "a": np.log(np.maximum(vocab["inner"].ravel(), 1e-9))}
    return {k: x.astype(np.float32) for k, x in p.items()}


def scatter(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by id, column by column, which is several times as fast as over all cells at once."""
    out = np.empty((rows.shape[1], n), np.float32)
    for into, column in zip(out, np.ascontiguousarray(rows.T)):
        into[:] = np.bincount(ids, column, n)
    return out.T


def nce_step(p: dict, g2: dict, one: np.ndarray, two: np.ndarray, w: np.ndarray, noise: np.ndarray, log_kp: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch with noise shared in it."""
    n = len(p["b"])
    r1, r2 = p["R"].take(one, 0), p["R"].take(two, 0)
    q = p["c"][0] * r1 + p["c"][1] * r2
    qw, qn = p["Q"].take(w, 0), p["Q"][noise]
    data = 1 / (1 + np.exp(np.clip((q * qw).sum(1) + p["b"][w] - log_kp[w], -30, 30)))  # 1 - P(data)
    fake = 1 / (1 + np.exp(np.clip(-(q @ qn.T + p["b"][noise] - log_kp[noise]), -30, 30)))
    dq = data[:, None] * qw - fake @ qn
    grads = {
        "Q": scatter(w, data[:, None] * q, n) - scatter(noise, fake.T @ q, n),
        "R": scatter(one, dq * p["c"][0], n) + scatter(two, dq * p["c"][1], n),
        "b": (np.bincount(w, data, n) - np.bincount(noise, fake.sum(0), n)).astype(np.float32),
        "c": np.stack([(dq * r1).sum(0), (dq * r2).sum(0)]),
    }
    for name, grad in grads.items():
        grad /= 64.0  # keeps AdaGrad's sums in a good range for sparse rows of a batch
        g2[name] += grad * grad
        p[name] += (rate * grad / np.sqrt(g2[name] + 1e-6)).astype(np.float32)


def inner_step(p: dict, g2: dict, one: np.ndarray, two: np.ndarray, w: np.ndarray, noise: np.ndarray, log_kp: np.ndarray, rate: float) -> None:
    """One AdaGrad step of the words in groups: w is the place of each among all words of groups, noise (rows of it) are places in the same group."""
    d = p["W"].shape[1]
    q = p["c"][0, :d] * p["R"][:, :d].take(one, 0) + p["c"][1, :d] * p["R"][:, :d].take(two, 0)
    spots = np.concatenate([w[:, None], noise], 1)
    score = np.matmul(p["W"].take(spots, 0), q[:, :, None])[:, :, 0] + (p["a"] - log_kp).take(spots)
    grad = (-1 / (1 + np.exp(np.clip(-score, -30, 30)))).astype(np.float32)
    grad[:, 0] += 1
    place = np.zeros(len(p["a"]), np.int32)
    place[spots] = 1
    rows = np.flatnonzero(place)
    place[rows] = np.arange(len(rows))
    at = place[spots].ravel()
    for name, g in (("W", scatter(at, (grad[:, :, None] * q[:, None]).reshape(-1, q.shape[1]), len(rows))), ("a", np.bincount(at, grad.ravel(), len(rows)).astype(np.float32))):
        g = g / np.float32(8)
        sums = g2[name][rows] + g * g
        g2[name][rows] = sums
        p[name][rows] += (rate * g / np.sqrt(sums + np.float32(1e-6))).astype(np.float32)


def _lower(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.lower(F.col("text").cast("string")).alias("text"))


def sharded(texts: DataFrame, vocab: dict, shard_tokens: int) -> DataFrame:
    """(shard, ids) of the texts: 16-bit word numbers, a partition for each shard, in the order of a hash of the text."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    n = max(1, -(-vocab["tokens"] // shard_tokens))
    place = labels(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            for a, b, r, o in slices(raw, off):
                words = Words(r, o)
                h = batch.column(0)[a:b]
                ids = token_ids(words, shared.value).tobytes()
                cuts = pa.array((2 * words.doc).astype(np.int32))
                shard = place[(h.to_numpy().view(np.uint64) % np.uint64(n)).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), h, pa.Array.from_buffers(pa.binary(), b - a, [None, cuts.buffers()[1], pa.py_buffer(ids)])], names=["shard", "h", "ids"])

    rows = texts.where("text <> ''").select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "shard int, h long, ids binary")
    return cut(rows.repartition(n, "shard").sortWithinPartitions("h", "ids").select("shard", "ids"))


def averaged(parts: DataFrame) -> DataFrame:
    """(name, weight, value) of parts(name, shard, weight, value), as weighted means of ``FAN`` at a time."""

    def mean(t: pa.Table) -> pa.Table:
        lean()
        w = t["weight"].to_numpy()
        total = sum(x * np.frombuffer(v.as_py(), np.float32).astype(np.float64) for x, v in sorted(zip(w, t["value"]), key=lambda y: (y[0], y[1].as_py())))
        return pa.table({"name": t["name"][:1], "shard": t["up"][:1], "weight": pa.array([w.sum()]), "value": pa.array([(total / w.sum()).astype(np.float32).tobytes()])})

    n = parts.agg(F.max("shard")).first()[0] or 0
    while True:
        parts = parts.withColumn("up", F.expr(f"shard div {FAN}")).groupBy("name", "up").applyInArrow(mean, "name string, shard long, weight double, value binary")
        n //= FAN
        if not n:
            return parts


def train(texts: DataFrame, vocab: dict, dim: int = DIM, rounds: int = ROUNDS, batch: int = BATCH, noise: int = NOISE, inner_noise: int = INNER_NOISE, rate: float = RATE, shard_tokens: int = SHARD_TOKENS) -> dict:
    """Parameters after ``rounds`` rounds over ``texts(text)`` (lower-cased)."""
    spark = texts.sparkSession
    p = initial(vocab, dim)
    state = p | {f"g2{k}": np.full(x.shape, 1e-3, np.float32) for k, x in p.items()}
    shapes = {k: x.shape for k, x in state.items()}
    tokens = sharded(texts, vocab, shard_tokens)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((state, vocab))

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            lean()
            start, voc = shared.value
            mine = {k: start[k].copy() for k in p}
            g2 = {k: start[f"g2{k}"].copy() for k in p}
            log_kp = np.log(noise * voc["unigram"]).astype(np.float32)
            cdf = np.cumsum(voc["unigram"])
            cdf /= cdf[-1]
            inner, size = voc["inner"], voc["group_size"]
            inner_kp = np.log(np.maximum(inner_noise * inner.ravel(), 1e-9)).astype(np.float32)
            # group g has the stretch g..g+1 of one distribution function over all words of groups
            inner_cdf = (np.arange(len(inner))[:, None] + np.minimum(np.cumsum(inner, 1), 1)).ravel()
            seen, turn, shard, rng = 0, 0, None, None
            for rb in batches:
                if not rb.num_rows:
                    continue
                if shard is None:
                    shard = rb.column(0)[0].as_py()
                    rng = np.random.default_rng([shard, r])
                raw, off = string_buffers(rb.column(1))
                words = np.frombuffer(raw.tobytes(), np.uint16)
                ids = voc["class"][words]
                one, two = contexts(ids, off // 2, voc["size"] - 1)
                for a in range(0, len(ids), batch):
                    turn += 1
                    if turn % rounds == r:
                        sl = slice(a, a + batch)
                        seen += len(ids[sl])
                        nce_step(mine, g2, one[sl], two[sl], ids[sl], np.searchsorted(cdf, rng.random(noise)).astype(np.int32), log_kp, rate)
                        grouped = np.flatnonzero((words[sl] >= voc["singles"]) & (words[sl] < voc["n_words"])) + a
                        if len(grouped):
                            w = words[grouped].astype(np.int64) - voc["singles"]
                            draw = np.searchsorted(inner_cdf, (w // size)[:, None] + rng.random((len(w), inner_noise)), "right")
                            inner_step(mine, g2, one[grouped], two[grouped], w, np.minimum(draw, (w // size * size + size - 1)[:, None]), inner_kp, rate)
            if seen:
                out = mine | {f"g2{k}": x for k, x in g2.items()}
                yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([shard] * len(out), pa.int64()), pa.array([float(seen)] * len(out)), pa.array([x.astype(np.float32).tobytes() for x in out.values()])], names=["name", "shard", "weight", "value"])

        parts = stored(tokens.mapInArrow(run, "name string, shard long, weight double, value binary"))
        rank = {int(x): i for i, x in enumerate(labels(tokens.rdd.getNumPartitions()))}
        parts = parts.join(F.broadcast(spark.createDataFrame(list(rank.items()), "shard long, k long")), "shard").drop("shard").withColumnRenamed("k", "shard")
        state = state | {x["name"]: np.frombuffer(x["value"], np.float32).reshape(shapes[x["name"]]) for x in averaged(parts).collect()}
    return {k: state[k] for k in p}


def log_z(spark, p: dict) -> np.ndarray:  # noqa: ANN001
    """log Z over the classes of every context [one before, two before], by batched matrix products in parallel."""
    n = len(p["b"])
    shared = spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for v in batch.column(0).to_numpy():
                s = (m["c"][0] * m["R"][v] + m["c"][1] * m["R"]) @ m["Q"].T + m["b"]
                top = s.max(1)
                s -= top[:, None]
                out.append((np.log(np.exp(s, out=s).sum(1)) + top).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "z"])

    rows = spark.range(0, n, 1, 16).mapInArrow(run, "id long, z binary").collect()
    z = np.empty((n, n), np.float32)
    for r in rows:
        z[r["id"]] = np.frombuffer(r["z"], np.float32)
    return z


def model(docs: DataFrame, singles: int = SINGLES, groups: int = GROUPS, group_size: int = GROUP_SIZE, hashed: int = HASHED, **options: float) -> dict:
    """Train on ``docs(text)`` and tabulate the classes, whose number is fixed: vocab, pair[v, w] and skip[u, w] scores and log Z [v, u], the parameters p of the words in groups, counts(h, n) of all words, log_total of hashed classes."""
    texts = _lower(docs)
    vocab, counts, log_total = vocabulary(texts, singles, groups, group_size, hashed)
    p = train(texts, vocab, **options)
    p["b"] = np.where(vocab["live"], p["b"], np.float32(NEVER)).astype(np.float32)
    p["a"] = np.where(vocab["inner"].ravel() > 0, p["a"], np.float32(NEVER)).astype(np.float32)
    return {"vocab": vocab, "p": p, "pair": (p["c"][0] * p["R"]) @ p["Q"].T + p["b"], "skip": (p["c"][1] * p["R"]) @ p["Q"].T, "z": log_z(docs.sparkSession, p), "counts": counts, "log_total": log_total}


def token_log_probs(words: Words, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Normalised log-probability of every word, or of the hashed class of it, and whether it is that of a hashed class."""
    voc, p = m["vocab"], m["p"]
    number = token_ids(words, voc)
    ids = voc["class"][number]
    one, two = contexts(ids, words.doc, voc["size"] - 1)
    out = m["pair"][one, ids] + m["skip"][two, ids] - m["z"][one, two]
    grouped = np.flatnonzero((number >= voc["singles"]) & (number < voc["n_words"]))
    if len(grouped):
        w, size = number[grouped].astype(np.int64) - voc["singles"], voc["group_size"]
        order, cut_ = dealt_by(w // size, len(voc["inner"]))
        at = grouped[order]
        d = p["W"].shape[1]
        q = p["c"][0, :d] * p["R"][one[at], :d] + p["c"][1, :d] * p["R"][two[at], :d]
        for g in np.flatnonzero(np.diff(cut_)):
            x, y = cut_[g], cut_[g + 1]
            s = q[x:y] @ p["W"][g * size : (g + 1) * size].T + p["a"][g * size : (g + 1) * size]
            top = s.max(1)
            z = np.log(np.exp(s - top[:, None]).sum(1)) + top
            out[at[x:y]] += s[np.arange(y - x), w[order[x:y]] - g * size] - z
    return out, number >= voc["n_words"]


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def dealt(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of h by bucket, and the bounds of the buckets in it."""
    return dealt_by(bucket_of(h, n_buckets), n_buckets)


def count_messages(counts: DataFrame, n_buckets: int) -> DataFrame:
    """counts(h, n) -> message rows to the buckets."""
    label = labels(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held))
            order, cut = dealt(h.view(np.uint64), n_buckets)
            h, n = h[order], n[order]
            return _message_batch([(int(label[b]), 0, 0, COUNTS, h[x:y].tobytes() + n[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:])) if x < y])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= CHUNK_WORDS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return counts.mapInArrow(run, MESSAGE)


def score(docs: DataFrame, m: dict) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum, natural logarithm), perplexity of each of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast({k: m[k] for k in ("vocab", "p", "pair", "skip", "z")})
    n_buckets, log_total = buckets(spark), m["log_total"]
    label = labels(n_buckets)
    place = {int(x): b for b, x in enumerate(label)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        tables, part, seq = shared.value, TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            ids = [x for h in held for x in h[0]]
            total, count, rare, key = (np.concatenate(x) for x in list(zip(*held))[1:])
            key, at = np.unique(key, return_inverse=True)
            order, cut = dealt(key, n_buckets)
            spot = np.empty(len(key), np.int32)
            spot[order] = np.arange(len(key), dtype=np.int32)
            key, chunk = key[order], (part << 24) | seq
            rows = [(int(label[chunk % n_buckets]), chunk, 0, DIRECTORY, packed((ids, total, count, rare, spot[at], cut)))]
            return _message_batch(rows + [(int(label[b]), chunk, 0, KEYS, key[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:])) if x < y])

        held, size, n_rows = [], 0, 0
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            for a, b, r, o in slices(raw, off):
                words = Words(r, o)
                logp, in_class = token_log_probs(words, tables)
                sums = np.concatenate([[0.0], np.cumsum(logp, dtype=np.float64)])
                before = np.concatenate([[0], np.cumsum(in_class)])
                held.append((batch.column(0)[a:b].to_pylist(), sums[words.doc[1:]] - sums[words.doc[:-1]], np.diff(words.doc).astype(np.int32), before[words.doc[1:]] - before[words.doc[:-1]], words.hashes()[in_class]))
                size, n_rows = size + int(before[-1]), n_rows + b - a
                if size >= CHUNK_TOKENS or n_rows >= CHUNK_ROWS:
                    yield flush()
                    held, size, n_rows, seq = [], 0, 0, seq + 1
        if held:
            yield flush()

    def answer(t: pa.Table) -> pa.Table:
        kind, chunk, blobs, dest = t["kind"].to_numpy(), t["chunk"].to_numpy(), t["blob"].to_pylist(), int(t["dest"][0].as_py())
        rows = [(dest, int(chunk[i]), 0, DIRECTORY, blobs[i]) for i in np.flatnonzero(kind == DIRECTORY)]
        known = [np.frombuffer(blobs[i], np.int64).reshape(2, -1) for i in np.flatnonzero(kind == COUNTS)]
        h, n = np.concatenate(known, axis=1) if known else np.zeros((2, 0), np.int64)
        order = np.argsort(h.view(np.uint64))
        h, n = np.append(h.view(np.uint64)[order], np.uint64(0)), np.append(n[order], 0)
        for i in np.flatnonzero(kind == KEYS):
            key = np.frombuffer(blobs[i], np.uint64)
            at = np.searchsorted(h[:-1], key)
            have = np.where((h[at] == key) & (at < len(h) - 1), n[at], 0)
            share = np.log(have + SMOOTH) - log_total[(key % np.uint64(len(log_total))).astype(int)]
            rows.append((dest, int(chunk[i]), 0, KEYS, share.astype(np.float32).tobytes()))
        return _message_table(rows)

    def gather(t: pa.Table) -> pa.Table:
        kind, dest, blobs = t["kind"].to_numpy(), t["dest"].to_numpy(), t["blob"].to_pylist()
        ids, total, count, rare, spot, cut = unpack(blobs[int(np.flatnonzero(kind == DIRECTORY)[0])])
        share = np.full(cut[-1], np.nan)
        for i in np.flatnonzero(kind == KEYS):
            b = place[int(dest[i])]
            share[cut[b] : cut[b + 1]] = np.frombuffer(blobs[i], np.float32)
        sums, end = np.concatenate([[0.0], np.cumsum(share[spot])]), np.cumsum(rare)
        total = total + sums[end] - sums[end - rare]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            ppl = np.exp(-total / count)
        return pa.table([pa.array(ids, pa.int64()), pa.array(count), pa.array(np.round(total, 4)), pa.array(np.round(ppl, 4), mask=count == 0)], names=["doc_id", "n_tokens", "log_prob", "perplexity"])

    sent = _lower(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(scan, MESSAGE).union(count_messages(m["counts"], n_buckets))
    replies = sent.groupBy("dest").applyInArrow(answer, MESSAGE)
    return replies.groupBy("chunk").applyInArrow(gather, "doc_id long, n_tokens int, log_prob double, perplexity double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on ``docs(doc_id, text)`` and score every one of them."""
    docs = pick(docs, "doc_id", "text")
    return score(docs, model(docs))

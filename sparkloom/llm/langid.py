"""Operator 1: language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each text:
* the text's likelihood, from byte trigrams without digits, hashed to 2**16 values; the multinomial model of each
  language is fitted to labelled documents, at most ``FIT_ROWS`` of each language (those of least hash);
  every language with a labelled document has a model, and each is fitted in a task of its own; likelihoods are tempered to the weight of ``EFFECTIVE`` trigrams;
* the declared markup language and the address suffix: P(value | language), from grouped counts over
  all texts whose own likelihood decides clearly;
* a host prior: the same counts by host, smoothed to its domain's and that to the global share, each with
  strength ``STRENGTH``.
Each piece of evidence is used once, and a text's own count is left out of all counts that judge it.
Counts, priors and evidence cover all rows; only the fit is bounded.

A text is accepted when it has letters, its best posterior reaches ``ACCEPT`` and its trigrams are not
far less likely than those of any fitted document of that language: their mean log-probability, with an
allowance of ``NOISE`` / sqrt(n) for short texts, is at most ``MARGIN`` below the least of these.

Defined results: a null or empty text, or one without letters, gets language 'und' and is not
accepted; null markup, suffix or host counts as the value ''; repeated rows count as often as they
occur; documents declare no markup (their language column is what the model is fitted to) and their source is their
host; an empty table gives no rows; without labelled documents all is 'und'; other columns are
ignored, or kept by :func:`filter_language`. Equal posteriors: the first language in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean, masked, pick, ship, stored, with_row_key
from ._lookup import looked_up
from ._tokens import slices, string_buffers

FIT_ROWS, EFFECTIVE, STRENGTH, ACCEPT, MARGIN, NOISE, CLEAR = 2000, 64.0, 8.0, 0.5, 1.0, 12.0, 4.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
NO_TRIGRAM = 1 << 16


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams at each position but the last two; NO_TRIGRAM where there is a digit."""
    b, digit = _LOWER[raw], _DIGIT[raw]
    h = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    h[digit[:-2] | digit[1:-1] | digit[2:]] = NO_TRIGRAM
    return h


def fit(rows: list[tuple[str, str]]) -> dict:
    """Model of (language, text) rows: languages, log-probabilities [language, 2**16], least mean log-probability of a fitted text."""
    langs = sorted({r[0] for r in rows})
    counts = np.full((len(langs), 1 << 16), 0.25)
    seen: list[tuple[int, np.ndarray]] = []
    for lang, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) >= 3:
            t = trigrams(raw)
            t = t[t != NO_TRIGRAM]
            if len(t):
                counts[langs.index(lang)] += np.bincount(t, minlength=1 << 16)
                seen.append((langs.index(lang), t))
    logp = np.log(counts / counts.sum(1, keepdims=True)) if langs else counts
    least = np.array([min([float(logp[i][t].mean()) + NOISE / math.sqrt(len(t)) for k, t in seen if k == i], default=-50.0) for i in range(len(langs))])
    logp = np.concatenate([logp, np.zeros((len(langs), 1))], axis=1)
    return {"langs": langs, "logp": logp.astype(np.float32), "least": least}


def fit_documents(documents: DataFrame, limit: int = FIT_ROWS) -> dict:
    """Fit to at most ``limit`` rows of each language of ``documents(doc_id, lang, text)``: those of the least hash of doc_id."""
    ship(documents.sparkSession)
    labelled = pick(documents, "doc_id", "lang", "text").where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least_h"))
    # hashes are spread evenly, so about this share of them holds the least ``limit``; equal hashes stay together
    share = (limit + 8 * math.sqrt(limit) + 32) / F.col("n")
    edge = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(F.greatest("least_h", ((share - 0.5) * 2.0**64).cast("long")))
    near = labelled.join(F.broadcast(counts.select("lang", edge.alias("edge"))), "lang").where("h <= edge")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.coalesce("doc_id", F.lit(0)), "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= limit).select("lang", "text")

    def run(t: pa.Table) -> pa.Table:
        m = fit(list(zip(t["lang"].to_pylist(), t["text"].to_pylist())))
        return pa.table({"lang": m["langs"], "logp": [m["logp"].tobytes()], "least": m["least"]})

    rows = sorted(sample.groupBy("lang").applyInArrow(run, "lang string, logp binary, least double").collect(), key=lambda r: r["lang"])
    if not rows:
        return fit([])
    return {"langs": [r["lang"] for r in rows], "logp": np.stack([np.frombuffer(r["logp"], np.float32) for r in rows]), "least": np.array([r["least"] for r in rows])}


def scored(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with lls (tempered log-likelihood of each language) and fits (whether the best one's mean is near fitted texts); null without letters. The text is dropped."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", lls array<double>, fits boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        m = shared.value
        logp, k = m["logp"], len(m["langs"])
        for batch in batches:
            raw, off = string_buffers(batch.column(batch.schema.get_field_index(text)))
            n = len(off) - 1
            sums, size, letters = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, bool)
            for a, b, r, o in slices(raw, off, 1 << 18):
                live = np.flatnonzero(np.diff(o) > 2)
                if not len(live):
                    continue
                idx = trigrams(r)
                # trigrams that reach into the next text are taken out by summing between the bounds
                bounds = np.stack([o[live], o[live + 1] - 2], 1).ravel()
                bounds[-1] = min(bounds[-1], len(idx))
                cut = bounds[:-1] if bounds[-1] == len(idx) else bounds
                for lang in range(k):
                    sums[a + live, lang] = np.add.reduceat(logp[lang][idx], cut, dtype=np.float64)[::2]
                size[a + live] = np.add.reduceat(idx != NO_TRIGRAM, cut, dtype=np.int64)[::2]
                has = np.concatenate([[0], np.cumsum(_LETTER[r])])
                letters[a:b] = has[o[1:]] > has[o[:-1]]
            ok = letters & (size > 0) & (k > 0)
            mean = sums / np.maximum(size, 1)[:, None]
            best = mean.argmax(1) if k else np.zeros(n, int)
            fits = mean[np.arange(n), best] + NOISE / np.sqrt(np.maximum(size, 1)) >= m["least"][best] - MARGIN if k else np.zeros(n, bool)
            lls = mean * np.minimum(size, EFFECTIVE)[:, None]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(lls.ravel()), k).cast(pa.list_(pa.float64())) if k else pa.array([[]] * n, pa.list_(pa.float64()))
            null = pa.nulls(n, pa.list_(pa.float64()))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            import pyarrow.compute as pc

            yield pa.RecordBatch.from_arrays([*cols, pc.if_else(pa.array(ok), flat, null), pa.array(fits & ok)], names=[*keep, "lls", "fits"])

    return df.mapInArrow(run, schema)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name, or three where the last two are a country's general suffix, as in co.uk."""
    three = host.rlike(r"(?:^|\.)[^.]+\.(?:ac|co|com|edu|gob|gov|gouv|ne|net|or|org)\.[a-z]{2}$")
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def identified(rows: DataFrame, model: dict) -> DataFrame:
    """rows(..., text, markup, suffix, host) -> the other columns with lang, confidence, accepted."""
    langs = model["langs"]
    keep = [c for c in rows.columns if c not in ("text", "markup", "suffix", "host")]
    some = lambda c: F.coalesce(F.lower(F.col(c)), F.lit(""))
    rows = rows.withColumns({"markup": some("markup"), "suffix": some("suffix"), "host": some("host")})
    if not langs:
        return rows.select(*keep, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    s = stored(scored(rows, model))
    ll = [F.col("lls")[i] for i in range(len(langs))]
    top = F.array_max("lls")
    second = F.element_at(F.sort_array("lls"), -2) if len(langs) > 1 else top - CLEAR
    s = s.withColumn("own", F.when(F.col("fits") & (top - second >= CLEAR), F.array_position("lls", top).cast("int") - 1))
    s = s.withColumn("domain", domain_of(F.col("host")))
    ones = [F.sum((F.col("own") == i).cast("long")).alias(f"n{i}") for i in range(len(langs))]
    adds = lambda p: [F.sum(f"n{i}").alias(f"{p}{i}") for i in range(len(langs))]
    known = s.where("own is not null")
    hosts = known.groupBy("host", "domain").agg(*ones)
    domains = hosts.groupBy("domain").agg(*adds("d"))
    marks, suffixes = (known.groupBy(by).agg(*[x.alias(f"{p}{i}") for i, x in enumerate(ones)]) for by, p in (("markup", "m"), ("suffix", "s")))
    world = hosts.agg(*adds("g")).first()
    world = [world[i] or 0 for i in range(len(langs))]
    n_marks, n_suffixes = marks.count(), suffixes.count()

    joined = s.join(hosts, ["host", "domain"], "left").join(domains, "domain", "left").join(suffixes, "suffix", "left").join(marks, "markup", "left")
    n = lambda p, i: F.coalesce(F.col(f"{p}{i}"), F.lit(0)).cast("double")
    of = lambda p: sum((n(p, i) for i in range(len(langs))), F.lit(0.0))
    posts = []
    any_ = F.col("own").isNotNull().cast("double")
    for i in range(len(langs)):
        mine = F.coalesce((F.col("own") == i).cast("double"), F.lit(0.0))
        p = (world[i] - mine + 1.0) / (sum(world) - any_ + len(langs))
        p = (n("d", i) - mine + STRENGTH * p) / (of("d") - any_ + STRENGTH)
        p = (n("n", i) - mine + STRENGTH * p) / (of("n") - any_ + STRENGTH)
        given = F.log((n("m", i) - mine + 1.0) / (world[i] - mine + n_marks + 1.0)) + F.log((n("s", i) - mine + 1.0) / (world[i] - mine + n_suffixes + 1.0))
        posts.append(F.log(p) + given + ll[i])
    out = joined.withColumn("__post", F.array(*posts)).withColumn("__top", F.array_max("__post"))
    total_ = F.aggregate(F.transform("__post", lambda x: F.exp(x - F.col("__top"))), F.lit(0.0), lambda a, x: a + x)
    conf = F.round(1.0 / total_, 4)
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("__post", F.col("__top")).cast("int"))
    has = F.col("lls").isNotNull()
    return out.select(*keep, F.when(has, lang).otherwise("und").alias("lang"), F.when(has, conf).otherwise(0.0).alias("confidence"), F.coalesce(has & F.col("fits") & (conf >= ACCEPT), F.lit(False)).alias("accepted"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text without markup, declared language, suffix and host of the address)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    body = F.regexp_replace("html", r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|<[^>]*>|&[A-Za-z#0-9]+;", " ")
    mark = F.substring_index(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), "-", 1)
    return pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), body.alias("text"), mark.alias("markup"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def document_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Documents in the same form: the source is their host."""
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("").alias("markup"), F.col("source").alias("host"), F.lit("").alias("suffix"))


def identify(documents: DataFrame, pages: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Language of every document and every page: kind ('document' or 'page'), doc_id or page_id, lang, confidence, accepted."""
    model = fit_documents(documents, fit_rows)
    d = identified(document_rows(pick(documents, "doc_id", "text", "source")), model).withColumn("page_id", F.lit(None).cast("long"))
    p = identified(page_rows(pages), model).withColumn("doc_id", F.lit(None).cast("long"))
    cols = ["doc_id", "page_id", "lang", "confidence", "accepted"]
    return d.select(F.lit("document").alias("kind"), *cols).union(p.select(F.lit("page").alias("kind"), *cols))


def filter_language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose language is accepted; columns stay as they are."""
    model = fit_documents(docs, fit_rows)
    docs, back = masked(docs, "doc_id", "text", "lang", "source")
    keyed = with_row_key(docs)
    gone = identified(document_rows(keyed, "__rid"), model).where("not accepted").select("__rid", F.lit(0).cast("long").alias("gone"))
    return back(keyed.where(looked_up(gone, F.col("__rid")).isNull()))

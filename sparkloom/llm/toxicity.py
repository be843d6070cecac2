"""Operator 8: toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned for each language from labelled documents (:func:`learn`): of at most ``FIT_ROWS``
toxic and as many clean ones of a language, each word is counted by the distinct words that stand before
it, so copies of a text count once. A word of ``LETTERS`` letters or more is a term when its toxic share is
beyond that of all words by a log-likelihood of more than log(words of the language) + ``MARGIN`` (so that
chance gives no term, however many words are tried) and its log-odds reach ``ODDS``; a language keeps its
``TERMS`` best. The terms of all languages form a trie. Its intersection with the Levenshtein automata of
all terms (0 edits for terms under 5 letters, 1 under 9, else 2) is determinised once into one table
automaton, whose states are the sets of (trie node, edits so far) that are still possible. All words of a
batch of texts run through it together, one character a step, and drop out at the dead state. Near words
that also stand in the labelled clean texts are words of their own, not misspellings. Every hit is scored in
its context: fewer points for misspellings and for terms that labelled clean texts use too, a quarter inside quotation marks, half near words of reporting,
half as much again near words of direct address. A document is toxic when its hits reach ``SCORE`` points
in a stretch of ``STRETCH`` words: one plain exact hit does, two misspelled ones do, a quoted one does not.

Defined results: null and empty texts have no hit; repeated rows give repeated rows; words are runs
of letters and digits of the lower-cased text, of any length; equal terms: least edits, then lexicon
order; an empty table gives no rows; labels that are null, other than 0 and 1 or of no document are left
out; a null language is one of its own; without labels, or where they prove no term, nothing is toxic;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import pick, ship, stored
from ._tokens import NORMAL_CLASS, Words, normal_mask, slices, string_buffers

FIT_ROWS, LETTERS, MARGIN, ODDS, TERMS = 2000, 4, 1.0, 3.0, 48
BROADCAST_ROWS = 200_000  # of labelled rows; more are joined with a shuffle
REPORTING = frozenset("said says say quoted quote quotes called calls wrote writes word words term terms phrase slur insult insults defined means meaning quotation citation cited".split())
ADDRESS = frozenset("you your youre yours yourself u ur du dich dir ihr euch tu te toi vous eres".split())
CONTEXT, STRETCH, SCORE = 8, 200, 1.0
UNIT = 10_000  # points are whole numbers, so sums do not depend on their order
EDIT_POINTS = (UNIT, 6_000, 5_000)
# (what stands before a quoted word, in the context; the mark that must follow)
QUOTES = (
    (r'^[^"]*"(?:[^"]*"[^"]*")*[^"]*$', '"'),
    (r"“[^”]*$", "”"),
    (r"«[^»]*$", "»"),
    (r"„[^“]*$", "“"),
    (r"(?:^|[ \t\n\f\r])‘[^’]*$", "’"),
    (r"(?:^|[ \t\n\f\r])'[^']*$", "'"),
)
_QUOTES = tuple((re.compile(before.removesuffix("$") + r"\Z"), after) for before, after in QUOTES)


class Lexicon(NamedTuple):
    """Terms, near words that are no misspellings of them, and terms that clean texts use too."""

    terms: tuple[str, ...]
    innocent: frozenset[str] = frozenset()
    doubtful: frozenset[str] = frozenset()


def edits_of(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def automaton(terms: tuple[str, ...]) -> dict:
    """Transition table [state, class of a letter], and for each state the accepted term (-1: none) and its edits. State 0 is dead, 1 the start."""
    letters = sorted({ord(ch) for t in terms for ch in t})
    other, place = len(letters), {c: i for i, c in enumerate(letters)}
    kids: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]
    for t, term in enumerate(terms):
        node, k = 0, edits_of(term)
        most[0] = max(most[0], k)
        for ch in term:
            c = place[ord(ch)]
            if c not in kids[node]:
                kids[node][c] = len(kids)
                kids.append({})
                ends.append([])
                most.append(0)
            node = kids[node][c]
            most[node] = max(most[node], k)
        ends[node].append(t)

    def closed(pairs: dict[int, int]) -> frozenset:
        todo = list(pairs.items())
        while todo:  # a letter of the term may be missing
            node, e = todo.pop()
            if pairs.get(node, 9) < e:
                continue
            for kid in kids[node].values():
                if e + 1 <= most[kid] and e + 1 < pairs.get(kid, 9):
                    pairs[kid] = e + 1
                    todo.append((kid, e + 1))
        return frozenset(pairs.items())

    def step(state: frozenset, c: int) -> frozenset:
        nxt: dict[int, int] = {}
        for node, e in state:
            if e + 1 <= most[node] and e + 1 < nxt.get(node, 9):
                nxt[node] = e + 1  # a letter too many
            for kc, kid in kids[node].items():
                cost = e + (kc != c)  # right or wrong letter
                if cost <= most[kid] and cost < nxt.get(kid, 9):
                    nxt[kid] = cost
        return closed(nxt)

    start = closed({0: 0})
    number, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
    at = 0
    while at < len(order):
        state = order[at]
        own = {c for node, _ in state for c in kids[node]}
        row = None
        for c in (other, *own):  # letters that no node of the state expects all act as ``other``
            key = step(state, c)
            if key not in number:
                number[key] = len(order)
                order.append(key)
            if row is None:
                row = [number[key]] * (other + 1)
            row[c] = number[key]
        table.append(row)
        at += 1
    term, cost = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int8)
    for s, state in enumerate(order):
        best = min(((e, t) for node, e in state for t in ends[node] if e <= edits_of(terms[t])), default=None)
        if best:
            cost[s], term[s] = best
    classes = np.full(max(letters, default=0) + 2, other, np.int32)
    classes[letters] = np.arange(other)
    return {"table": np.array(table, np.int32), "classes": classes, "term": term, "cost": cost}


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of UTF-8 bytes, number of characters before each byte and at the end)."""
    lead = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    out = raw[at].astype(np.int32)
    for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        wide = np.flatnonzero((out >= low) & (out < high) & (raw[at] >= low))
        value = out[wide] & mask
        for i in range(1, size):
            value = (value << 6) | (raw[at[wide] + i] & 0x3F)
        out[wide] = value
    return out, before


def match(words: Words, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, term, edits) of every word that the automaton accepts."""
    table, term, classes = m["table"], m["term"], m["classes"]
    points, before = code_points(words.raw)
    kind = classes[np.minimum(points, len(classes) - 1)]
    at = np.arange(len(words.starts))
    pos, end = before[words.starts], before[words.ends]
    state = np.ones(len(at), np.int32)
    hits, states = [], []
    while len(at):
        state = table[state, kind[pos]]
        pos += 1
        live = state != 0
        at, pos, state = at[live], pos[live], state[live]
        done = pos == end[at]
        if done.any():
            ok = done & (term[state] >= 0)
            hits.append(at[ok])
            states.append(state[ok])
            at, pos, state = at[~done], pos[~done], state[~done]
    if not hits:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    hit, st = np.concatenate(hits), np.concatenate(states)
    order = np.argsort(hit)
    return hit[order], term[st[order]].astype(int), m["cost"][st[order]].astype(int)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(lang, toxic, text) of the labelled documents, at most ``limit`` of each language and label: those of the least hash of doc_id."""
    spark = docs.sparkSession
    lab = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct()
    own = pick(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    ids = stored(own.select("doc_id", "lang").join(lab, "doc_id").select("doc_id", "lang", "toxic", F.xxhash64("doc_id").alias("h")))
    # hashes are spread evenly, so about this share of them holds the least ``limit``
    sizes = {(r["lang"], r["toxic"]): r["n"] for r in ids.groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "lang string, toxic int, text string")
    edges = [(lang, toxic, (1 << 63) - 1 if (share := (limit + 8 * math.sqrt(limit) + 32) / n) >= 1 else int((share - 0.5) * 2.0**64)) for (lang, toxic), n in sizes.items()]
    near = ids.join(F.broadcast(spark.createDataFrame(edges, "lang string, toxic int, edge long")), ["lang", "toxic"]).where("h <= edge")
    rank = F.row_number().over(Window.partitionBy("lang", "toxic").orderBy("h", "doc_id"))
    chosen = stored(near.withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", "lang", "toxic").distinct())
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    return own.join(few, ["doc_id", "lang"]).select("lang", "toxic", "text")


def word_evidence(rows: DataFrame) -> DataFrame:
    """(lang, word, t, c): distinct words before each word in the toxic and in the clean ones of rows(lang, toxic, text)."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(NORMAL_CLASS), F.lit(0))
    pairs = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.col("w")[i - 1]).otherwise("").alias("before")))
    pairs = F.filter(pairs, lambda p: (F.length(p["word"]) >= LETTERS) & ~p["word"].rlike("[0-9]"))
    each = rows.select("lang", "toxic", w.alias("w")).select("lang", "toxic", F.explode(F.array_distinct(pairs)).alias("p")).select("lang", "toxic", "p.*").distinct()
    return each.groupBy("lang", "word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def learn(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, terms: int = TERMS) -> Lexicon:
    """The lexicon of ``docs(doc_id, lang, text)`` with ``labels(doc_id, toxic)``: at most ``terms`` of each language."""
    spark = docs.sparkSession
    ship(spark)
    words = stored(word_evidence(labelled(docs, labels, limit)))
    sums = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("t").alias("all_t"), F.sum("c").alias("all_c"))
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    n, p0 = t + c, F.col("all_t") / (F.col("all_t") + F.col("all_c"))
    gain = F.when(t > 0, t * F.log(t / (n * p0))).otherwise(0.0) + F.when(c > 0, c * F.log(c / (n * (1 - p0)))).otherwise(0.0)
    odds = F.log((t + 0.5) / (F.col("all_t") + 1)) - F.log((c + 0.5) / (F.col("all_c") + 1))
    proven = words.join(F.broadcast(sums), "lang").where("t > 0 and all_c > 0").withColumn("gain", gain).where((F.col("gain") > F.log("v") + MARGIN) & (odds >= ODDS))
    best = proven.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("gain"), "word"))).where(F.col("r") <= terms)
    rows = best.groupBy("word").agg(F.sum("c").alias("c")).collect()
    found = tuple(sorted(r["word"] for r in rows))
    if not found:
        return Lexicon(())
    shared = spark.sparkContext.broadcast(automaton(found))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            for a, b, r, o in slices(raw, off):
                words_ = Words(r, o, np.ones(len(r), bool))
                hit, _, cost = match(words_, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(hit[cost > 0]))], names=["word"])

    innocent = words.where("c > 0").select("word").mapInArrow(near, "word string").distinct().collect()
    return Lexicon(found, frozenset(r["word"] for r in innocent), frozenset(r["word"] for r in rows if r["c"]))


def context_score(words: Words, i: int, lo: int, hi: int, begin: int, end: int, edits: int) -> tuple[int, bool]:
    """Points of the hit at word i of the text of words lo..hi and bytes begin..end, and whether it is quoted. A doubtful term counts as one edit."""
    a, b = max(lo, i - CONTEXT), min(hi, i + CONTEXT + 1)
    raw = words.raw
    before = raw[words.starts[a] if a > lo else begin : words.starts[i]].tobytes().decode()
    after = raw[words.ends[i] : words.starts[b] if b < hi else end].tobytes().decode()
    quoted = any(close in after and opened.search(before) for opened, close in _QUOTES)
    near = {raw[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b])}
    return EDIT_POINTS[edits] * (1 if quoted else 4) * (1 if near & REPORTING else 2) * (3 if near & ADDRESS else 2) // 16, quoted


def judge(hits: list[tuple[int, int, int, int, bool]]) -> int:
    """Most points in a stretch, of (word, term, edits, points, quoted) in order."""
    best, a, total = 0, 0, 0
    for h in hits:
        total += h[3]
        while h[0] - hits[a][0] >= STRETCH:
            total -= hits[a][3]
            a += 1
        best = max(best, total)
    return best


RESULT = "doc_id long, score double, n_hits int, n_misspelled int, n_quoted int, terms string"


def toxic_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = SCORE) -> DataFrame:
    """The toxic ones of ``docs(doc_id, text)``: doc_id, score, n_hits, n_misspelled, n_quoted, terms (sorted, joined by commas)."""
    spark = docs.sparkSession
    ship(spark)
    if not lexicon.terms:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast((automaton(lexicon.terms), lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (terms, innocent, doubtful) = shared.value
        less = np.array([t in doubtful for t in terms])
        for batch in batches:
            ids = batch.column(0)
            raw, off = string_buffers(batch.column(1))
            out = []
            for a, _b, r, o in slices(raw, off):
                words = Words(r, o, normal_mask(r))
                hit, term, cost = match(words, m)
                own = np.array([k == 0 or r[words.starts[i] : words.ends[i]].tobytes().decode() not in innocent for i, k in zip(hit.tolist(), cost.tolist())], bool)
                hit, term, cost = hit[own], term[own], cost[own]
                doc = np.searchsorted(words.doc, hit, "right") - 1
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                for x, y in zip(cut, [*cut[1:], len(doc)]):
                    lo, hi = int(words.doc[doc[x]]), int(words.doc[doc[x] + 1])
                    hits = [(int(hit[i]), int(term[i]), int(cost[i]), *context_score(words, int(hit[i]), lo, hi, int(o[doc[x]]), int(o[doc[x] + 1]), max(int(cost[i]), int(less[term[i]])))) for i in range(x, y)]
                    score = judge(hits) / UNIT
                    if score >= threshold:
                        out.append((ids[a + int(doc[x])].as_py(), score, len(hits), sum(h[2] > 0 for h in hits), sum(h[4] for h in hits), ",".join(sorted({terms[h[1]] for h in hits}))))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "score", "n_hits", "n_misspelled", "n_quoted", "terms"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(run, RESULT)

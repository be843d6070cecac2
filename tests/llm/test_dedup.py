"""Operators 2, 5 and 9 against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import minhash, substring_dedup, suffix_dedup
from sparkloom.llm._tokens import Words, window_hashes
from sparkloom.llm.components import components

from .conftest import prose

SHARED = prose(99, 60)


def rows_with_repeats():
    return [
        (1, prose(1, 120)), (2, prose(2, 40) + " " + SHARED + " " + prose(3, 40)), (3, SHARED + "\n" + prose(4, 30)), (4, prose(1, 120)),
        (5, prose(6, 30) + "  " + SHARED), (6, " ".join(["spam"] * 130)), (7, prose(7, 49)), (8, prose(7, 49)), (9, prose(8, 50)), (10, prose(8, 50)),
        (None, prose(8, 50)), (11, None), (12, ""), (13, prose(13, 700)),
    ]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def brute_runs(rows, n):
    where = defaultdict(list)
    for k, (_, t) in enumerate(order(rows)):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((k, i))
    flags, first = defaultdict(set), set()
    for spots in where.values():
        if len(spots) > 1:
            first.add(min(spots))
            for k, i in spots:
                flags[k].add(i)
    out = []
    for k, (d, _) in enumerate(order(rows)):
        run = []
        for i in sorted(flags[k]):
            if run and i != run[-1] + 1:
                out.append((d, run[0], run[-1] + n, len(run), sum((k, j) in first for j in run)))
                run = []
            run.append(i)
        if run:
            out.append((d, run[0], run[-1] + n, len(run), sum((k, j) in first for j in run)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "direct"), [(50, 2048), (12, 2048), (3, 2048), (12, 1), (3, 2)])
def test_repeats_equal_brute_force(make, n, direct):
    """``direct`` below the number of buckets takes the second hop."""
    rows = rows_with_repeats()
    want = brute_runs(rows, n)
    got = [tuple(r) for r in suffix_dedup.suffix_repeats(make(rows).coalesce(1), n, direct).collect()]
    assert sorted(got, key=str) == want
    spans = [tuple(r) for r in substring_dedup.substring_repeats(make(rows).repartition(3), n, direct).collect()]
    assert sorted(spans, key=str) == sorted([(d, a, b, b - a) for d, a, b, _, _ in want], key=str)


def test_anchors_equal_brute_force(make):
    """The windows that are extended: those that hold a reference block of another place, or a window that equals their own block."""
    from sparkloom.llm._common import with_row_key

    rows = order(rows_with_repeats())
    texts = [(t or "").split() for _, t in rows]
    blocks, windows = defaultdict(set), defaultdict(set)
    for k, w in enumerate(texts):
        for i in range(len(w) - 5):
            windows[tuple(w[i : i + 6])].add((k, i))
            if i % 6 == 0:
                blocks[tuple(w[i : i + 6])].add((k, i))
    hit = {spot for value, spots in windows.items() if value in blocks and len(spots) > 1 for spot in spots}
    want = {}
    for k, w in enumerate(texts):
        starts = sorted(s for s in range(len(w) - 11) if any((k, s + o) in hit for o in range(7)))
        if starts:
            want.setdefault((rows[k][0], rows[k][1]), []).append(starts)
    keyed = with_row_key(make(rows).toDF("doc_id", "text", *[f"c{i}" for i in range(8)]).select("doc_id", "text"))
    of = {r["__rid"]: (r["doc_id"], r["text"]) for r in keyed.collect()}
    got = {}
    for r in substring_dedup.anchors(keyed, 12).collect():
        ranges = np.frombuffer(r["extra"], np.int32).reshape(-1, 2)
        got.setdefault(of[r["__rid"]], []).append([i for a, b in ranges for i in range(a, b)])
    assert got == want


def test_lookup(spark):
    from pyspark.sql import functions as F

    from sparkloom.llm._lookup import looked_up

    keys = spark.range(0, 5000, 1, 3)
    some = spark.range(0, 9000, 7).select(F.col("id").alias("__rid"), (F.col("id") * 2).alias("v"))
    got = keys.withColumn("v", looked_up(some, F.col("id"), 100)).collect()
    assert all(r["v"] == (2 * r["id"] if r["id"] % 7 == 0 else None) for r in got)
    raw = some.select("__rid", F.encode(F.col("v").cast("string"), "UTF-8").alias("v"))
    got = keys.withColumn("v", looked_up(raw, F.col("id"), 250)).collect()
    assert all(r["v"] == (str(2 * r["id"]).encode() if r["id"] % 7 == 0 else None) for r in got)
    assert keys.withColumn("v", looked_up(some.where("v < 0"), F.col("id"))).where("v is not null").count() == 0


def test_colliding_first_parts_are_told_apart():
    from sparkloom.llm._exchange import equal_runs

    key = np.array([8, 8, 6, 8, 8, 6], np.uint64)
    second = np.array([1, 2, 5, 1, 3, 5], np.uint64)
    order_, again = equal_runs(key, second, 1)
    assert [(int(key[i]), int(second[i]), bool(x)) for i, x in zip(order_, again)] == [(6, 5, False), (6, 5, True), (8, 1, False), (8, 1, True), (8, 2, False), (8, 3, False)]
    assert suffix_dedup.not_alone(key, second)[0].tolist() == [True, False, True, True, False, True]


def test_remove_repeats(make):
    rows = rows_with_repeats()
    docs = make(rows)
    out = suffix_dedup.remove_repeats(docs.coalesce(1))
    assert out.columns == docs.columns
    got = {r[0]: r[1] for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()}
    texts = dict(rows)
    assert got[1] == texts[1]
    assert 4 not in got
    assert 10 not in got
    assert None not in got
    assert got[2] == texts[2]
    assert got[3] == prose(4, 30)
    assert got[5].split() == prose(6, 30).split()
    assert got[7] == texts[7]
    assert got[8] == texts[8]
    assert got[11] is None
    assert got[12] == ""
    assert got[6].split() == ["spam"] * 50
    lengths = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select("c1", "c4").collect()
    assert all(r["c4"] == len(r["c1"]) for r in lengths if r["c1"] is not None)


def test_edge_cases(edge, make):
    got = {tuple(r) for r in suffix_dedup.suffix_repeats(edge).collect()}
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, 80), (8, 0, 80)}
    spans = [tuple(r) for r in substring_dedup.substring_repeats(edge).collect()]
    assert sorted(spans) == [(1, 0, 80, 80), (1, 0, 80, 80), (8, 0, 80, 80)]
    near = sorted(tuple(r) for r in minhash.near_duplicates(edge).collect())
    assert near == [(1, 1, 2), (1, 1, 2), (8, 1, 2)]
    kept = minhash.near_dedup(edge)
    assert kept.columns == edge.columns
    assert kept.count() == edge.count() - 2
    empty = make([])
    assert suffix_dedup.suffix_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.substring_repeats(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_dedup(empty).count() == 0


def brute_groups(rows, jaccard):
    """(doc_id, class, links) of each row that is linked to another."""
    rows = order(rows)
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(3, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= jaccard * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links[i] += 1
                links[j] += 1
    return sorted(((rows[i][0], rows[find(i)][0], links[i]) for i in range(len(rows)) if links[i]), key=str)


def test_near_duplicates_equal_brute_force(make):
    import random

    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(1000 + g, 150).split()
        for c in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 2, 5, 9])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(w)))
    rows += [(5001, "Short one"), (5002, "short  ONE"), (5003, "alone"), (None, "Short one"), (5004, None), (5005, "")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(make(rows).repartition(3)).collect()), key=str)
    assert got == brute_groups(rows, minhash.JACCARD)


def test_large_groups_are_verified_in_blocks(make):
    """Chains of texts, of which only neighbours are similar, in buckets and groups above their limits."""
    import random

    from sparkloom.llm._common import pick, with_row_key

    rng = random.Random(14)
    rows = []
    for g in range(3):
        w = prose(2000 + g, 90).split()
        for c in range(30):
            for _ in range(9):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(w)))
    rows += [(7000 + i, prose(2000, 90) + f" tail{i}") for i in range(20)] + [(8000, prose(2000, 90)), (8001, prose(2000, 90))]
    rng.shuffle(rows)
    keyed = with_row_key(pick(make(rows), "doc_id", "text"))
    got = [(r["doc_id"], r["kept_doc_id"], r["links"]) for r in minhash.classed(keyed, bucket=3, block=8, counts=True).collect()]
    want = brute_groups(rows, minhash.JACCARD)
    assert sorted(got, key=str) == want
    gone = {(r["doc_id"], r["kept_doc_id"]) for r in minhash.removals(keyed, bucket=3, block=8).collect()}
    assert gone == {(i, k) for i, k, _ in want if i != k}


@pytest.mark.parametrize("bitmap", [minhash.BITMAP, 0])
def test_links_of_a_group(monkeypatch, bitmap):
    monkeypatch.setattr(minhash, "BITMAP", bitmap)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < rng.choice([0.3, 0.7, 0.9])], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for _ in range(60)]
    pairs = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert {(i, j) for i, hit in minhash.neighbours(sets, 0.5) for j in hit.tolist()} == pairs
    assert {(i, j) for i, hit in minhash.neighbours(sets, 0.5, 25) for j in hit.tolist()} == {(i, j) for i, j in pairs if i < 25 <= j}
    weights = rng.integers(1, 4, 60)
    label, links = minhash.linked_in(sets, 0.5, weights)
    assert links.tolist() == [int(weights[i] - 1 + sum(weights[a + b - i] for a, b in pairs if i in (a, b))) for i in range(60)]
    assert (label == minhash.groups_in(sets, 0.5)).all()


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        both = rng.integers(0, 1 << 32, int(1000 * share), dtype=np.uint32)
        sets = [np.concatenate([both, rng.integers(0, 1 << 32, int(1000 * (1 - share) / 2), dtype=np.uint32)]) for _ in range(2)]
        sig = minhash.signatures(np.concatenate(sets), np.array([0, len(sets[0])]), 1024)
        assert abs((sig[:, 0] == sig[:, 1]).mean() - share) < 0.06


def test_permutations_are_bijections():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.sigma(x))) == len(x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 102), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | dict.fromkeys((100, 101, 102, 103), 100)


def test_window_hashes_depend_on_words_only():
    text = b"one two three one two three four"
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    (h,) = window_hashes(w.hashes(), (3,))
    assert h[0] == h[3]
    assert len(set(h.tolist())) == 4


def test_labels_fill_partitions_evenly(spark):
    from pyspark.sql import functions as F

    from sparkloom.llm._exchange import labels

    for n in (1, 12, 51):
        rows = spark.createDataFrame([(int(x),) for x in labels(n)], "x int").select(F.pmod(F.hash("x"), F.lit(n))).collect()
        assert [r[0] for r in rows] == list(range(n))

"""The pipeline: stages, their columns and decisions, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm._common import stored
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.queries import QUERIES

from .conftest import prose

DATA = "/root/testdata/sf0.001"
WITH_SQL = sorted(ORACLES)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A small corpus with one case of each kind."""
    d = tmp_path_factory.mktemp("world")
    item = prose(701, 30)
    shared = prose(702, 60)
    rows = [(i, prose(i, 120), "en", f"src{i % 2}") for i in range(30)]
    near = prose(3, 120).split()
    near[60] = "changed"
    rows += [(100, prose(2, 120), "en", "src0"), (101, " ".join(near), "en", "src1"), (102, None, "en", None), (103, "", "en", "src0"), (104, "12 34 ... 56", "en", "src0")]
    rows += [(200, shared + " " + prose(200, 80), "en", "src0"), (201, prose(201, 80) + " " + shared, "en", "src0"), (300, prose(300, 70) + " " + item + " " + prose(301, 70), "en", "src1"), (301, item, "en", "src1")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r[1] for r in rows}, shared, item


def test_stages(spark, world):
    d, texts, shared, item = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, d))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()} if name != "packing" else out.collect()
        docs = out
    kept = seen["language_id"]
    assert set(texts) - set(kept) == {102, 103, 104}
    near = seen["minhash_near_dedup"]
    assert set(kept) - set(near) == {100, 101}
    cut = seen["suffix_array_dedup"]
    assert set(cut) == set(near)
    assert cut[200] == texts[200]
    assert cut[201].strip() == prose(201, 80)
    assert {i for i in cut if cut[i] != near[i]} == {201}
    clean = seen["benchmark_decontamination"]
    assert set(cut) - set(clean) == {301}
    assert item not in " ".join(clean.values())
    assert {i for i in clean if clean[i] != cut[i]} == {300}
    words = [w for r in seen["packing"] for w in r["text"].split()]
    assert len(words) + sum(r["truncated"] for r in seen["packing"]) == sum(len(t.split()) for t in clean.values())
    assert sorted(words) == sorted(w for t in clean.values() for w in t.split())


def test_run_equals_stages(spark, world):
    d = world[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, d))
    got = corpus_pipeline.run(spark, d)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_stages_of_an_empty_table(spark, world):
    """And of one with nulls and repeated rows only."""
    d = world[0]
    full = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], full.schema)
    for docs in (full.where("false"), odd):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, d))
            if name != "packing":
                assert docs.columns == full.columns
        assert docs.count() == 0


def test_near_and_exact_stages_equal_brute_force(spark, world):
    """Near-dedup and repeat removal on the pipeline's own input, against loops over all pairs and all windows."""
    from .test_dedup import brute_groups

    d, texts, _, _ = world
    docs = stored(corpus_pipeline.language(spark, spark.read.parquet(f"{d}/documents.parquet"), d))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = stored(corpus_pipeline.near_duplicates(spark, docs, d))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, k, _ in brute_groups(rows, 0.5) if i != k}
    seen, want, n = set(), {}, {}
    words = {r["doc_id"]: r["text"].split() for r in kept.orderBy("doc_id").collect()}
    for w in words.values():
        for i in range(len(w) - 49):
            n[tuple(w[i : i + 50])] = n.get(tuple(w[i : i + 50]), 0) + 1
    for doc_id, w in words.items():
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        first = {i + k for i, x in enumerate(windows) if x not in seen and n[x] > 1 for k in range(50)}
        again = {i + k for i, x in enumerate(windows) if x in seen for k in range(50)}
        want[doc_id] = [x for i, x in enumerate(w) if i not in again - first]
        seen |= set(windows)
    got = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.repeated_passages(spark, kept, d).collect()}
    assert got == {i: w for i, w in want.items() if w}


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    have = [c[0] for c in cur.description]
    want = sorted(tuple(r[have.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_registered():
    import __spark_entry__ as e

    assert {*QUERIES, "pipeline"} <= set(e.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))

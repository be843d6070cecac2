"""Sources, sinks, command line and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.functions.codepoints import unescape
from sparkloom.operators.counting import raw_count
from sparkloom.sources import text as src
from sparkloom.streaming.counts import raw_count_stream, read_line_stream, windowed_count_stream


def test_lines_keep_carriage_returns(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\n\ny")
    (tmp_path / "b.txt").write_bytes(b"z\n")
    assert sorted(r[0] for r in src.read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["", "x\r", "y"]
    both = src.read_ordered_lines(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")])
    assert [r["value"] for r in src.first_sentences(both, 2, ["file_no", "line_no"]).collect()] == ["z", "x\r"]
    with pytest.raises(Exception, match="(?i)path"):
        src.read_lines(spark, str(tmp_path / "missing.txt")).collect()


def test_jsonl_and_dictionary(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a b", "x": 1}\n{"text": "  "}\n{"y": 2}\nnot json\n')
    assert [r[0] for r in src.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == ["a b"]
    (tmp_path / "d.tsv").write_text("我们\t8\n\nx\nno\tnumber\nzero\t0\n我们\t9\n\t3\nfine\t2.5e1 tail\n")
    assert {r["word"]: r["freq"] for r in src.read_dictionary(spark, str(tmp_path / "d.tsv")).collect()} == {"我们": 8.0, "fine": 25.0}


def test_count_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "token string, freq long")
    src.write_counts_file(counts, str(tmp_path / "x.tsv"))
    assert (tmp_path / "x.tsv").read_text() == "c\t5\na\t2\nb\t2\n"
    src.write_counts(counts, str(tmp_path / "y"))
    lines = [line for f in sorted((tmp_path / "y").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["c\t5", "a\t2", "b\t2"]


def test_command_line(spark, tmp_path, capsys):
    text = tmp_path / "t.txt"
    text.write_text("the cat sat\nthe cat ate\n" * 20)
    assert cli.main(["pretokenize", "--input", str(text)]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "the ▁cat ▁sat"
    assert cli.main(["raw-count", "--input", str(text), "--output", str(tmp_path / "c.tsv")]) == 0
    assert (tmp_path / "c.tsv").read_text().splitlines()[:2] == ["the\t40", "▁cat\t40"]
    assert "lines=40 tokens=4" in capsys.readouterr().out
    assert cli.main(["count", "--method", "piece", "--input", str(text), "--model", str(tmp_path / "m"), "--vocab-size", "270", "--unknown-flag"]) == 0
    assert cli.main(["tokenize", "--model", str(tmp_path / "m.model"), "--input", str(text)]) == 0
    assert unescape(capsys.readouterr().out.splitlines()[0].replace(" ", "")).decode() == "the▁cat▁sat"
    assert cli.main(["encode", "--model", str(tmp_path / "m.model"), "--input", str(text)]) == 0
    ids = [line.split("\t")[1] for line in capsys.readouterr().out.split("\n\n")[0].splitlines()]
    (tmp_path / "ids.txt").write_text(" ".join(ids) + "\n")
    assert cli.main(["decode", "--model", str(tmp_path / "m.model"), "--input", str(tmp_path / "ids.txt")]) == 0
    assert capsys.readouterr().out == "the cat sat\n"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b\n\na c\n")
    (tmp_path / "in" / "b.txt").write_text("a b\n")
    q = raw_count_stream(read_line_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["token"], r["freq"]) for r in spark.table("counts").collect()}
    want = {(r["token"], r["freq"]) for r in raw_count(src.read_lines(spark, str(tmp_path / "in")), column="value").collect()}
    assert got == want


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a b"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:31:00", "b")], "t string, value string")
    df.select(F.to_timestamp("t").alias("t"), "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, value string").parquet(str(tmp_path / "in"))
    q = windowed_count_stream(stream, "t").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"].minute, r["token"], r["freq"]) for r in spark.table("windows").collect()} == {(0, "a", 2), (0, "▁b", 1), (30, "b", 1)}


def test_articles(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "# Title\\n\\u00a0a\\u3000 b", "x": 1}\n{"text": "\\u3000\\u001c"}\n{"text": "## only"}\n{"text": "\\u6f22"}\n')
    lines = src.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r[0] for r in src.json_articles(lines).collect()] == ["a b", "\u6f22"]
    assert [r[0] for r in src.json_articles(lines, simplify={"\u6f22": "\u6c49"}).collect()] == ["a b", "\u6c49"]
    src.write_jsonl(spark.createDataFrame([(1, "a", None)], "n int, text string, z string"), str(tmp_path / "out"), ["text", "n"])
    assert [r[0] for r in src.read_lines(spark, str(tmp_path / "out")).collect()] == ['{"text":"a","n":1}']


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from sparkloom.session import checkpoint_dir

    none = SimpleNamespace(isDefined=lambda: False)
    cluster = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=cluster, conf=SimpleNamespace(get=lambda *_: None)))
    assert checkpoint_dir(spark)

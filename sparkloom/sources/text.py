"""Text, TSV, JSONL and dictionary sources and sinks."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, simplify_chinese, strip

log = logging.getLogger("sparkloom")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files: value. A carriage return stays; a missing file is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("lineSep", "\n").text(paths)


def read_ordered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines in the given order of the files: file_no, line_no (increasing in a file, with gaps), value."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [read_lines(spark, p).select(F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("line_no"), "value") for i, p in enumerate(paths)]
    return reduce(DataFrame.union, parts)


def first_sentences(lines: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n non-empty lines (0: all) in an explicit order."""
    lines = lines.where(F.length("value") > 0)
    return lines.orderBy(*order).limit(n) if n > 0 else lines


def read_jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """The text field of JSON lines, without missing and blank ones."""
    return json_texts(read_lines(spark, path), field)


def json_texts(lines: DataFrame, field: str = "text", column: str = "value") -> DataFrame:
    """lines with the field of their JSON as text, without missing and blank ones."""
    return lines.withColumn("text", F.get_json_object(column, f"$.{field}")).where(strip(F.col("text")) != "").drop(column)


def json_articles(lines: DataFrame, field: str = "text", column: str = "value", simplify: dict[str, str] | None = None) -> DataFrame:
    """lines with the cleaned field of their JSON as text, in simplified characters where a table is given; articles of which nothing is left go."""
    text = clean_text(F.col("text"))
    out = json_texts(lines, field, column).withColumn("text", simplify_chinese(text, simplify) if simplify else text)
    return out.where("text <> ''")


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    """The chosen columns (none: all) as JSON lines; with ``spark.read`` of any format and address, a corpus fetched and cut to what is needed."""
    kept = df.select(*columns) if columns else df
    write_lines(kept.select(F.to_json(F.struct(*kept.columns)).alias("value")), path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, freq of a TSV dictionary: the first of each word; malformed rows and frequencies not above 0 are skipped."""
    rows = read_ordered_lines(spark, path)
    at = F.instr("value", "\t")
    rows = rows.where(at > 1).select("line_no", F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("word"), F.expr("substring(value, instr(value, '\t') + 1)").alias("rest"))
    number = F.regexp_extract("rest", r"^[ \t]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    rows = rows.withColumn("freq", F.expr("try_cast(nullif(regexp_extract(rest, '^[ \\\\t]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') as double)")).where(number != "")
    first = F.row_number().over(Window.partitionBy("word").orderBy("line_no"))
    return rows.where("freq > 0").withColumn("rn", first).where("rn = 1").select("word", "freq")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.option("lineSep", "\n").mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """token TAB freq lines in files ordered by freq (descending), token."""
    rows = counts.orderBy(F.desc("freq"), "token").select(F.concat_ws("\t", "token", F.col("freq").cast("string")).alias("value"))
    write_lines(rows, path)


def write_counts_file(counts: DataFrame, path: str) -> None:
    """The same as one local file, streamed partition by partition through the driver (for the command line)."""
    with Path(path).open("w", encoding="utf-8", newline="\n") as f:
        for r in counts.orderBy(F.desc("freq"), "token").toLocalIterator(prefetchPartitions=True):
            f.write(f"{r['token']}\t{r['freq']}\n")
    log.info("wrote %s", path)

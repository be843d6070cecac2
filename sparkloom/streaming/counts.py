"""Token counts over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretokenize


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New text files of a folder as lines: value."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(path)


def raw_count_stream(lines: DataFrame, cut: int = 0, reconstruct: bool = False, column: str = "value") -> DataFrame:
    """Running (token, freq), for output mode complete or update."""
    tokens = lines.where(F.length(column) > 0).select(F.explode(pretokenize(F.col(column), cut, reconstruct)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("freq"))


def windowed_count_stream(lines: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", cut: int = 0, column: str = "value") -> DataFrame:
    """(start, token, freq) by event-time window, with a watermark that bounds the state."""
    tokens = lines.withWatermark(time, late).where(F.length(column) > 0).select(time, F.explode(pretokenize(F.col(column), cut)).alias("token"))
    return tokens.groupBy(F.window(time, window).alias("w"), "token").agg(F.count("*").alias("freq")).select(F.col("w.start").alias("start"), "token", "freq")

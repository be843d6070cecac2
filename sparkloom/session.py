"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: int | str = "*", app: str = "sparkloom", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package (on a cluster that does not share this folder, pass it with --py-files)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, set as the checkpoint folder.

    Where the setting is absent, a temporary folder on one machine, as in tests; on a cluster that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir().isDefined():
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))
    return (folder or context.getCheckpointDir().get()).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_table(docs: DataFrame) -> DataFrame:
    """Non-empty lines of ``docs(doc_id, text)``: doc_id, line_no (from 0), line.

    A small scan is one task; the regular expressions that follow are the cost, so it is spread over the
    cores once, before any text is multiplied. On a scan that already has a task a core nothing is moved.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return spread(lines.where(F.length("line") > 0))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input has fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

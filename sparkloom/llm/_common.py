"""Shared helpers of the training-data operators: row keys, checkpoints, table loading."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_STABLE = {"Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias"}
_LEAN: list[bool] = []
MAX_FILES = 1_000_000  # of an input whose list of files is broadcast


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder that the driver imported it from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def lean() -> None:
    """In a Python worker: large buffers are given back to the system as soon as they are freed.

    Otherwise the allocators of several workers of an executor each keep the most that any task has used.
    """
    if not _LEAN:
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):  # glibc
            for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
                libc.mallopt(option, value)
        _LEAN.append(True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (columns of it can be read on their own)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/sparkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, name: str = "__rid") -> DataFrame:
    """Add a unique key of every row, the same each time the plan runs, in the order of the table.

    It is the number of the row's file and its place in that file, whatever the splits of the scan are. Plans that
    are more than columns and rows chosen from a file scan are stored first.
    """
    keyed = _file_key(docs, name)
    return keyed if keyed is not None else _file_key(stored(docs), name)


def _file_key(docs: DataFrame, name: str) -> DataFrame | None:
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().split(" ")[0] not in _STABLE:
            return None
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    try:
        at = docs.metadataColumn("_metadata")
        place = docs.select("*", at["file_path"].alias("__file"), at["row_index"].alias("__row"))
        files = sorted(r[0] for r in place.select("__file").distinct().limit(MAX_FILES + 1).collect())
    except AnalysisException:  # not a file scan
        return None
    if len(files) > MAX_FILES:
        return None
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __number long")
    return place.join(F.broadcast(numbers), "__file").withColumn(name, F.shiftleft("__number", 40) + F.col("__row")).drop("__file", "__number", "__row")


def buckets(spark: SparkSession) -> int:
    """How many hash buckets an exchange has; follows spark.sql.shuffle.partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(df: DataFrame, *names: str):  # noqa: ANN201
    """``df`` with all other columns renamed by position, so that none can clash; and a function that puts the names back."""
    new = [c if c in names and c not in df.columns[:i] else f"__u{i}" for i, c in enumerate(df.columns)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*new).toDF(*df.columns)

    return df.toDF(*new), back


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever the others are called."""
    return masked(df, *names)[0].select(*names)

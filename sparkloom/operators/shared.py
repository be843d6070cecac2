"""Tables that every task needs whole, by way of the shared folder instead of the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import checkpoint_dir

_READ: dict[tuple[str, ...], pa.Table] = {}
_BUILT: dict[tuple, object] = {}


def write_shared(df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` as written to the shared folder, and its files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out, tuple(sorted(out.inputFiles()))


def read_shared(files: tuple[str, ...]) -> pa.Table:
    """All rows, in a Python worker; the last table is kept for the worker's next task."""
    if files not in _READ:
        import pyarrow.parquet as pq
        from pyarrow import fs

        parts = []
        for uri in files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                parts.append(pq.read_table(f))
        _READ.clear()
        _READ[files] = pa.concat_tables(parts) if parts else pa.table({})
    return _READ[files]


def build_shared(files: tuple[str, ...], build: Callable[[pa.Table], object]) -> object:
    """What ``build`` makes of all rows; the last value is kept for the worker's next task."""
    key = files, build.__name__
    if key not in _BUILT:
        value = build(read_shared(files))
        _READ.clear()
        _BUILT.clear()
        _BUILT[key] = value
    return _BUILT[key]

"""Rows of a small decision table looked up by row key inside a scan, so that texts need not be shuffled to meet them.

A decision table has a key and a few bytes for some rows of a corpus. It is written to the shared folder in
ranges of the key, each sorted and of a bounded number of rows. A scan task meets keys in ascending runs (row
keys follow files and places in them), so it needs few of these ranges, which it reads from the shared folder
when a key of them turns up; it holds two at a time. What is broadcast is one entry for ``RANGE_ROWS`` decisions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from ._common import lean, ship, stored

RANGE_ROWS, HELD = 200_000, 2
_KINDS = {T.LongType: pa.int64(), T.BinaryType: pa.binary()}


def read_range(uri: str) -> tuple[np.ndarray, pa.Array]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        t = pq.read_table(f)
    return t.column(0).to_numpy(), t.column(1).combine_chunks()


class Ranges:
    """The ranges of a written decision table: least and greatest key and file of each."""

    def __init__(self, kind: pa.DataType, index: list):
        self.kind = kind
        self.lows, self.highs = (np.array([r[c] for r in index], np.int64) for c in ("lo", "hi"))
        self.files = [r["file"] for r in index]

    def finder(self) -> Callable[[np.ndarray], pa.Array]:
        """For one task: keys -> values, null where there is none."""
        held: dict[int, tuple[np.ndarray, pa.Array]] = {}

        def find(x: np.ndarray) -> pa.Array:
            if not len(self.files):
                return pa.nulls(len(x), self.kind)
            spot = np.searchsorted(self.lows, x, "right") - 1
            spot[(spot < 0) | (x > self.highs[np.maximum(spot, 0)])] = -1
            pool, size, take = [pa.nulls(1, self.kind)], 1, np.zeros(len(x), np.int64)
            for k in np.unique(spot[spot >= 0]).tolist():
                if k not in held:
                    while len(held) >= HELD:
                        held.pop(next(iter(held)))
                    held[k] = read_range(self.files[k])
                rids, values = held[k]
                rows = np.flatnonzero(spot == k)
                at = np.minimum(np.searchsorted(rids, x[rows]), len(rids) - 1)
                hit = rids[at] == x[rows]
                if hit.any():
                    pool.append(values.take(pa.array(at[hit])))
                    take[rows[hit]] = size + np.arange(hit.sum())
                    size += int(hit.sum())
            return pa.concat_arrays(pool).take(pa.array(take))

        return find


def in_ranges(decisions: DataFrame, range_rows: int = RANGE_ROWS) -> Ranges:
    """Write ``decisions(__rid, value)``: unique keys, and values that are long or binary, and not null."""
    spark = decisions.sparkSession
    ship(spark)
    kind = _KINDS[type(decisions.schema[decisions.columns[1]].dataType)]
    decisions = stored(decisions.toDF("__rid", "value"))
    ranges = -(-decisions.count() // range_rows)
    if not ranges:
        return Ranges(kind, [])
    path = f"{checkpoint_dir(spark)}/sparkloom-{uuid.uuid4().hex}"
    decisions.repartitionByRange(ranges, "__rid").sortWithinPartitions("__rid").write.parquet(path)
    return Ranges(kind, spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("__rid").alias("lo"), F.max("__rid").alias("hi")).orderBy("lo").collect())


def looked_up(decisions: DataFrame, key: Column, range_rows: int = RANGE_ROWS) -> Column:
    """The value of the row of ``decisions(__rid, value)`` whose __rid is ``key``; null where there is none."""
    shared = decisions.sparkSession.sparkContext.broadcast(in_ranges(decisions, range_rows))

    @F.arrow_udf(decisions.schema[decisions.columns[1]].dataType)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        get = shared.value.finder()
        for keys in batches:
            yield get(keys.to_numpy())

    return find(key)

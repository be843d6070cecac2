"""Cut token ranges out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import lean
from ._lookup import in_ranges
from ._tokens import Words, normal_mask


def cut_words(text: str, drop: list[tuple[int, int]]) -> str:
    """Remove word ranges, each with the white space after it; what stays is unchanged."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    n = len(words.starts)
    out, at = [], 0
    for a, b in drop:
        out.append(raw[at : words.starts[a]])
        at = words.starts[b] if b < n else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def without_ranges(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs(__rid, text, ...) without the word ranges packed as int32 pairs in ``drops(__rid, ranges)``; texts of which nothing is left go."""
    shared = docs.sparkSession.sparkContext.broadcast(in_ranges(drops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        look = shared.value.finder()
        for batch in batches:
            packed = look(batch["__rid"].to_numpy())
            rows = np.flatnonzero(np.asarray(packed.is_valid()))
            if len(rows):
                at = batch.schema.get_field_index("text")
                text = batch.column(at)
                new = [cut_words(text[i].as_py(), np.frombuffer(packed[i].as_py(), np.int32).reshape(-1, 2).tolist()) for i in rows.tolist()]
                # texts that stay are taken over by position, so that only the changed ones are built anew
                where, keep = np.arange(batch.num_rows), np.ones(batch.num_rows, bool)
                where[rows] = batch.num_rows + np.arange(len(rows))
                keep[rows] = [bool(t.strip(" \t\n\r\f\v")) for t in new]
                both = pa.concat_arrays([text, pa.array(new, text.type)])
                batch = batch.set_column(at, batch.schema.field(at), both.take(pa.array(where))).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def without_words_of(text: str, drop: list[tuple[int, int]]) -> str:
    """Remove ranges of normalised words (letters and digits) with what follows each range up to the next word."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    words = Words(b, np.array([0, len(raw)]), normal_mask(b))
    n = len(words.starts)
    out, at = [], 0
    for a, e in drop:
        out.append(raw[at : words.starts[a]])
        at = words.starts[e] if e < n else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()

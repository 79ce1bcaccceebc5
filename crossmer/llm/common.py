"""Arrow batches of bounded size, stable numbering and table access."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_key(*columns: str) -> Column:
    """16 bytes that tell rows apart by these columns: equal keys, equal values (null is no text).

    Each value is led by its length, so no two lists of values give the same bytes.
    """
    parts = [F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-"))
             for v in (F.col(c).cast("string") for c in columns)]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `limit` bytes; a longer value is alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64) + 16)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict]], schema: str,
              sized_by: str = "text") -> DataFrame:
    """mapInArrow over bounded slices; `function` returns one dict of columns per slice."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in pieces(batches, sized_by):
            yield pa.RecordBatch.from_pydict(function(batch), schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def long_lists(arrays: list) -> pa.ListArray:
    """An Arrow list column from integer NumPy arrays."""
    import numpy as np

    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), pa.int64()))

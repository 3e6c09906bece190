"""Row functions run over Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of an Arrow batch; keeps buffers small beside long texts, on the JVM's side as well as in Python.
ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, handed to Python workers in batches of at most ROWS (the session's setting, lowered where it is higher)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def map_rows(df: DataFrame, function: Callable[..., Iterator[tuple]], schema: str | StructType) -> DataFrame:
    """Apply `function(*row)`, which yields output tuples, to every row; no shuffle, memory bounded by a batch."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in function(*row)]
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, kind)

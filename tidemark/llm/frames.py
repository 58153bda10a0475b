"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.functions.storage import keep

#: Rows of one Arrow batch handled at a time inside a task, so that memory follows the texts and not the batch size.
SLICE_ROWS = 256
#: Rows of one Arrow batch.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``work`` to slices of at most ``rows`` rows of every Arrow batch; no shuffle.

    Texts are long, so the session's Arrow batches are held at ``BATCH_ROWS`` rows: their buffers stand in the JVM and in
    Python at once.
    """
    with_small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # workers are reused by the next stage

    return df.mapInArrow(run, schema)


def of_texts(column: Column, work: Callable[[list[str | None]], list], kind: str, rows: int = SLICE_ROWS) -> Column:
    """A column that ``work`` computes from slices of a text column; whatever else a row has stays in the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        out = [value for at in range(0, len(texts), rows) for value in work(texts.slice(at, rows).to_pylist())]
        pa.default_memory_pool().release_unused()
        return pa.array(out, {"string": pa.string(), "boolean": pa.bool_()}[kind])

    return arrow_udf(run, kind)(column)


def with_small_batches(session: SparkSession) -> None:
    if not 0 < int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:  # none or less: no limit
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null becomes the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def keep_plan_short(df: DataFrame) -> DataFrame:
    """Cut lineage: ``df`` written once to the shared checkpoint folder that the session names, and read from there."""
    return keep(df)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hex64(value: Column) -> Column:
    """16 lowercase hex digits of a long taken as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))

"""Sums of numpy arrays over distributed rows: what fits of models need of a pass over the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handed over at a time, so that a task's memory does not grow with its rows.
ROWS = 8192


def summed(rows: DataFrame, columns: list[str], work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (rows by columns to ``size`` numbers) over all rows; null values are NaN.

    Tasks add up their own rows and send ``size`` numbers each; these are added by place, so the driver gets ``size`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                total += work(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns]))
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    return _added(rows.select(*columns).mapInArrow(run, "part array<double>"), size)


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` as blocks of at most ``ROWS`` of them, for many passes: a block is one binary value, its doubles row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.slice(at, ROWS).columns])
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    return rows.select(*columns).mapInArrow(run, "block binary")


def summed_blocks(blocks: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """As ``summed``, over ``packed`` rows of ``width`` columns: a pass hands blocks to Python, not a value a column and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for batch in batches:
            for block in batch.column(0):
                total += work(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width))
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    return _added(blocks.mapInArrow(run, "part array<double>"), size)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    by_place = parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in by_place.collect():
        out[r["place"]] = r["value"]
    return out

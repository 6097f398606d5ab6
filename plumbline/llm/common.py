"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as a long) and the text's UTF-8 bytes (null: empty), under fixed names.

    Whatever other columns ``docs`` has, they cannot clash with an operator's own.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which a worker gives the memory that Arrow no longer needs back.

    Workers outlive their tasks, and what they keep counts beside the heap of their executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def binary_array(items: list[bytes | None]) -> pa.Array:
    return pa.array(items, pa.binary())


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as Python tuples, a batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


def hex16(column: Column) -> Column:
    """A long as 16 lowercase hexadecimal digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

"""State of a stream as tables with one version per micro-batch.

A batch reads what the batch before it left and writes its own version, so a repeated
batch starts from the same state and replaces what it wrote. State that must be there and
is not raises; it is never taken for a new beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plumbline.sources.tables import read_table, write_batch

FIRST_BATCH = T.StructType([T.StructField("batch", T.LongType())])


class Versions:
    """Tables below one folder, a folder per batch in each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Write the rows of a batch and go on from the written ones."""
        write_batch(rows, self.table(name), batch_id)
        return self.of_batch(name, rows.schema, batch_id)

    def of_batch(self, name: str, schema: T.StructType, *batch_ids: int) -> DataFrame:
        """The rows of these batches, all of which must be there."""
        if not batch_ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.table(name)}/batch={b}" for b in batch_ids])

    def all(self, name: str, schema: T.StructType) -> DataFrame:
        return read_table(self.spark, self.table(name), schema)

    def before(self, name: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
        """What the batch before this one left; None for the first batch that was ever seen."""
        if batch_id == self._first(batch_id):
            return None
        try:
            return self.of_batch(name, schema, batch_id - 1)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise RuntimeError(
                f"the state before batch {batch_id} is gone ({self.table(name)}); restore it, or start anew in another folder"
            ) from error

    def _first(self, batch_id: int) -> int:
        """The number of the first batch, written down once."""
        path = self.table("first_batch")
        known = read_table(self.spark, path, FIRST_BATCH).first()
        if known is None:
            self.spark.createDataFrame([(batch_id,)], FIRST_BATCH).coalesce(1).write.parquet(path)
            return batch_id
        return known["batch"]

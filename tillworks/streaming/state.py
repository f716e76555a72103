"""Versioned tables: the state of ``foreachBatch`` jobs.

Batch ``n`` reads version ``n - 1`` and writes version ``n``. A batch that runs again
after a failure reads the same version and overwrites its own, so nothing counts
twice. Versions live in the shared folder, never on one executor.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, path: str, schema: StructType | str):
        self.path = path
        self.schema = schema

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """The table after batch ``version``; empty before the first batch."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._at(version))

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._at(version))


class BatchLog:
    """Append-only output, one folder per batch id."""

    def __init__(self, path: str, schema: StructType | str):
        self.path = path
        self.schema = schema

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All batches; empty where no batch has run."""
        return self._found(spark, self.path)

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """What the batches before ``batch`` wrote, so a batch that runs again does not see its own rows.

        A missing batch folder is an error: its rows would be taken for new ones.
        """
        if not batch:
            return spark.createDataFrame([], self.schema)
        return self._rows(spark, *[f"{self.path}/batch={b}" for b in range(batch)])

    def _rows(self, spark: SparkSession, *paths: str) -> DataFrame:
        return spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _found(self, spark: SparkSession, root: str) -> DataFrame:
        """Rows under ``root``; only where the root itself is absent has no batch run."""
        try:
            return self._rows(spark, root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema)


class DayLog(BatchLog):
    """A log of rows with a ``day``, laid down by month, so that a batch reads only its own days of the earlier batches."""

    def __init__(self, path: str, schema: str):
        super().__init__(path, f"{schema}, month date")

    def write(self, df: DataFrame, batch: int) -> None:
        rows = df.withColumn("month", F.trunc("day", "month")).hint("rebalance", "month")
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/batch={batch}")

    def before(self, spark: SparkSession, batch: int, rows: DataFrame | None = None) -> DataFrame:
        """What the batches before ``batch`` wrote, of the days found in ``rows`` where given.

        The days of one batch come to the driver, nothing else. Their months choose the folders, the
        days themselves are pushed into the files.
        """
        found = super().before(spark, batch)
        if rows is not None and batch:
            days = [r.day for r in rows.select("day").distinct().collect()]
            found = found.where(F.col("month").isin(list({d.replace(day=1) for d in days})) & F.col("day").isin(days))
        return found.drop("month")

    def read(self, spark: SparkSession) -> DataFrame:
        return super().read(spark).drop("month")

    def _rows(self, spark: SparkSession, *paths: str) -> DataFrame:
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).drop("batch")

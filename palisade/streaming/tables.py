"""A stored table of keyed rows that batches change bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from palisade.schemas import struct_of
from palisade.session import path_exists, remove_path

BUCKET = "bucket"


class BucketTable:
    """Parquet rows partitioned by a hash bucket of their keys.

    A batch reads only the buckets that its keys fall into and replaces these as partitions, so its cost follows its
    keys and the size of a bucket, not the table; ``buckets`` is chosen for that size. The new buckets are first
    written to a stage of the batch, and only a complete stage replaces partitions. A batch that is run again
    replaces them from the same stage, so a batch broken off at any point neither loses nor doubles a row. Rows
    change or come, they do not go. Readers see a batch bucket by bucket.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = struct_of(schema) if isinstance(schema, str) else schema

    def _write(self, rows: DataFrame, path: str, replaced: str = "dynamic") -> None:
        (rows.select(*self.schema.fieldNames(), BUCKET).repartition(BUCKET).write.mode("overwrite")
         .option("partitionOverwriteMode", replaced).partitionBy(BUCKET).parquet(path))

    def _of(self, path: str) -> DataFrame:
        kept = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(kept).parquet(path)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """Start with ``rows``, one for each key."""
        self._write(self.bucketed(rows), f"{self.root}/rows")

    def read(self) -> DataFrame:
        """All rows; none as long as nothing was written."""
        path = f"{self.root}/rows"
        return self._of(path).drop(BUCKET) if path_exists(self.spark, path) else self.spark.createDataFrame([], self.schema)

    def near(self, fresh: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the keys of ``fresh`` fall into."""
        if not path_exists(self.spark, f"{self.root}/rows"):
            return self.read()
        numbers = [r[0] for r in self.bucketed(fresh.select(*self.keys)).select(BUCKET).distinct().collect()]  # at most ``buckets``
        return self._of(f"{self.root}/rows").filter(F.col(BUCKET).isin(numbers)).drop(BUCKET)

    def change(self, batch: int | str, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of ``fresh`` by ``merge(their rows, fresh)``; ``batch`` names the change, also when it is run again."""
        stage = f"{self.root}/stage/{batch}"
        if not path_exists(self.spark, f"{stage}/_SUCCESS"):
            self._write(self.bucketed(merge(self.near(fresh), fresh)), stage, "static")  # whole or absent
        self._write(self._of(stage), f"{self.root}/rows")

    def forget(self, batch: int | str) -> None:
        """Drop the stage of a batch that will not be run again."""
        remove_path(self.spark, f"{self.root}/stage/{batch}")

    def apply(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``change`` for ``foreachBatch``: batches of different queries are told apart, the stage before the last is dropped."""
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        batch = batch.persist()  # asked for its buckets, then for its rows
        self.change(f"{query}-{batch_id}", batch, merge)
        batch.unpersist()
        self.forget(f"{query}-{batch_id - 1}")

"""Substring search over a stored index of trigrams.

The index is two parquet tables: the rows, numbered and partitioned by a bucket of their number, and the postings
(gram, row number), partitioned by a bucket of the gram and sorted by it. A search reads the buckets of its term's
grams, keeps the rows that its rarest grams share, fetches these from their buckets and lets the plain search decide.

Defined cases: letter case does not matter, ``%`` and ``_`` are plain characters; a term of fewer than three characters has no gram and is
searched in all rows; a term with a gram that no row has finds nothing without reading a row; null texts hold nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from palisade.functions.text import grams, like_pattern

GRAM = 3
#: How many of a term's grams are intersected; the rest is left to the final test.
RAREST = 3
TEXTS = ("cve_id", "title", "description")


def containing(rows: DataFrame, term: str, columns=TEXTS) -> DataFrame:
    """Rows with the term in one of the columns, whatever the case: reads every text."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(like_pattern(term)), F.lit(False))
    return rows.filter(hit)


@dataclass
class TextIndex:
    """A stored index; ``buckets`` is chosen for the size of a bucket."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...] = TEXTS
    buckets: int = 64
    schema: StructType | None = None  # of the indexed rows; needed only to read an index without rows

    def _bucket(self, column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame) -> None:
        """Write the index of ``rows``. A gram's postings are one run of its bucket, cut into row groups by Spark."""
        self.schema = rows.schema
        numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", self._bucket("row"))
        numbered.write.partitionBy("part").parquet(f"{self.path}/rows")
        each = F.array_distinct(F.flatten(F.array(*[grams(F.lower(F.coalesce(c, F.lit(""))), GRAM) for c in self.columns])))
        postings = self.rows().select("row", F.explode(each).alias("gram")).withColumn("slot", self._bucket("gram"))
        (postings.repartition("slot").sortWithinPartitions("slot", "gram", "row")
         .write.partitionBy("slot").parquet(f"{self.path}/postings"))
        sizes = self.postings().groupBy("slot", "gram").agg(F.count("*").alias("n"))
        sizes.repartition("slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{self.path}/sizes")

    def _read(self, name: str, schema: StructType | str | None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        kept = self.schema and StructType([*self.schema.fields, StructField("row", LongType()), StructField("part", IntegerType())])
        return self._read("rows", kept)

    def postings(self) -> DataFrame:
        return self._read("postings", "row long, gram string, slot int")

    def sizes(self) -> DataFrame:
        return self._read("sizes", "gram string, n long, slot int")

    def _of(self, table: DataFrame, wanted: list[str]) -> DataFrame:
        slots = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._bucket("gram")).distinct().collect()]
        return table.filter(F.col("slot").isin(slots) & F.col("gram").isin(wanted))

    def rarest(self, term: str) -> list[str] | None:
        """The rarest grams of a term; none if it is too short, an empty list if no row can have it."""
        found = self.spark.range(1).select(grams(F.lower(F.lit(term)), GRAM)).first()[0]  # of the term alone
        if not found:
            return None
        sizes = self._of(self.sizes(), found).select("gram", "n").collect()  # at most one a gram
        if len(sizes) < len(found):
            return []
        return [r.gram for r in sorted(sizes, key=lambda r: (r.n, r.gram))[:RAREST]]

    def search(self, term: str) -> DataFrame:
        """The indexed rows that contain ``term``."""
        rows, wanted = self.rows(), self.rarest(term)
        if wanted is None:
            return containing(rows, term, self.columns).drop("row", "part")
        if not wanted:
            return rows.filter(F.lit(False)).drop("row", "part")
        shared = self._of(self.postings(), wanted).groupBy(F.col("row").alias("hit")).agg(F.count("*").alias("n"))
        shared = shared.filter(F.col("n") == len(wanted)).select("hit", self._bucket("hit").alias("hit_part"))
        # the buckets of the hits are known when the rows are read: Spark prunes the others then
        near = rows.join(shared, (F.col("part") == F.col("hit_part")) & (F.col("row") == F.col("hit")), "left_semi")
        return containing(near, term, self.columns).drop("row", "part")

"""Structured Streaming forms of the batch jobs.

Every function takes and returns a streaming DataFrame, or starts a query on
one. Sinks written by ``foreachBatch`` name their output after the batch, so a
batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palisade.operators import features, threats as thr
from palisade.operators.features import PAIR
from palisade.schemas import NVD_DOCUMENT, THREATS, struct_of
from palisade.sources.feeds import parse_nvd
from palisade.streaming.tables import BucketTable


def read_events(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A folder or glob of parquet files as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def timed(stream: DataFrame, watermark: str) -> DataFrame:
    """``ts`` as a timestamp with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _prepared(stream: DataFrame, seconds: int, watermark: str) -> DataFrame:
    return features.prepare_events(timed(stream, watermark), seconds, keep=["ts"])


def event_slices(stream: DataFrame, window_seconds: int = 300, slice_seconds: int = 1, watermark: str = "10 minutes",
                 keep: list[str] = ()) -> DataFrame:
    """The slice sums of the batch features, emitted once the watermark has passed their window.

    The state of a slice holds its distinct timestamps, so arrival order does not matter; equal timestamps add
    gaps of zero. Slices close with their window, so that they and ``event_counts`` refuse the same late events.
    """
    rows = _prepared(stream, window_seconds, watermark).withColumn(
        "slice", F.floor(F.col("at") / (slice_seconds * 1000000)))
    slices = rows.groupBy(F.window("ts", f"{window_seconds} seconds"), *PAIR, "window_start", "slice").agg(
        *features.slice_sums(), F.sort_array(F.collect_set("at")).alias("times"))
    exact = "decimal(27,0)"
    gap_sq = F.expr(f"""aggregate(transform(sequence(1, size(times)), i -> if(i = 1, 0L, times[i - 1] - times[i - 2])),
        CAST(0 AS {exact}), (s, g) -> CAST(s + CAST(g AS {features.MICROS}) * CAST(g AS {features.MICROS}) AS {exact}))""")
    return slices.withColumn("gap_sq", gap_sq).drop(*{"window", "times"}.difference(keep))


def event_counts(stream: DataFrame, window_seconds: int = 300, watermark: str = "10 minutes", keep: list[str] = ()) -> DataFrame:
    """Port and payload counts in long form, emitted once the watermark has passed a window."""
    rows = _prepared(stream, window_seconds, watermark)
    counts = features.value_counts(rows, [F.window("ts", f"{window_seconds} seconds").alias("window"), *PAIR, "window_start"],
                                   PAIR + ["window_start", "window"])
    return counts.drop(*{"window"}.difference(keep))


def gap_slices(stream: DataFrame, slice_seconds: int = 1, watermark: str = "10 minutes") -> DataFrame:
    """Gap statistics per pair and time slice, emitted once the watermark has passed the slice.

    The state of a slice is its set of distinct timestamps, so arrival order
    does not matter and a one-second slice never holds more than a million.
    Equal timestamps add gaps of zero, which the row count accounts for.
    """
    rows = timed(stream, watermark).withColumn("at", F.unix_micros("ts"))
    slices = rows.groupBy(F.window("ts", f"{slice_seconds} seconds"), *PAIR).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("at")).alias("times"))
    gap_sq = F.expr("""aggregate(transform(sequence(1, size(times)),
        i -> if(i = 1, 0.0D, (times[i - 1] - times[i - 2]) / 1e6D)), 0.0D, (s, g) -> s + g * g)""")
    return slices.select(
        *PAIR, F.floor(F.unix_seconds("window.start") / slice_seconds).alias("slice"), "n",
        F.element_at("times", 1).alias("first_at"), F.element_at("times", -1).alias("last_at"), gap_sq.alias("gap_sq"))


def interval_deviation(slices: DataFrame, window_seconds: int, slice_seconds: int = 1) -> DataFrame:
    """Slices (read as a table) to the interval deviation of windows."""
    per = window_seconds // slice_seconds
    keys = PAIR + ["window_start"]
    rows = slices.withColumn("window_start", F.floor(F.col("slice") / per) * window_seconds)
    order = Window.partitionBy(*keys).orderBy("slice")
    jump = (F.col("first_at") - F.lag("last_at").over(order)) / 1e6
    sums = rows.withColumn("jump", F.coalesce(jump, F.lit(0.0))).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("gap_sq") + F.col("jump") * F.col("jump")).alias("gap_sq"),
        ((F.max("last_at") - F.min("first_at")) / 1e6).alias("span"))
    steps = F.col("n") - 1
    mean = F.col("span") / steps
    var = F.greatest(F.lit(0.0), F.col("gap_sq") / steps - mean * mean)
    return sums.select(*PAIR, F.timestamp_seconds("window_start").alias("window_start"),
                       F.when(steps > 0, F.sqrt(var)).otherwise(0.0).alias("packet_interval_std"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write everything available now to a parquet table and stop."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest_feed(spark: SparkSession, folder: str, table: BucketTable, checkpoint: str, as_of: Column,
                files_per_batch: int = 1000) -> StreamingQuery:
    """New feed pages in a folder are folded into the threat table; the checkpoint is the bookmark.

    A batch reads and replaces the buckets of its own keys only.
    """
    pages = (spark.readStream.schema(NVD_DOCUMENT).option("multiLine", True)
             .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).json(folder)
             .withColumn("page", F.input_file_name()))

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.apply(thr.last_in_batch(parse_nvd(batch)), batch_id, lambda known, fresh: thr.apply_nvd(known, fresh, as_of))

    return (pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def insert_once(stream: DataFrame, existing: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Associations not seen before: not in the stream within the watermark, not in the table."""
    keys = ["asset_id", "threat_id"]
    return (timed(stream, watermark).dropDuplicatesWithinWatermark(keys)
            .join(existing.select(*keys), keys, "left_anti"))


class LateRows:
    """Rows that the watermark has dropped, by batch.

    A query keeps its last progress reports only, so a long-running caller looks at it now and then; batches seen
    before are counted once, and ``complete`` tells whether a batch was missed between two looks.
    """

    def __init__(self):
        self.by_batch: dict[int, int] = {}
        self.complete = True

    def look(self, query: StreamingQuery) -> int:
        found: dict[int, int] = {}
        for p in query.recentProgress:
            found[p.batchId] = found.get(p.batchId, 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if found and self.by_batch and min(found) > max(self.by_batch) + 1:
            self.complete = False
        for batch, n in found.items():
            self.by_batch[batch] = max(n, self.by_batch.get(batch, 0))
        return sum(self.by_batch.values())


def empty_threats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct_of(THREATS))

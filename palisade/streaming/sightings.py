"""First and last sighting of every address, kept as keyed streaming state that expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade.streaming.tables import BucketTable

KEYS = ["organization_id", "ip_address"]
#: ``current`` counts the sightings that the state of the address holds since the moment ``since`` (in ms), ``past`` those of expired states.
TABLE = "organization_id long, ip_address string, first_at long, last_at long, past long, current long, since long"
CHANGED = "organization_id long, ip_address string, first_at long, last_at long, current long, since long"
#: Keyed state variables need this store; a clock would call for batches without rows for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Sightings(StatefulProcessor):
    """Value state per address: first and last time, number, and the moment the state began.

    With a time to live, an address that is not seen for so long loses its state; a later sighting begins a new one.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first_at long, last_at long, current long, since long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, n, since = self.seen.get() or (None, None, 0, timerValues.getCurrentProcessingTimeInMs())
        for row in rows:
            first = row.at if first is None else min(first, row.at)
            last = row.at if last is None else max(last, row.at)
            n += 1
        self.seen.update((first, last, n, since))
        yield Row(organization_id=key[0], ip_address=key[1], first_at=first, last_at=last, current=n, since=since)

    def close(self) -> None:
        pass


def sightings_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, TABLE, KEYS, buckets)


def _merged(known: DataFrame, changed: DataFrame) -> DataFrame:
    """Known rows with the changed ones folded in: a state that began anew adds to the sightings of the one before."""
    o = known.select(*KEYS, F.struct("first_at", "last_at", "past", "current", "since").alias("o"))
    n = changed.select(*KEYS, F.struct("first_at", "last_at", "current", "since").alias("n"))
    old, new = F.col("o"), F.col("n")
    past = F.coalesce(old["past"], F.lit(0))
    began = old["since"].isNotNull() & new["since"].isNotNull() & (old["since"] != new["since"])
    return o.join(n, KEYS, "full_outer").select(
        *KEYS, F.least(old["first_at"], new["first_at"]).alias("first_at"),
        F.greatest(old["last_at"], new["last_at"]).alias("last_at"),
        F.when(began, past + old["current"]).otherwise(past).alias("past"),
        F.coalesce(new["current"], old["current"]).alias("current"),
        F.coalesce(new["since"], old["since"]).alias("since"))


def changed_sightings(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The addresses of each batch of ``stream`` (organization_id, source_ip, ts) with their state after it.

    Rows without an organisation, address or time are no sightings.
    """
    rows = stream.select(F.col("organization_id").cast("long").alias("organization_id"), F.col("source_ip").alias("ip_address"),
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).dropna()
    return rows.groupBy(*KEYS).transformWithState(Sightings(ttl_ms), CHANGED, "Update", "ProcessingTime")


def track_last_seen(stream: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None, buckets: int = 64,
                    ) -> StreamingQuery:
    """Keep the table of ``last_seen`` below ``path`` current with what is available now.

    Only addresses that a batch has seen leave the state, and only their buckets of the table are replaced. Going on from
    the checkpoint without new rows changes nothing. With ``ttl_ms`` the state of an address is dropped so long after
    its last sighting, by the clock of the batches; its row in the table stays.
    """
    spark = stream.sparkSession
    table = sightings_table(spark, path, buckets)
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():  # a query keeps the settings it starts with
        spark.conf.set(name, value)
    try:
        return (changed_sightings(stream, ttl_ms).writeStream.outputMode("update")
                .foreachBatch(lambda batch, batch_id: table.apply(batch, batch_id, _merged))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def last_seen(spark: SparkSession, path: str) -> DataFrame:
    """First and last sighting and number of sightings of every address."""
    return sightings_table(spark, path).read().select(
        *KEYS, F.timestamp_micros("first_at").alias("first_seen_at"), F.timestamp_micros("last_at").alias("last_seen_at"),
        (F.col("past") + F.col("current")).alias("sightings"))

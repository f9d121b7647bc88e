"""Streaming jobs run to the end of the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.fixtures import VIEWS
from palisade.operators.features import PAIR
from palisade.operators.quantiles import order_statistic
from palisade.operators.allowlist import usable_rules
from palisade.plans.feeds import NVD_SQL, land_pages, nvd_feed, stored_threats
from palisade.plans.learning import detection_columns, detections_sql, event_forest, window_output, window_sql
from palisade.plans.reads import SEVERITY_SQL
from palisade.plans.registry import query
from palisade.session import scratch_dir
from palisade.streaming import jobs, sightings, windows
from palisade.streaming.tables import BucketTable


def table_stream(t, name: str) -> DataFrame:
    """One of the given tables as a stream; the glob makes a single file a source of its own."""
    schema = t.spark.read.parquet(t.path(name)).schema
    return jobs.read_events(t.spark, t.path(name).replace(f"{name}.", f"{name}*."), schema)


def flow_stream(t) -> DataFrame:
    """The flow view over the event stream."""
    columns = VIEWS["flow_events"].split("SELECT", 1)[1].rsplit("FROM", 1)[0]
    name = f"event_stream_{abs(hash(t.sf_dir)) % 10**8}"
    table_stream(t, "events").createOrReplaceTempView(name)
    return t.spark.sql(f"SELECT {columns} FROM {name}")


def finish(t, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    path = scratch_dir(t.spark, label)
    jobs.run_to_table(stream, path, scratch_dir(t.spark, f"{label}-log"), mode).awaitTermination()
    return t.spark.read.parquet(path)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


CLOSED = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)"


def closed_sql(seconds: int) -> str:
    return f"SELECT * FROM ({window_sql(seconds)}) WHERE epoch_us(window_start) + {seconds * 1000000} <= {CLOSED}"


def in_parts(t, rows: DataFrame, label: str, step) -> None:
    """Land ``rows`` in a folder in three parts, the earliest first, and run ``step`` on the folder's stream after each."""
    folder = scratch_dir(t.spark, label)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.lit(2), F.floor(3 * (at - low) / max(1, (high or 0) - (low or 0))))
    for i in range(3):
        rows.filter(part == i).write.mode("append").parquet(folder)
        step(jobs.read_events(t.spark, folder, rows.schema)).awaitTermination()


def emitted(t, **options) -> DataFrame:
    """What the closed windows of the event stream give, over three runs that go on from one another."""
    path, log = scratch_dir(t.spark, "windows"), scratch_dir(t.spark, "windows-log")
    rules = usable_rules(t.network_allowlists, None, "outbound")
    in_parts(t, t.flow_events, "windows-in", lambda stream: windows.emit_windows(stream, path, log, rules, **options))
    return t.spark.read.parquet(path).drop("batch")


@query("st1_stream_window_features", closed_sql(300))
def _(t):
    return window_output(emitted(t))


@query("st1_stream_interval_deviation", f"""
WITH g AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 * 86400 AS ws FROM flow_events),
s AS (SELECT organization_id, source_ip, destination_ip, ws, us - lag(us) OVER (
   PARTITION BY organization_id, source_ip, destination_ip, ws ORDER BY us) AS gap FROM g
   WHERE (us // 1000000 + 1) * 1000000 <= {CLOSED})
SELECT organization_id, source_ip, destination_ip, make_timestamp(ws * 1000000) AS window_start,
  round(coalesce(stddev_pop(gap / 1e6), 0), 3) AS packet_interval_std
FROM s GROUP BY ALL""")
def _(t):
    slices = finish(t, jobs.gap_slices(flow_stream(t)), "gaps")
    rows = jobs.interval_deviation(slices, 86400)
    return ntz(rows, "window_start").withColumn("packet_interval_std", F.round("packet_interval_std", 3))


def flood_sql(size: int, slide: int, late: int, rate: float, syn: str, more: str = "") -> str:
    """The flood rules on all sliding windows that the stream has closed."""
    starts = ", ".join(f"epoch_us(ts) // {slide}000000 * {slide} - {i * slide}" for i in range(size // slide))
    return f"""
WITH f AS (SELECT organization_id, source_ip, destination_ip, ts, protocol, failed, bytes FROM flow_events{more}),
w AS (SELECT *, unnest([{starts}]) AS ws FROM f),
g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY organization_id, source_ip, destination_ip, ws ORDER BY ts))
        / 1e6 AS gap FROM w),
m AS (SELECT organization_id, source_ip, destination_ip, ws, count(*) AS n, avg(CAST(failed AS INT)) AS bad,
        1 - stddev_pop(bytes) / (avg(bytes) + 1) AS rep, count(*) FILTER ({syn}) / (count(*) / {size}.0 + 1) AS syn,
        coalesce(stddev_pop(gap), 0) AS dev
      FROM g WHERE (ws + {size}) * 1000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM f) - {late}000000 GROUP BY ALL),
s AS (SELECT *, CASE WHEN n / {size}.0 > {rate} THEN 4 ELSE 0 END + CASE WHEN rep > 0.7 THEN 3 ELSE 0 END
        + CASE WHEN dev < 0.001 THEN 2 ELSE 0 END + CASE WHEN syn > 0.5 THEN 3 ELSE 0 END
        + CASE WHEN n > 100 AND bad > 0.8 THEN 2 ELSE 0 END AS tenths FROM m)
SELECT organization_id, source_ip, destination_ip, make_timestamp(ws * 1000000) AS window_start,
  least(10, tenths) / 10::DOUBLE AS flood_score, n::DOUBLE / {size} AS packets_per_second, round(dev, 4) AS packet_interval_std
FROM s WHERE tenths > 5"""


def flood_output(t, alerts: DataFrame) -> DataFrame:
    return ntz(finish(t, alerts, "st2"), "window_start").select(
        *PAIR, "window_start", "flood_score", "packets_per_second", F.round("packet_interval_std", 4).alias("packet_interval_std"))


@query("st2_stream_flood_alerts", flood_sql(21600, 10800, 600, 1.5 / 21600, "FALSE"))
def _(t):
    return flood_output(t, windows.flood_alerts(flow_stream(t), 21600, 10800, "10 minutes", 1.5 / 21600, pane_seconds=60))


@query("st2_stream_flood_watch_10s", flood_sql(10, 5, 60, 1000, "protocol = 6"))
def _(t):
    """The ten-second watch, every five seconds; each TCP flow is taken to open with a SYN here."""
    return flood_output(t, windows.flood_alerts(flow_stream(t).withColumn("syn", F.col("protocol") == 6)))


PLANTED = """
  UNION ALL SELECT organization_id, source_ip, destination_ip, make_timestamp(epoch_us(ts) + unnest(range(25000)) * 800),
    protocol, failed, bytes FROM flow_events WHERE event_id % 5000 = 7"""


@query("st2_stream_planted_flood", flood_sql(10, 5, 60, 1000, "FALSE", PLANTED))
def _(t):
    """One event in 5,000 opens twenty seconds of 1,250 equal events a second."""
    columns = [*PAIR, "ts", "protocol", "failed", "bytes"]
    rows = flow_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.explode(F.sequence(F.lit(0), F.lit(24999)))
    planted = rows.filter(F.col("event_id") % 5000 == 7).withColumn("step", step).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") + 800 * F.col("step")))
    return flood_output(t, windows.flood_alerts(rows.select(*columns).unionByName(planted.select(*columns))))


@query("st3_stream_scoring", detections_sql(closed_sql(300), "AND bp > fp"))
def _(t):
    """Event stream to features to detections, window by window as they close."""
    return detection_columns(emitted(t, forest=event_forest(t), assets=t.assets))


@query("st4_stream_feed_ingest", f"""
WITH {NVD_SQL}, graded AS (SELECT *, {SEVERITY_SQL} AS severity FROM nvd)
SELECT k.cve_id, k.cve_id AS title, g.description, g.severity, k.source
FROM known_threats k JOIN graded g ON g.cve_id = k.cve_id""")
def _(t):
    """Pages come in three lots; each run goes on from the checkpoint, the first lot comes twice."""
    folder, log = scratch_dir(t.spark, "st4-in"), scratch_dir(t.spark, "st4-log")
    table = BucketTable(t.spark, scratch_dir(t.spark, "st4"), jobs.THREATS, ["cve_id"], 16)
    table.create(stored_threats(t))
    for run, lot in enumerate((0, 1, 0, 2)):
        land_pages(t, nvd_feed(t).filter(F.col("threat_id") % 3 == lot), "st4-in", f"{folder}/lot{run}")
        jobs.ingest_feed(t.spark, folder, table, log, F.to_timestamp(F.lit("2024-01-31 00:00:00"))).awaitTermination()
    return table.read().select("cve_id", "title", "description", "severity", "source")


@query("st5_stream_insert_once", """
SELECT DISTINCT o_custkey AS asset_id, o_orderkey % 50 AS threat_id FROM orders
WHERE NOT EXISTS (SELECT 1 FROM asset_vulnerabilities v WHERE v.asset_id = o_custkey AND v.threat_id = o_orderkey % 50)""")
def _(t):
    stream = table_stream(t, "orders").select(
        F.col("o_custkey").alias("asset_id"), (F.col("o_orderkey") % 50).alias("threat_id"), F.col("o_orderdate").alias("ts"))
    once = jobs.insert_once(stream, t.asset_vulnerabilities, "4000 days")
    return finish(t, once, "st5").select("asset_id", "threat_id")


@query("st6_stream_last_seen", """
SELECT organization_id, source_ip AS ip_address, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS sightings
FROM flow_events GROUP BY ALL""")
def _(t):
    """The events come in three lots that share their times; each run goes on from the checkpoint."""
    folder, path, log = (scratch_dir(t.spark, f"st6{x}") for x in ("-in", "", "-log"))
    for lot in range(3):
        t.flow_events.filter(F.col("event_id") % 3 == lot).write.mode("append").parquet(folder)
        sightings.track_last_seen(jobs.read_events(t.spark, folder, t.flow_events.schema), path, log, buckets=8).awaitTermination()
    return ntz(sightings.last_seen(t.spark, path), "first_seen_at", "last_seen_at")


@query("st7_stream_late_rows", f"""
WITH e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 300000000 * 300 AS ws FROM flow_events),
mid AS (SELECT list_sort(list(us))[count(*) // 2 + 1] AS us FROM e),
closed AS (SELECT e.*, e.us >= mid.us AS later FROM e, mid WHERE (ws + 300) * 1000000 <= {CLOSED})
SELECT (SELECT count(*) FROM (SELECT DISTINCT organization_id, source_ip, destination_ip, ws FROM closed WHERE later)) AS windows,
  (SELECT count(*) FROM closed WHERE later) AS connections,
  (SELECT count(*) FROM (SELECT DISTINCT organization_id, source_ip, destination_ip, ws, us // 1000000 FROM closed WHERE NOT later))
    AS late_groups""")
def _(t):
    """The later half of the events first, then the earlier half: what the watermark refuses is counted, by slice."""
    folder, out, log = (scratch_dir(t.spark, f"st7-{x}") for x in ("in", "out", "log"))
    middle = order_statistic(t.events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), "at",
                             t.events.count() // 2)
    at, late = F.unix_micros(F.col("ts").cast("timestamp")), jobs.LateRows()
    for part in (at >= middle, at < middle):
        t.flow_events.filter(part).write.mode("append").parquet(folder)
        q = jobs.run_to_table(jobs.event_slices(jobs.read_events(t.spark, folder, t.flow_events.schema)), out, log)
        q.awaitTermination()
        late.look(q)
    slices = t.spark.read.parquet(out)
    return slices.agg(F.count_distinct(*PAIR, "window_start").alias("windows"), F.sum("n").alias("connections")).withColumn(
        "late_groups", F.lit(sum(late.by_batch.values())).cast("bigint"))

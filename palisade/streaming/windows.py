"""Windows of an event stream, each emitted once when the watermark closes it.

Features: the state is the distinct events of the open windows; what the watermark closes leaves it and is summed up by
the batch, in short slices of a busy pair. Flood watch: a chain of two aggregates, the first of panes, whose distinct
timestamps give the gaps between events whatever the order of arrival; the second merges the summaries of a window,
(first, last, number, sum of squared gaps) in time order, as the watermark passes it. No table of earlier windows is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palisade.operators import detectors, features
from palisade.operators.allowlist import destination_ports, port_allowed
from palisade.operators.features import MICROS, NO_PORT, PAIR
from palisade.operators.forest import Forest, apply_forest
from palisade.streaming.jobs import timed

SUMS = ["n", "bytes", "payload", "bytes_sq", "tcp", "udp", "icmp", "failed", "syn", "high"]
EXACT = "decimal(27,0)"


def _squares(numbers: str) -> str:
    """SQL: the exact sum of squares of an array of microseconds."""
    return (f"aggregate({numbers}, CAST(0 AS {EXACT}), (s, g) -> "
            f"CAST(s + CAST(g AS {MICROS}) * CAST(g AS {MICROS}) AS {EXACT}))")


def gap_squares(times: str) -> Column:
    """Sum of squared gaps between sorted timestamps."""
    return F.expr(_squares(f"transform(sequence(1, size({times})), i -> if(i = 1, 0L, {times}[i - 1] - {times}[i - 2]))"))


def jump_squares(edges: str) -> Column:
    """Sum of squared gaps between summaries (first_at, last_at) sorted by time."""
    return F.expr(_squares(f"transform(sequence(1, size({edges})), "
                           f"i -> if(i = 1, 0L, {edges}[i - 1].first_at - {edges}[i - 2].last_at))"))


def interval_deviation(n: Column, first: Column, last: Column, gap_sq: Column) -> Column:
    """Population deviation of the gaps in seconds: whole numbers up to the last step."""
    span = (last - first).cast(MICROS)
    spread = ((n - 1) * gap_sq - span * span).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread)) / (n - 1) / 1e6).otherwise(0.0)


# --- features -------------------------------------------------------------------------------

def closed_events(stream: DataFrame, window_seconds: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """The events of every window once the watermark has passed it, equal ones as one row with their number ``m``.

    All that a window needs is kept in one aggregate of fixed width, so an event costs one row of state at most.
    """
    rows = features.prepare_events(timed(stream, watermark), window_seconds, keep=["ts"])
    values = [c for c in rows.columns if c not in ("ts", "window_start")]
    return rows.groupBy(F.window("ts", f"{window_seconds} seconds"), *values).agg(F.count("*").alias("m")).select(
        F.unix_seconds("window.start").alias("window_start"), *values, "m")


def closed_features(closed: DataFrame, rules: DataFrame | None, window_seconds: int = 300) -> DataFrame:
    """Features of the windows that one batch has closed; windows of the same time close together.

    Slices and value counts meet in one shuffle. A count has no slice and comes before the slices of its window.
    """
    keys = [*PAIR, "window_start"]
    events = closed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m", "copy")
    slices, counts = features.slice_stats(events, 1000000), features.value_counts(events, keys)
    payload, port, refused = F.col("kind") == "p", F.col("kind") == "d", F.lit(False)
    if rules is not None:
        target = ["organization_id", "destination_ip"]
        counts = counts.join(destination_ports(closed.select(*target).distinct(), rules), target, "left")
        refused = port & ~port_allowed(F.when(F.col("value") != NO_PORT, F.col("value")), F.col("ports"))
    counts = counts.select(*keys, "kind", "value", "m", refused.alias("refused"))
    both = slices.unionByName(counts, allowMissingColumns=True)
    jump = (F.col("first_at") - F.lag("last_at").over(Window.partitionBy(*keys).orderBy("slice"))).cast(MICROS)
    total = F.sum(F.when(payload, F.col("m")))
    merged = both.withColumn("jump", jump).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("odd_port").alias("odd_port"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum(F.col("gap_sq") + F.coalesce(F.col("jump") * F.col("jump"), F.lit(0))).alias("gap_sq"),
        F.count_if(port & (F.col("value") != NO_PORT)).alias("dst_ports"), F.count_if(F.col("kind") == "s").alias("src_ports"),
        F.max(F.when(F.col("refused"), 1.0).otherwise(0.0)).alias("not_allowed"),
        (F.log2(total) - F.sum(F.when(payload, F.col("m") * F.log2("m"))) / total).alias("entropy"))
    return features.finish_windows(merged, window_seconds, closed.groupBy(*keys).agg(F.sum("m").alias("n")))


def emit_windows(stream: DataFrame, path: str, checkpoint: str, rules: DataFrame | None = None, window_seconds: int = 300,
                 watermark: str = "10 minutes", forest: Forest | None = None, assets: DataFrame | None = None,
                 version: str = "stream", tie_rule: str = "single") -> StreamingQuery:
    """Append the features of the windows that close, or with a ``forest`` the detections among them, to ``path``.

    Works on what is available now and goes on from the checkpoint when called again. A batch that is run again
    replaces its folder; a batch that closes nothing writes nothing.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # destinations, opposite direction, slices and counts are read from it
        if not batch.isEmpty():
            rows = closed_features(batch, rules, window_seconds)
            if forest:
                fused = detectors.fuse(detectors.apply_rules(apply_forest(rows, forest)), tie_rule)
                rows = detectors.detection_rows(fused, assets, F.lit(version))
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return (closed_events(stream, window_seconds, watermark).writeStream.outputMode("append").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- flood watch ----------------------------------------------------------------------------

def flood_windows(stream: DataFrame, size_seconds: int = 10, slide_seconds: int = 5, watermark: str = "1 minute",
                  pane_seconds: int | None = None) -> DataFrame:
    """The columns that the flood rules read, for every sliding window, once the watermark has passed it.

    Panes of ``pane_seconds`` (by default the longest that fits size and slide) are summarised first; a pane's state
    holds its distinct timestamps, a window's state one summary a pane.
    """
    pane = pane_seconds or math.gcd(size_seconds, slide_seconds)
    if size_seconds % pane or slide_seconds % pane:
        raise ValueError("panes must divide the size and the slide of the windows")
    syn = F.col("syn") if "syn" in stream.columns else F.lit(False)
    rows = timed(stream, watermark).select(
        *PAIR, "ts", F.unix_micros("ts").alias("at"), F.col("bytes").cast("double").alias("bytes"), "failed", syn.alias("syn"))
    panes = rows.groupBy(F.window("ts", f"{pane} seconds"), *PAIR).agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("bytes") * F.col("bytes")).alias("bytes_sq"),
        F.count_if("syn").alias("syn"), F.count_if("failed").alias("failed"), F.sort_array(F.collect_set("at")).alias("times"))
    panes = panes.select(
        "window", *PAIR, "n", "bytes", "bytes_sq", "syn", "failed", F.element_at("times", 1).alias("first_at"),
        F.element_at("times", -1).alias("last_at"), gap_squares("times").alias("gap_sq"))
    window = F.window(F.window_time("window"), f"{size_seconds} seconds", f"{slide_seconds} seconds")
    merged = panes.groupBy(window, *PAIR).agg(
        *[F.sum(c).alias(c) for c in ("n", "bytes", "bytes_sq", "syn", "failed", "gap_sq")],
        F.sort_array(F.collect_list(F.struct("first_at", "last_at"))).alias("edges"))
    n, rate, mean = F.col("n"), F.col("n") / F.lit(float(size_seconds)), F.col("bytes") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("bytes_sq") / n - mean * mean))
    return merged.select(
        *PAIR, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        rate.alias("packets_per_second"), n.cast("double").alias("connection_count"),
        (1 - deviation / (mean + 1)).alias("header_repetition_score"),
        interval_deviation(n, F.col("edges")[0]["first_at"], F.element_at("edges", -1)["last_at"],
                           F.col("gap_sq") + jump_squares("edges")).alias("packet_interval_std"),
        (F.col("syn") / (rate + 1)).alias("syn_flood_score"), (F.col("failed") / n).alias("failed_connection_ratio"))


def flood_alerts(stream: DataFrame, size_seconds: int = 10, slide_seconds: int = 5, watermark: str = "1 minute",
                 rate: float = detectors.FLOOD_RATE, pane_seconds: int | None = None) -> DataFrame:
    """Sliding windows whose traffic breaks the flood rules, as the batch rules would on the same windows."""
    rows = detectors.flood_rules(flood_windows(stream, size_seconds, slide_seconds, watermark, pane_seconds), rate)
    return rows.filter("is_flood").select(*PAIR, "window_start", "window_end", "packets_per_second", "header_repetition_score",
                                          "packet_interval_std", "flood_score")

"""The 27 model features: dataset mapping, event windows, cleaning, profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.net import is_site_local_v4
from palisade.functions.software import SERVER_PORTS
from palisade.operators.allowlist import destination_ports, port_allowed
from palisade.schemas import FEATURES, MEMORY_FEATURES

PAIR = ["organization_id", "source_ip", "destination_ip"]
HIGH_PORT = 1024
NO_PORT = -1
MICROS = "decimal(13,0)"  # microseconds within a window, up to 115 days


def raw(df: DataFrame, *names: str, default: float = 0.0) -> Column:
    """The first of the named dataset columns that exists, as a double."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`").try_cast("double")
    return F.lit(default)


def benign_rows(df: DataFrame, column: str, value: str, mode: str = "exact") -> DataFrame:
    """Rows labelled normal: equal up to case, or (``contains``) holding the word.

    ``contains`` keeps everything when the label column is missing.
    """
    if mode == "contains" and column not in df.columns:
        return df
    label = F.upper(F.col(f"`{column}`"))
    hit = label == value.upper() if mode == "exact" else label.contains(value.upper())
    return df.filter(hit)


def benign_by_words(df: DataFrame, column: str = "label") -> DataFrame:
    if column not in df.columns:
        return df
    return df.filter(F.col(f"`{column}`").rlike("(?i)benign|normal"))


def _indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _mapped(df: DataFrame, mapping: dict[str, Column], keep: list[str]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in keep if c in df.columns]
    return df.select(*kept, *[mapping.get(f, F.lit(0.0)).cast("double").alias(f) for f in FEATURES])


def map_traffic_brief(df: DataFrame, label: str = "Label", normal: str = "BENIGN", keep: list[str] = ()) -> DataFrame:
    """Traffic dataset to features, the short mapping (exact label, forward rate preferred)."""
    df = benign_rows(df, label, normal)
    protocol = raw(df, "Protocol")
    return _mapped(df, {
        "packets_per_second": raw(df, "Fwd Packets/s", "Flow Packets/s"),
        "bytes_per_second": raw(df, "Flow Bytes/s"),
        "avg_packet_size": raw(df, "Packet Length Mean"),
        "flow_duration": raw(df, "Flow Duration"),
        "tcp_ratio": _indicator(protocol == 6),
        "udp_ratio": _indicator(protocol == 17),
        "payload_entropy": raw(df, "Idle Mean"),
    }, list(keep))


def map_traffic_full(df: DataFrame, label: str = "Label", normal: str = "BENIGN", keep: list[str] = ()) -> DataFrame:
    """Traffic dataset to features, the full mapping (label contains, flow rate preferred)."""
    df = benign_rows(df, label, normal, "contains")
    has = set(df.columns).__contains__
    rate = raw(df, "Flow Packets/s", "Fwd Packets/s")
    size = raw(df, "Packet Length Mean", "Average Packet Size")
    volume = raw(df, "Flow Bytes/s")
    m = {
        "packets_per_second": rate, "bytes_per_second": volume, "avg_packet_size": size,
        "avg_payload_size": size, "payload_entropy": volume / 1000000,
        "unique_dst_ports": raw(df, "Destination Port"), "unique_src_ports": raw(df, "Source Port"),
        "connection_count": raw(df, "Total Fwd Packets"), "flow_duration": raw(df, "Flow Duration"),
        "flow_idle_time": raw(df, "Idle Mean"), "packet_interval_std": raw(df, "Flow IAT Std"),
    }
    if has("Protocol"):
        for feature, number in (("tcp_ratio", 6), ("udp_ratio", 17), ("icmp_ratio", 1)):
            m[feature] = _indicator(raw(df, "Protocol") == number)
    if has("Destination Port"):
        m["high_port_ratio"] = _indicator(raw(df, "Destination Port") > HIGH_PORT)
    if has("FIN Flag Count") and has("Total Fwd Packets"):
        m["failed_connection_ratio"] = raw(df, "FIN Flag Count") / (raw(df, "Total Fwd Packets") + 1)
    if has("SYN Flag Count"):
        m["syn_flood_score"] = F.try_divide(raw(df, "SYN Flag Count"), rate + 1)
    if has("Bwd Packets/s") and has("Fwd Packets/s"):
        m["bidirectional_ratio"] = F.try_divide(raw(df, "Bwd Packets/s") + 1, raw(df, "Fwd Packets/s") + 1)
    if has("Packet Length Std") and has("Packet Length Mean"):
        m["header_repetition_score"] = 1 - F.try_divide(
            raw(df, "Packet Length Std"), raw(df, "Packet Length Mean") + 1)
    return _mapped(df, m, list(keep))


def map_memory(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Memory-forensics dataset to features; other columns stay zero."""
    if "Class" in df.columns:
        df = benign_rows(df, "Class", "benign")
    return _mapped(df, {f: raw(df, f.removeprefix("mem_").replace("_", ".", 1)) for f in MEMORY_FEATURES}, list(keep))


def stack(frames: list[DataFrame]) -> DataFrame:
    """Bag union over all columns; absent and null numbers become zero."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).fillna(0)


def finite(value: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def clean(df: DataFrame, dtype: str = "float") -> DataFrame:
    """Null, NaN and infinite features become zero; stored narrow."""
    others = [c for c in df.columns if c not in FEATURES]
    return df.select(*[F.col(f"`{c}`") for c in others],
                     *[finite(F.col(f).cast("double")).cast(dtype).alias(f) for f in FEATURES])


def assemble(df: DataFrame) -> DataFrame:
    """All features in model order as one array column beside the rest."""
    return df.withColumn("features", F.array(*[
        (F.col(f).cast("double") if f in df.columns else F.lit(0.0)) for f in FEATURES]))


# --- features from events -------------------------------------------------------------------

def prepare_events(events: DataFrame, window_seconds: int, keep: list[str] = ()) -> DataFrame:
    """Needed columns only, with defaults for the optional ones, and the window start as seconds."""
    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in events.columns else default

    ts = F.col("ts").cast("timestamp")
    return events.select(
        *PAIR, *keep, F.unix_micros(ts).alias("at"), F.col("bytes").cast("double").alias("bytes"),
        optional("payload_bytes", F.col("bytes")).cast("double").alias("payload"), "protocol", "failed",
        optional("syn", F.lit(False)).alias("syn"), F.col("dst_port").cast("int").alias("dst_port"),
        *([F.col("src_port").cast("int").alias("src_port")] if "src_port" in events.columns else []),
    ).withColumn("window_start", F.floor(F.col("at") / (window_seconds * 1000000)) * window_seconds)


def slice_stats(rows: DataFrame, slice_micros: int) -> DataFrame:
    """Counts, sums and gap squares of each (pair, window, time slice).

    The time order is only needed inside a slice, so a busy pair is spread over
    as many tasks as it has slices.
    """
    keys = PAIR + ["window_start", "slice"]
    sliced = rows.withColumn("slice", F.floor(F.col("at") / slice_micros))
    order = Window.partitionBy(*keys).orderBy("at")
    gap = (F.col("at") - F.lag("at").over(order)).cast(MICROS)
    return sliced.withColumn("gap", gap).groupBy(*keys).agg(
        *slice_sums(), F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("gap_sq"))


def slice_sums() -> list[Column]:
    """What a slice keeps of its events, but for the gaps between them."""
    standard = F.col("dst_port").isin(*SERVER_PORTS)
    return [
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("payload").alias("payload"),
        F.sum(F.col("bytes") * F.col("bytes")).alias("bytes_sq"),
        F.count_if(F.col("protocol") == 6).alias("tcp"), F.count_if(F.col("protocol") == 17).alias("udp"),
        F.count_if(F.col("protocol") == 1).alias("icmp"), F.count_if("failed").alias("failed"),
        F.count_if("syn").alias("syn"), F.count_if(F.col("dst_port") > HIGH_PORT).alias("high"),
        F.max(F.when(standard, 0.0).otherwise(1.0)).alias("odd_port"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at")]


def _window_stats(slices: DataFrame) -> DataFrame:
    """Slices to windows; the gap between two slices is added here."""
    keys = PAIR + ["window_start"]
    order = Window.partitionBy(*keys).orderBy("slice")
    jump = (F.col("first_at") - F.lag("last_at").over(order)).cast(MICROS)
    sums = ["n", "bytes", "payload", "bytes_sq", "tcp", "udp", "icmp", "failed", "syn", "high"]
    return slices.withColumn("jump", jump).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("odd_port").alias("odd_port"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum(F.col("gap_sq") + F.coalesce(F.col("jump") * F.col("jump"), F.lit(0))).alias("gap_sq"))


def value_counts(rows: DataFrame, keys: list, names: list[str] | None = None) -> DataFrame:
    """How often each port and payload value occurs: (keys, kind, value, m). Kinds that no row can have are left out."""
    port = F.coalesce(F.col("dst_port"), F.lit(NO_PORT)).cast("double")
    kinds = [("d", port), ("p", F.col("payload"))]
    if "src_port" in rows.columns:
        kinds.append(("s", F.col("src_port").cast("double")))
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds])).alias("x")).select(*(names or keys), "x.*")
    return long.filter(F.col("value").isNotNull()).groupBy(*(names or keys), "kind", "value").agg(F.count("*").alias("m"))


def _variety(counts: DataFrame, ports: DataFrame | None) -> DataFrame:
    """Distinct ports, payload entropy and refused destinations from long-form counts.

    The allowed ``ports`` meet the counts, not the events: one row per pair, window and port.
    """
    keys = PAIR + ["window_start"]
    refused = F.lit(False)
    if ports is not None:
        counts = counts.join(ports, ["organization_id", "destination_ip"], "left")
        number = F.when(F.col("value") != NO_PORT, F.col("value"))
        refused = (F.col("kind") == "d") & ~port_allowed(number, F.col("ports"))
    payload = F.col("kind") == "p"
    total = F.sum(F.when(payload, F.col("m")))
    return counts.groupBy(*keys).agg(
        F.count_if((F.col("kind") == "d") & (F.col("value") != NO_PORT)).alias("dst_ports"),
        F.count_if(F.col("kind") == "s").alias("src_ports"),
        F.max(_indicator(refused)).alias("not_allowed"),
        (F.log2(total) - F.sum(F.when(payload, F.col("m") * F.log2("m"))) / total).alias("entropy"))


def window_features(events: DataFrame, rules: DataFrame | None = None, window_seconds: int = 300,
                    slice_seconds: float = 1.0) -> DataFrame:
    """Network features per (organisation, source, destination, window).

    ``events``: organization_id, source_ip, destination_ip, ts, bytes, protocol,
    failed, dst_port; optional payload_bytes, src_port, syn. ``rules`` are usable
    allowlist rules; without them nothing counts as refused. Memory features are
    zero.
    """
    rows = prepare_events(events, window_seconds)
    keys, ports = PAIR + ["window_start"], None
    if rules is not None:
        ports = destination_ports(rows.select("organization_id", "destination_ip").distinct(), rules)
    slices = slice_stats(rows, int(slice_seconds * 1000000))
    windows = _window_stats(slices).join(_variety(value_counts(rows, keys), ports), keys)
    return finish_windows(windows, window_seconds, rows.groupBy(*keys).agg(F.count("*").alias("n")))


def finish_windows(windows: DataFrame, window_seconds: int, sizes: DataFrame | None = None) -> DataFrame:
    """Features of windows from their sums and variety, all windows of a time being among the rows.

    ``sizes`` may give the events ``n`` of the windows at less cost than ``windows``, for the opposite directions.
    """
    keys = PAIR + ["window_start"]
    back = (windows if sizes is None else sizes).select(
        "organization_id", F.col("destination_ip").alias("source_ip"), F.col("source_ip").alias("destination_ip"),
        "window_start", F.col("n").alias("back"))
    joined = windows.join(back, keys, "left")
    n, seconds = F.col("n"), F.lit(float(window_seconds))
    rate = n / seconds
    span = (F.col("last_at") - F.col("first_at")) / 1e6
    mean_gap = F.when(n > 1, span / (n - 1)).otherwise(0.0)
    micros = (F.col("last_at") - F.col("first_at")).cast(MICROS)
    # integers up to the last step: no cancellation, and no dependence on the order of summation
    spread = ((n - 1) * F.col("gap_sq") - micros * micros).cast("double")
    gap_std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread)) / (n - 1) / 1e6).otherwise(0.0)
    mean = F.col("bytes") / n
    size_std = F.sqrt(F.greatest(F.lit(0.0), F.col("bytes_sq") / n - mean * mean))
    outbound = is_site_local_v4(F.col("source_ip")) & ~is_site_local_v4(F.col("destination_ip"))
    made = {
        "packets_per_second": rate, "bytes_per_second": F.col("bytes") / seconds, "avg_packet_size": mean,
        "tcp_ratio": F.col("tcp") / n, "udp_ratio": F.col("udp") / n, "icmp_ratio": F.col("icmp") / n,
        "unique_dst_ports": F.col("dst_ports"), "unique_src_ports": F.col("src_ports"),
        "high_port_ratio": F.col("high") / n, "connection_count": n,
        "failed_connection_ratio": F.col("failed") / n, "syn_flood_score": F.col("syn") / (rate + 1),
        "flow_duration": span, "flow_idle_time": mean_gap,
        "bidirectional_ratio": (F.coalesce("back", F.lit(0)) + 1) / (n + 1),
        "payload_entropy": F.greatest(F.lit(0.0), F.coalesce("entropy", F.lit(0.0))),
        "avg_payload_size": F.col("payload") / n, "header_repetition_score": 1 - size_std / (mean + 1),
        "packet_interval_std": gap_std,
        "is_outbound": _indicator(outbound), "is_non_allowlisted": F.col("not_allowed"),
        "uses_non_standard_port": F.col("odd_port"),
    }
    return joined.select(*PAIR, F.timestamp_seconds("window_start").alias("window_start"),
                         *[made.get(f, F.lit(0.0)).cast("double").alias(f) for f in FEATURES])


# --- data quality ---------------------------------------------------------------------------

def profile(df: DataFrame, columns=FEATURES, low_variance: float = 0.001) -> DataFrame:
    """One row per feature from a single pass: presence, nulls, infinities, moments, range, quartiles."""
    parts = []
    for name in columns:
        if name not in df.columns:
            parts.append(F.struct(F.lit(name).alias("feature"), F.lit(False).alias("present"), *[
                F.lit(None).cast(t).alias(c) for c, t in _PROFILE]))
            continue
        x = F.col(name).cast("double")
        infinite = F.abs(x) == float("inf")
        good = F.when(~infinite & ~F.isnan(x), x)
        parts.append(F.struct(
            F.lit(name).alias("feature"), F.lit(True).alias("present"),
            F.count_if(x.isNull() | F.isnan(x)).alias("nulls"), F.count_if(infinite).alias("infinities"),
            F.count_if(F.coalesce(good, F.lit(0.0)) != 0).alias("non_zero"), F.count(good).alias("values"),
            F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"), F.min(good).alias("low"),
            F.percentile_approx(good, [0.25, 0.5, 0.75]).alias("quartiles"), F.max(good).alias("high"),
            F.var_samp(good).alias("variance")))
    one = df.agg(F.array(*parts).alias("p"))
    return one.select(F.inline("p")).withColumn("low_variance", F.col("variance") < low_variance)


_PROFILE = (("nulls", "bigint"), ("infinities", "bigint"), ("non_zero", "bigint"), ("values", "bigint"),
            ("mean", "double"), ("std", "double"), ("low", "double"), ("quartiles", "array<double>"),
            ("high", "double"), ("variance", "double"))


def non_zero_features(df: DataFrame) -> DataFrame:
    """How many features have a positive total."""
    sums = df.agg(*[F.sum(f).alias(f) for f in FEATURES])
    return sums.select(sum((F.when(F.col(f) > 0, 1).otherwise(0) for f in FEATURES), F.lit(0)).alias("non_zero"))


def score_distribution(scores: DataFrame, distance: str = "distance", flag: str = "is_anomaly") -> DataFrame:
    """Distribution of forest distances and the grade of the flagged share."""
    share = F.avg(F.col(flag).cast("double"))
    stats = scores.agg(
        F.count("*").alias("total"), F.count_if(F.col(flag)).alias("anomalies"), share.alias("false_positive_rate"),
        F.avg(distance).alias("mean"), F.stddev_pop(distance).alias("std"),
        F.min(distance).alias("low"), F.max(distance).alias("high"))
    return stats.withColumn("grade", rate_grade(F.col("false_positive_rate")))


def rate_grade(rate: Column) -> Column:
    return (F.when(rate <= 0.10, "excellent").when(rate <= 0.15, "good")
            .when(rate <= 0.25, "acceptable").otherwise("high"))

"""Feature building, rule detectors, the forest and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions.parsing import model_version
from palisade.operators import detectors, features as feat, forest as iso, models as reg
from palisade.operators.allowlist import usable_rules
from palisade.operators.quantiles import order_statistic, quantile
from palisade.plans.feeds import ALLOWED_SQL
from palisade.plans.reads import EVENT_SQL, event_clock
from palisade.plans.registry import query
from palisade.schemas import FEATURES, MEMORY_FEATURES, NETWORK_FEATURES
from palisade.session import scratch_dir
from palisade.sources import datasets, sinks

WIDE = 30 * 86400


# --- event windows --------------------------------------------------------------------------

def event_features(t, window_seconds: int = 300) -> DataFrame:
    """Window features of all flow events, destinations checked against the rules."""
    rules = usable_rules(t.network_allowlists, None, "outbound")
    return feat.window_features(t.flow_events, rules, window_seconds)


def stored_features(t) -> DataFrame:
    """Window features written once, for jobs that pass over them several times."""
    path = scratch_dir(t.spark, "features")
    feat.clean(event_features(t), "double").write.parquet(path)
    return t.spark.read.parquet(path)


RATES = ("packets_per_second", "bytes_per_second")


TIMES = ("flow_idle_time", "packet_interval_std")


def steady(x: str) -> str:
    """Cut to milliseconds off any tie, so both engines cut alike (times are whole or half microseconds)."""
    return f"floor({x} * 1e3 + 0.1234567) / 1e3"


def rounded(df: DataFrame, columns, keep) -> DataFrame:
    return df.select(*keep, *[
        F.expr(steady(c)).alias(c) if c in TIMES else F.round(c, 9 if c in RATES else 6).alias(c) for c in columns])


def window_sql(seconds: int) -> str:
    return f"""
WITH f AS (SELECT f.*, epoch_us(ts) AS us, epoch_us(ts) // {seconds}000000 * {seconds} AS ws, {ALLOWED_SQL} AS allowed
           FROM flow_events f),
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY organization_id, source_ip, destination_ip, ws ORDER BY us)) / 1e6 AS gap
      FROM f),
h AS (SELECT organization_id, source_ip, destination_ip, ws, bytes, count(*) AS m FROM f GROUP BY ALL),
e AS (SELECT organization_id, source_ip, destination_ip, ws, -sum(m / s * log2(m / s)) AS entropy FROM (
        SELECT *, sum(m) OVER (PARTITION BY organization_id, source_ip, destination_ip, ws) AS s FROM h) GROUP BY ALL),
w AS (SELECT organization_id, source_ip, destination_ip, ws, count(*) AS n, sum(bytes) AS b, avg(bytes) AS mean,
        stddev_pop(bytes) AS sd, avg(CAST(protocol = 6 AS INT)) AS tcp, avg(CAST(protocol = 17 AS INT)) AS udp,
        avg(CAST(protocol = 1 AS INT)) AS icmp, count(DISTINCT dst_port) AS ports, avg(CAST(dst_port > 1024 AS INT)) AS hi,
        avg(CAST(failed AS INT)) AS bad, (max(us) - min(us)) / 1e6 AS span, coalesce(avg(gap), 0) AS idle,
        coalesce(stddev_pop(gap), 0) AS gap_sd, max(CAST(NOT allowed AS INT)) AS na,
        max(CAST(dst_port NOT IN (22,23,25,53,80,110,143,443,445,465,587,993,995,1433,1521,3306,3389,5432,5900,6379,
            8080,8443,27017) AS INT)) AS odd
      FROM g GROUP BY ALL)
SELECT w.organization_id, w.source_ip, w.destination_ip, make_timestamp(w.ws * 1000000) AS window_start,
  round(n / {seconds}.0, 9) AS packets_per_second, round(b / {seconds}, 9) AS bytes_per_second,
  round(mean, 6) AS avg_packet_size, round(tcp, 6) AS tcp_ratio, round(udp, 6) AS udp_ratio, round(icmp, 6) AS icmp_ratio,
  CAST(ports AS DOUBLE) AS unique_dst_ports, 0.0::DOUBLE AS unique_src_ports, round(hi, 6) AS high_port_ratio,
  CAST(n AS DOUBLE) AS connection_count, round(bad, 6) AS failed_connection_ratio, 0.0::DOUBLE AS syn_flood_score,
  round(span, 6) AS flow_duration, {steady("idle")} AS flow_idle_time,
  round((coalesce((SELECT x.n FROM w x WHERE x.organization_id = w.organization_id AND x.source_ip = w.destination_ip
      AND x.destination_ip = w.source_ip AND x.ws = w.ws), 0) + 1) / (n + 1), 6) AS bidirectional_ratio,
  round(abs(entropy), 6) AS payload_entropy, round(mean, 6) AS avg_payload_size,
  round(1 - sd / (mean + 1), 6) AS header_repetition_score, {steady("gap_sd")} AS packet_interval_std,
  CAST(w.destination_ip LIKE '203.%' AS INT)::DOUBLE AS is_outbound, CAST(na AS DOUBLE) AS is_non_allowlisted,
  CAST(odd AS DOUBLE) AS uses_non_standard_port
FROM w JOIN e USING (organization_id, source_ip, destination_ip, ws)"""


def window_output(df: DataFrame) -> DataFrame:
    keep = ["organization_id", "source_ip", "destination_ip",
            F.col("window_start").cast("timestamp_ntz").alias("window_start")]
    return rounded(df, NETWORK_FEATURES, keep)


@query("fe2_window_features_300s", window_sql(300))
def _(t):
    return window_output(event_features(t, 300))


@query("fe2_window_features_30d", window_sql(WIDE))
def _(t):
    return window_output(event_features(t, WIDE))


# --- datasets -------------------------------------------------------------------------------

def traffic_rows(t) -> DataFrame:
    """Line items in the column layout of the public traffic datasets."""
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").alias("row_id"), (c("l_quantity") * 100).alias("Flow Packets/s"),
        (c("l_quantity") * 60).alias("Fwd Packets/s"), (c("l_quantity") * 40).alias("Bwd Packets/s"),
        F.when(c("l_linenumber") == 7, "Infinity").otherwise(c("l_extendedprice").cast("string")).alias("Flow Bytes/s"),
        c("l_extendedprice").alias("Packet Length Mean"), (c("l_discount") * 100000).alias("Packet Length Std"),
        F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1)), (c("l_linenumber") % 3 + 1)).alias("Protocol"),
        c("l_partkey").alias("Destination Port"), (c("l_suppkey") + 1024).alias("Source Port"),
        c("l_quantity").alias("Total Fwd Packets"), c("l_linenumber").alias("FIN Flag Count"),
        (c("l_linenumber") * 200).alias("SYN Flag Count"), c("l_orderkey").alias("Flow Duration"),
        (c("l_tax") * 100).alias("Idle Mean"), c("l_discount").alias("Flow IAT Std"),
        F.when(c("l_returnflag") == "R", "BENIGN").when(c("l_returnflag") == "A", "Benign traffic")
        .otherwise("DDoS").alias("Label"))


def traffic_csv(t) -> DataFrame:
    path = scratch_dir(t.spark, "traffic")
    sinks.write_dataset(traffic_rows(t), path, "csv")
    return datasets.read_csv(t.spark, path)


BYTES = "CASE WHEN l_linenumber = 7 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice END"


@query("src6_traffic_brief", f"""
SELECT l_orderkey AS row_id, l_quantity * 60 AS packets_per_second, {BYTES} AS bytes_per_second,
       l_extendedprice AS avg_packet_size, CAST(l_orderkey AS DOUBLE) AS flow_duration,
       CAST(l_linenumber % 3 = 0 AS INT)::DOUBLE AS tcp_ratio, CAST(l_linenumber % 3 = 1 AS INT)::DOUBLE AS udp_ratio,
       round(l_tax * 100, 6) AS payload_entropy, 0.0::DOUBLE AS icmp_ratio
FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    df = feat.map_traffic_brief(traffic_csv(t), keep=["row_id"])
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), "packets_per_second", "bytes_per_second",
                     "avg_packet_size", "flow_duration", "tcp_ratio", "udp_ratio",
                     F.round("payload_entropy", 6).alias("payload_entropy"), "icmp_ratio")


FULL_SQL = f"""SELECT l_orderkey AS row_id, l_quantity * 100 AS packets_per_second, {BYTES} AS bytes_per_second,
   l_extendedprice AS avg_packet_size, CAST(l_linenumber % 3 = 0 AS INT)::DOUBLE AS tcp_ratio,
   CAST(l_linenumber % 3 = 1 AS INT)::DOUBLE AS udp_ratio, CAST(l_linenumber % 3 = 2 AS INT)::DOUBLE AS icmp_ratio,
   CAST(l_partkey AS DOUBLE) AS unique_dst_ports, CAST(l_suppkey + 1024 AS DOUBLE) AS unique_src_ports,
   CAST(l_partkey > 1024 AS INT)::DOUBLE AS high_port_ratio, l_quantity AS connection_count,
   l_linenumber / (l_quantity + 1) AS failed_connection_ratio,
   l_linenumber * 200 / (l_quantity * 100 + 1) AS syn_flood_score, CAST(l_orderkey AS DOUBLE) AS flow_duration,
   l_tax * 100 AS flow_idle_time, (l_quantity * 40 + 1) / (l_quantity * 60 + 1) AS bidirectional_ratio,
   {BYTES} / 1000000 AS payload_entropy, l_extendedprice AS avg_payload_size,
   1 - l_discount * 100000 / (l_extendedprice + 1) AS header_repetition_score, l_discount AS packet_interval_std,
   l_returnflag, l_discount, l_tax
   FROM lineitem"""


@query("src7_traffic_full", f"""
SELECT row_id, packets_per_second, bytes_per_second, avg_packet_size, tcp_ratio, udp_ratio, icmp_ratio,
  unique_dst_ports, unique_src_ports, high_port_ratio, connection_count,
  round(failed_connection_ratio, 6) AS failed_connection_ratio, round(syn_flood_score, 6) AS syn_flood_score,
  flow_duration, round(flow_idle_time, 6) AS flow_idle_time, round(bidirectional_ratio, 6) AS bidirectional_ratio,
  avg_payload_size, round(header_repetition_score, 6) AS header_repetition_score, packet_interval_std,
  round(payload_entropy, 6) AS payload_entropy
FROM ({FULL_SQL}) WHERE l_returnflag IN ('R', 'A')""")
def _(t):
    df = feat.map_traffic_full(traffic_csv(t), keep=["row_id"])
    names = NETWORK_FEATURES[:19]
    rough = ("payload_entropy", "failed_connection_ratio", "syn_flood_score", "flow_idle_time", "bidirectional_ratio",
             "header_repetition_score")
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), *[
        F.round(c, 6).alias(c) if c in rough else F.col(c) for c in names])


def memory_rows(t) -> DataFrame:
    """Orders in the layout of the public memory dataset."""
    c = F.col
    return t.orders.select(
        F.when(c("o_orderstatus") == "F", "Benign").when(c("o_orderstatus") == "P", "benign").otherwise("Malware")
        .alias("Class"), c("o_orderkey").alias("row_id"), (c("o_custkey") % 97).alias("pslist.nproc"),
        c("o_custkey").alias("dlllist.ndlls"), c("o_totalprice").alias("handles.nhandles"),
        (c("o_orderkey") % 5).alias("malfind.ninjections"), (c("o_orderkey") % 3).alias("ldrmodules.not_in_load"))


@query("src8_memory_features", """
SELECT o_orderkey AS row_id, CAST(o_custkey % 97 AS DOUBLE) AS mem_pslist_nproc,
       CAST(o_custkey AS DOUBLE) AS mem_dlllist_ndlls, o_totalprice AS mem_handles_nhandles,
       CAST(o_orderkey % 5 AS DOUBLE) AS mem_malfind_ninjections,
       CAST(o_orderkey % 3 AS DOUBLE) AS mem_ldrmodules_not_in_load, 0.0::DOUBLE AS tcp_ratio
FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def _(t):
    path = scratch_dir(t.spark, "memory")
    sinks.write_dataset(memory_rows(t), path, "csv")
    df = feat.map_memory(datasets.read_csv(t.spark, path), keep=["row_id"])
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), *MEMORY_FEATURES, "tcp_ratio")


@query("src9_selective_benign_read", """
SELECT CAST(l_quantity AS FLOAT) AS packets_per_second, CAST(l_discount AS FLOAT) AS tcp_ratio
FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def _(t):
    path = scratch_dir(t.spark, "labelled")
    label = F.when(F.col("l_returnflag") == "R", "is BENIGN").when(F.col("l_returnflag") == "A", "normal").otherwise("bot")
    rows = t.lineitem.select(F.col("l_quantity").alias("packets_per_second"), F.col("l_discount").alias("tcp_ratio"),
                             F.col("l_tax").alias("other"), label.alias("label"))
    sinks.write_dataset(rows, path, "csv")
    return datasets.read_feature_csv(t.spark, path)


@query("flt11_benign_rows", """
SELECT 'exact' AS mode, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'contains', count(*) FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def _(t):
    parts = [feat.benign_rows(traffic_rows(t), "Label", "Benign", mode).agg(
        F.lit(mode).alias("mode"), F.count("*").alias("n")) for mode in ("exact", "contains")]
    return parts[0].union(parts[1])


@query("src10_snk1_training_files", """
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'P'))
     + (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('R', 'A')) AS n,
  (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus IN ('F', 'P')) AS handles""")
def _(t):
    root = scratch_dir(t.spark, "training")
    sinks.write_dataset(unified_dataset(t), f"{root}/unified")
    # a file that is no parquet must not stop the read
    t.region.select(F.col("r_name").alias("value")).coalesce(1).write.text(f"{root}/notes")
    return datasets.read_training_files(t.spark, root).agg(
        F.count("*").alias("n"), F.round(F.sum("mem_handles_nhandles"), 2).alias("handles"))


def unified_dataset(t) -> DataFrame:
    """Traffic and memory rows stacked, with where each came from."""
    a = feat.map_traffic_full(traffic_rows(t)).withColumn("origin", F.lit("traffic"))
    b = feat.map_memory(memory_rows(t)).withColumn("origin", F.lit("memory"))
    return feat.stack([a, b])


@query("se1_fe3_stack_and_clean", f"""
SELECT 'traffic' AS origin, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 7) AS with_bytes,
       round(sum(l_quantity), 2) AS connections, 0.0::DOUBLE AS handles
FROM lineitem WHERE l_returnflag IN ('R', 'A')
UNION ALL SELECT 'memory', count(*), 0, 0, sum(round(CAST(o_totalprice AS DOUBLE), 2)) FROM orders WHERE o_orderstatus IN ('F', 'P')
""")
def _(t):
    df = feat.clean(unified_dataset(t), "double")
    return df.groupBy("origin").agg(
        F.count("*").alias("n"), F.count_if(F.col("bytes_per_second") != 0).alias("with_bytes"),
        F.round(F.sum("connection_count"), 2).alias("connections"), F.round(F.sum("mem_handles_nhandles"), 2).alias("handles"))


@query("fe1_feature_vector", f"""
SELECT row_id, packets_per_second AS first_value, 27 AS width, unique_dst_ports AS seventh, 0.0::DOUBLE AS last_value
FROM ({FULL_SQL})""")
def _(t):
    df = feat.assemble(feat.map_traffic_full(traffic_rows(t).drop("Label"), keep=["row_id"]))
    return df.select("row_id", F.col("features")[0].alias("first_value"), F.size("features").alias("width"),
                     F.col("features")[6].alias("seventh"), F.col("features")[26].alias("last_value"))


def _profile_sql() -> str:
    one = """SELECT '{c}' AS feature, count(*) FILTER (WHERE x IS NULL) AS nulls,
      count(*) FILTER (WHERE isinf(x)) AS infinities, count(*) FILTER (WHERE NOT isinf(x) AND x <> 0) AS non_zero,
      count(*) FILTER (WHERE NOT isinf(x)) AS n, round(avg(x) FILTER (WHERE NOT isinf(x)), 4) AS mean,
      round(stddev_samp(x) FILTER (WHERE NOT isinf(x)), 4) AS std,
      round(min(x) FILTER (WHERE NOT isinf(x)), 9) AS low, round(max(x) FILTER (WHERE NOT isinf(x)), 9) AS high,
      coalesce(var_samp(x) FILTER (WHERE NOT isinf(x)) < 0.001, FALSE) AS low_variance FROM (SELECT {x} AS x FROM base)"""
    made = set(NETWORK_FEATURES[:19])
    body = " UNION ALL ".join(one.format(c=c, x=c if c in made else "0.0::DOUBLE") for c in FEATURES)
    return f"WITH base AS ({FULL_SQL}) {body}"


@query("ml13_feature_profile", _profile_sql())
def _(t):
    p = feat.profile(feat.map_traffic_full(traffic_rows(t).drop("Label")))
    return p.select("feature", "nulls", "infinities", "non_zero", F.col("values").alias("n"),
                    F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("low", 9).alias("low"),
                    F.round("high", 9).alias("high"), "low_variance")


@query("ml14_non_zero_features", f"""
SELECT 17 + CAST(sum(header_repetition_score) > 0 AS INT) + CAST(sum(high_port_ratio) > 0 AS INT) AS non_zero FROM ({FULL_SQL})""")
def _(t):
    return feat.non_zero_features(feat.clean(feat.map_traffic_full(traffic_rows(t).drop("Label")), "double"))


# --- rules and fusion -----------------------------------------------------------------------

def rule_inputs(t) -> DataFrame:
    """Traffic features with the flags and a stand-in forest verdict taken from the row's discount."""
    rows = feat.map_traffic_full(
        traffic_rows(t).drop("Label").withColumn("Flow Bytes/s", F.col("Packet Length Mean")),
        keep=["row_id", "Flow IAT Std", "Idle Mean"])
    return (rows.withColumn("is_outbound", (F.col("row_id") % 2).cast("double"))
            .withColumn("is_non_allowlisted", F.when(F.col("row_id") % 3 == 0, 1.0).otherwise(0.0))
            .withColumn("uses_non_standard_port", F.when(F.col("row_id") % 5 < 3, 1.0).otherwise(0.0))
            .withColumn("anomaly_score", F.round(F.col("`Flow IAT Std`") * 10, 4))
            .withColumn("is_anomaly", F.col("`Flow IAT Std`") > 0.05)
            .withColumn("organization_id", F.col("row_id") % 25)
            .withColumn("source_ip", F.concat_ws(".", F.lit("10"), (F.col("row_id") % 25).cast("string"), F.lit("0"),
                                                 (F.col("row_id") % 250 + 1).cast("string")))
            .withColumn("destination_ip", F.lit("203.0.113.9"))
            .withColumn("window_start", F.timestamp_seconds("row_id")))


RULES_SQL = f"""base AS (SELECT *, row_id % 25 AS organization_id, round(l_discount * 10, 4) AS anomaly_score,
    l_discount > 0.05 AS is_anomaly, row_id % 2 = 1 AS outb, row_id % 3 = 0 AS nonal, row_id % 5 < 3 AS odd,
    avg_packet_size / 1000000 AS entropy FROM ({FULL_SQL})),
pts AS (SELECT *, least(10, CASE WHEN packets_per_second > 1000 THEN 4 ELSE 0 END
      + CASE WHEN header_repetition_score > 0.7 THEN 3 ELSE 0 END + CASE WHEN packet_interval_std < 0.001 THEN 2 ELSE 0 END
      + CASE WHEN syn_flood_score > 0.5 THEN 3 ELSE 0 END
      + CASE WHEN connection_count > 100 AND failed_connection_ratio > 0.8 THEN 2 ELSE 0 END) AS fp,
    least(10, CASE WHEN outb AND nonal THEN 4 ELSE 0 END + CASE WHEN odd THEN 2 ELSE 0 END
      + CASE WHEN packet_interval_std > 0.01 AND packet_interval_std < 0.1 THEN 2 ELSE 0 END
      + CASE WHEN entropy < 3 THEN 1 ELSE 0 END + CASE WHEN high_port_ratio > 0.8 THEN 1 ELSE 0 END) AS bp FROM base),
fused AS (SELECT *, CASE WHEN fp > 5 AND fp > bp THEN 'dos_loop' WHEN bp > 4 {{tie}} THEN 'backdoor_connection'
    WHEN is_anomaly THEN 'general' ELSE 'normal' END AS anomaly_type FROM pts),
verdict AS (SELECT *, CASE anomaly_type WHEN 'dos_loop' THEN fp / 10 WHEN 'backdoor_connection' THEN bp / 10
    WHEN 'general' THEN anomaly_score ELSE 1 - anomaly_score END AS confidence FROM fused),
graded AS (SELECT *, CASE WHEN c >= 0.9 THEN 'critical' WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium'
    WHEN c >= 0.3 THEN 'low' ELSE 'informational' END AS severity FROM (
  SELECT *, CASE anomaly_type WHEN 'dos_loop' THEN least(1.0::DOUBLE, confidence * 1.2::DOUBLE)
    WHEN 'backdoor_connection' THEN least(1.0::DOUBLE, confidence * 1.3::DOUBLE) ELSE confidence END AS c FROM verdict))"""
BATCH_SQL = RULES_SQL.format(tie="")
SINGLE_SQL = RULES_SQL.format(tie="AND bp > fp")


@query("ml7_flood_rules", f"WITH {BATCH_SQL} SELECT row_id, fp > 5 AS is_flood, fp / 10 AS flood_score FROM pts")
def _(t):
    return detectors.flood_rules(rule_inputs(t)).select("row_id", "is_flood", "flood_score")


@query("ml8_backdoor_rules", f"WITH {BATCH_SQL} SELECT row_id, bp > 4 AS is_backdoor, bp / 10 AS backdoor_score FROM pts")
def _(t):
    return detectors.backdoor_rules(rule_inputs(t)).select("row_id", "is_backdoor", "backdoor_score")


@query("ml9_fusion_batch", f"""
WITH {BATCH_SQL} SELECT row_id, anomaly_type, round(confidence, 6) AS confidence_score, severity FROM graded""")
def _(t):
    return detectors.fuse(detectors.apply_rules(rule_inputs(t))).select(
        "row_id", "anomaly_type", F.round("confidence_score", 6).alias("confidence_score"), "severity")


@query("ml9_fusion_single", f"""
WITH {SINGLE_SQL} SELECT row_id, anomaly_type, round(confidence, 6) AS confidence_score, severity FROM graded""")
def _(t):
    return detectors.fuse(detectors.apply_rules(rule_inputs(t)), "single").select(
        "row_id", "anomaly_type", F.round("confidence_score", 6).alias("confidence_score"), "severity")


@query("ml10_snk6_detection_rows", f"""
WITH {BATCH_SQL}
SELECT g.organization_id, a.asset_id, g.anomaly_type, g.severity, round(g.confidence, 6) AS confidence_score,
  CAST(g.packets_per_second * g.flow_duration AS BIGINT) AS packet_count, make_timestamp(g.row_id * 1000000) AS detected_at,
  CASE g.anomaly_type WHEN 'dos_loop' THEN 'packets_per_second' WHEN 'backdoor_connection' THEN 'destination_ip'
       ELSE 'anomaly_score' END AS first_detail, 9 AS snapshot_size
FROM graded g LEFT JOIN assets a ON a.organization_id = g.organization_id AND a.ip_address =
  '10.' || CAST(g.row_id % 25 AS VARCHAR) || '.0.' || CAST(g.row_id % 250 + 1 AS VARCHAR)
WHERE g.anomaly_type <> 'normal'""")
def _(t):
    fused = detectors.fuse(detectors.apply_rules(rule_inputs(t)))
    path = scratch_dir(t.spark, "detections")
    sinks.append_rows(detectors.detection_rows(fused, t.assets, F.lit("v1")), path)
    rows = t.spark.read.parquet(path)
    return rows.select(
        "organization_id", "asset_id", "anomaly_type", "severity",
        F.round("confidence_score", 6).alias("confidence_score"), "packet_count",
        F.col("detected_at").cast("timestamp_ntz").alias("detected_at"),
        F.json_object_keys("details")[0].alias("first_detail"),
        F.size(F.json_object_keys("feature_vector")).alias("snapshot_size"))


@query("ag8_scoring_statistics", f"""
WITH {BATCH_SQL}
SELECT organization_id, count(*) AS prediction_count, count(*) FILTER (WHERE anomaly_type <> 'normal') AS anomaly_count,
  round(CAST(count(*) FILTER (WHERE anomaly_type <> 'normal') AS DOUBLE) / count(*), 6) AS anomaly_rate
FROM graded GROUP BY organization_id""")
def _(t):
    stats = detectors.scoring_statistics(detectors.fuse(detectors.apply_rules(rule_inputs(t))))
    return stats.withColumn("anomaly_rate", F.round("anomaly_rate", 6))


# --- forest ---------------------------------------------------------------------------------

def numeric_rows(t) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


TRIO = ("l_quantity", "l_extendedprice", "l_discount")


@query("ml1_standard_scaling", """
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 6) AS l_quantity, round((l_discount - c) / d, 6) AS l_discount
FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_discount) AS c,
                       stddev_pop(l_discount) AS d FROM lineitem)""")
def _(t):
    rows = numeric_rows(t)
    stats = iso.fit_scaler(rows, TRIO).first()
    return iso.scale(rows, stats, TRIO).select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("ml2_wn6_positional_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.8 * (SELECT count(*) FROM orders))
                        THEN 'train' ELSE 'validation' END AS part FROM orders""")
def _(t):
    train, val = iso.split_by_position(t.orders, "o_orderkey", 0.2)
    return train.select("o_orderkey", F.lit("train").alias("part")).union(
        val.select("o_orderkey", F.lit("validation").alias("part")))


@query("ml2_hash_split_complete", """
SELECT count(*) AS n, count(DISTINCT event_id) AS keys, TRUE AS near_share FROM events""")
def _(t):
    train, val = iso.split_by_hash(t.events, ["event_id"], 0.2)
    both = train.select("event_id", F.lit(0).alias("v")).union(val.select("event_id", F.lit(1).alias("v")))
    return both.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"),
                    F.avg("v").between(0.15, 0.25).alias("near_share"))


@query("ml4_exact_threshold", """
SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS threshold, quantile_disc(l_quantity, 0.5) AS median_quantity
FROM lineitem""")
def _(t):
    rows = numeric_rows(t)
    cut = quantile(rows, "l_extendedprice", 0.1)
    n = rows.count()
    median = order_statistic(rows, "l_quantity", (n + 1) // 2 - 1)
    return t.spark.range(1).select(F.lit(round(cut, 6)).alias("threshold"), F.lit(median).alias("median_quantity"))


# A small hand-made forest: (model, tree, node, feature, threshold, left, right, depth, size).
HAND_FOREST = [
    ("global", 0, 0, 0, 25.0, 1, 2, 0, 256), ("global", 0, 1, 2, 0.05, 3, 4, 1, 100),
    ("global", 0, 2, -1, 0.0, -1, -1, 1, 156), ("global", 0, 3, -1, 0.0, -1, -1, 2, 40),
    ("global", 0, 4, -1, 0.0, -1, -1, 2, 60),
    ("global", 1, 0, 1, 30000.0, 1, 2, 0, 256), ("global", 1, 1, -1, 0.0, -1, -1, 1, 100),
    ("global", 1, 2, 0, 10.0, 3, 4, 1, 156), ("global", 1, 3, -1, 0.0, -1, -1, 2, 1),
    ("global", 1, 4, -1, 0.0, -1, -1, 2, 155),
    ("global", 2, 0, 2, 0.02, 1, 2, 0, 256), ("global", 2, 1, -1, 0.0, -1, -1, 1, 2),
    ("global", 2, 2, -1, 0.0, -1, -1, 1, 254),
]
HAND_OFFSET = -0.5
NODE_VALUES = ", ".join(f"({n[1]}, {n[2]}, {n[3]}, {n[4]}::DOUBLE, {n[5]}, {n[6]}, {n[7]}, {n[8]})" for n in HAND_FOREST)
LEAF = """CASE WHEN n.size > 2 THEN 2 * (ln(n.size - 1) + 0.5772156649) - 2 * (n.size - 1) / n.size
          WHEN n.size = 2 THEN 1 ELSE 0 END"""


@query("ml5_fixed_forest_scores", f"""
WITH RECURSIVE nodes(tree, node, feature, threshold, l, r, depth, size) AS (VALUES {NODE_VALUES}),
rows AS (SELECT row_number() OVER () AS id, * FROM lineitem),
walk AS (SELECT id, CAST(l_quantity AS FLOAT) AS q, CAST(l_extendedprice AS FLOAT) AS p, CAST(l_discount AS FLOAT) AS d, tree, 0 AS node FROM rows,
           (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.id, w.q, w.p, w.d, w.tree, CASE WHEN (CASE n.feature WHEN 0 THEN w.q WHEN 1 THEN w.p ELSE w.d END) <= n.threshold
    THEN n.l ELSE n.r END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0),
path AS (SELECT w.id, avg(n.depth + {LEAF}) AS h FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
         WHERE n.feature < 0 GROUP BY w.id),
scored AS (SELECT r.*, -pow(2, -h / (2 * (ln(255) + 0.5772156649) - 2 * 255 / 256)) - {HAND_OFFSET} AS distance
           FROM rows r JOIN path USING (id))
SELECT l_orderkey, l_linenumber, distance < 0 AS is_anomaly,
       round(1 - greatest(0, least(1, distance + 0.5)), 6) AS anomaly_score FROM scored""")
def _(t):
    params = iso.ForestParams(trees=3, sample=256, columns=TRIO)
    forest = iso.Forest(params, t.spark.createDataFrame(HAND_FOREST, iso.NODE_SCHEMA), iso.one_offset(t.spark, HAND_OFFSET))
    return iso.apply_forest(numeric_rows(t), forest).select(
        "l_orderkey", "l_linenumber", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


# A small hand-made forest over window features: packets_per_second, payload_entropy, packet_interval_std.
EVENT_COLUMNS = ("packets_per_second", "avg_packet_size", "failed_connection_ratio")
EVENT_FOREST = [
    ("global", 0, 0, 0, 0.005, 1, 2, 0, 256), ("global", 0, 1, 1, 500.0, 3, 4, 1, 200), ("global", 0, 2, -1, 0.0, -1, -1, 1, 56),
    ("global", 0, 3, -1, 0.0, -1, -1, 2, 190), ("global", 0, 4, -1, 0.0, -1, -1, 2, 10),
    ("global", 1, 0, 2, 0.4, 1, 2, 0, 256), ("global", 1, 1, 1, 250.0, 3, 4, 1, 240), ("global", 1, 2, -1, 0.0, -1, -1, 1, 16),
    ("global", 1, 3, -1, 0.0, -1, -1, 2, 120), ("global", 1, 4, -1, 0.0, -1, -1, 2, 120),
]


def event_forest(t) -> iso.Forest:
    params = iso.ForestParams(trees=2, sample=256, columns=EVENT_COLUMNS)
    return iso.Forest(params, t.spark.createDataFrame(EVENT_FOREST, iso.NODE_SCHEMA), iso.one_offset(t.spark, HAND_OFFSET))


def scored_sql(source: str) -> str:
    """Common table expressions from window features (``source``) to forest distances, rules and verdicts."""
    values = ", ".join(f"({n[1]}, {n[2]}, {n[3]}, {n[4]}::DOUBLE, {n[5]}, {n[6]}, {n[7]}, {n[8]})" for n in EVENT_FOREST)
    x = [f"CAST({c} AS FLOAT)" for c in EVENT_COLUMNS]
    return f"""WITH RECURSIVE nodes(tree, node, feature, threshold, l, r, depth, size) AS (VALUES {values}),
f AS (SELECT row_number() OVER () AS id, * FROM ({source})),
walk AS (SELECT id, {x[0]} AS a, {x[1]} AS b, {x[2]} AS c, tree, 0 AS node FROM f, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.id, w.a, w.b, w.c, w.tree, CASE WHEN (CASE n.feature WHEN 0 THEN w.a WHEN 1 THEN w.b ELSE w.c END) <= n.threshold
    THEN n.l ELSE n.r END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0),
path AS (SELECT w.id, avg(n.depth + {LEAF}) AS h FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
         WHERE n.feature < 0 GROUP BY w.id),
distances AS (SELECT f.*, -pow(2, -h / (2 * (ln(255) + 0.5772156649) - 2 * 255 / 256)) - {HAND_OFFSET} AS distance FROM f JOIN path USING (id)),
base AS (SELECT *, distance < 0 AS is_anomaly, 1 - greatest(0, least(1, distance + 0.5)) AS anomaly_score FROM distances),
pts AS (SELECT *, least(10, CASE WHEN packets_per_second > 1000 THEN 4 ELSE 0 END
      + CASE WHEN header_repetition_score > 0.7 THEN 3 ELSE 0 END + CASE WHEN packet_interval_std < 0.001 THEN 2 ELSE 0 END
      + CASE WHEN syn_flood_score > 0.5 THEN 3 ELSE 0 END
      + CASE WHEN connection_count > 100 AND failed_connection_ratio > 0.8 THEN 2 ELSE 0 END) AS fp,
    least(10, CASE WHEN is_outbound <> 0 AND is_non_allowlisted <> 0 THEN 4 ELSE 0 END
      + CASE WHEN uses_non_standard_port <> 0 THEN 2 ELSE 0 END
      + CASE WHEN packet_interval_std > 0.01 AND packet_interval_std < 0.1 THEN 2 ELSE 0 END
      + CASE WHEN payload_entropy < 3 THEN 1 ELSE 0 END + CASE WHEN high_port_ratio > 0.8 THEN 1 ELSE 0 END) AS bp FROM base),
verdict AS (SELECT *, CASE WHEN fp > 5 AND fp > bp THEN 'dos_loop' WHEN bp > 4 {{tie}} THEN 'backdoor_connection'
    WHEN is_anomaly THEN 'general' ELSE 'normal' END AS anomaly_type FROM pts),
rated AS (SELECT *, CASE anomaly_type WHEN 'dos_loop' THEN fp / 10 WHEN 'backdoor_connection' THEN bp / 10
    WHEN 'general' THEN anomaly_score ELSE 1 - anomaly_score END AS confidence FROM verdict),
graded AS (SELECT *, CASE WHEN g >= 0.9 THEN 'critical' WHEN g >= 0.75 THEN 'high' WHEN g >= 0.5 THEN 'medium'
    WHEN g >= 0.3 THEN 'low' ELSE 'informational' END AS severity FROM (
  SELECT *, CASE anomaly_type WHEN 'dos_loop' THEN least(1.0::DOUBLE, confidence * 1.2::DOUBLE)
    WHEN 'backdoor_connection' THEN least(1.0::DOUBLE, confidence * 1.3::DOUBLE) ELSE confidence END AS g FROM rated))"""


def detections_sql(source: str, tie: str) -> str:
    return scored_sql(source).format(tie=tie) + """
SELECT g.organization_id, a.asset_id, g.anomaly_type, g.severity, round(g.confidence, 6) AS confidence_score, g.source_ip,
  g.destination_ip, g.window_start AS detected_at, CAST(floor(g.packets_per_second * g.flow_duration) AS BIGINT) AS packet_count
FROM graded g LEFT JOIN assets a ON a.organization_id = g.organization_id AND a.ip_address = g.source_ip
WHERE g.anomaly_type <> 'normal'"""


def detection_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "organization_id", "asset_id", "anomaly_type", "severity", F.round("confidence_score", 6).alias("confidence_score"),
        "source_ip", "destination_ip", F.col("detected_at").cast("timestamp_ntz").alias("detected_at"), "packet_count")


KEY = ["organization_id", "source_ip", "destination_ip", "window_start"]
SMALL = iso.ForestParams(trees=100, sample=256, min_rows=100)
WINDOWS_SQL = """w AS (SELECT DISTINCT organization_id, source_ip, destination_ip, epoch_us(ts) // 300000000 AS ws
     FROM flow_events)"""


@query("ml3_forest_growth", f"""
WITH {WINDOWS_SQL}
SELECT 100 AS trees, CAST(100 * least(256, count(*)) AS BIGINT) AS sampled, CAST(100 * least(256, count(*)) AS BIGINT)
  AS in_leaves, TRUE AS depth_in_limit FROM w""")
def _(t):
    nodes = iso.grow_forests(stored_features(t), KEY, SMALL)
    leaf = F.col("feature") < 0
    return nodes.agg(
        F.count_if(F.col("node_id") == 0).cast("int").alias("trees"),
        F.sum(F.when(F.col("node_id") == 0, F.col("size"))).alias("sampled"),
        F.sum(F.when(leaf, F.col("size"))).alias("in_leaves"),
        (F.max("depth") <= iso.height_limit(SMALL.sample)).alias("depth_in_limit"))


def trained(t):
    """A model fitted on the training part of the event windows, with both parts scored."""
    rows = stored_features(t)
    train, val = iso.split_by_hash(rows, KEY)
    forest, nodes = iso.fit_forest(train, KEY, SMALL)
    return rows, train, val, forest, nodes


@query("ml4_ml6_training_and_validation", f"""
WITH {WINDOWS_SQL}
SELECT count(*) AS n, TRUE AS train_share_near_contamination, TRUE AS validation_share_plausible FROM w""")
def _(t):
    rows, train, val, forest, _ = trained(t)
    seen = iso.apply_forest(rows, forest)
    part = iso.hash_share(42, *KEY) >= 0.2
    flagged = F.col("is_anomaly").cast("double")
    return seen.agg(
        F.count("*").alias("n"),
        F.avg(F.when(part, flagged)).between(0.05, 0.11).alias("train_share_near_contamination"),
        F.avg(F.when(~part, flagged)).between(0.01, 0.25).alias("validation_share_plausible"))


@query("ml14_score_distribution", scored_sql(window_sql(300)).format(tie="") + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies, round(avg(CAST(is_anomaly AS INT)), 6) AS false_positive_rate,
  round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(min(distance), 6) AS low, round(max(distance), 6) AS high,
  CASE WHEN avg(CAST(is_anomaly AS INT)) <= 0.10 THEN 'excellent' WHEN avg(CAST(is_anomaly AS INT)) <= 0.15 THEN 'good'
       WHEN avg(CAST(is_anomaly AS INT)) <= 0.25 THEN 'acceptable' ELSE 'high' END AS grade
FROM base""")
def _(t):
    rows = feat.score_distribution(iso.apply_forest(window_output(event_features(t)), event_forest(t)))
    return rows.select("total", "anomalies", "grade", *[
        F.round(c, 6).alias(c) for c in ("false_positive_rate", "mean", "std", "low", "high")])


@query("ml15_snk4_model_round_trip", f"WITH {WINDOWS_SQL} SELECT count(*) AS rows, 0::BIGINT AS different FROM w")
def _(t):
    rows, _, _, forest, nodes = trained(t)
    path = scratch_dir(t.spark, "model")
    iso.save_model(forest, nodes, path, {"source": "events"})
    return iso.round_trip_equal(rows, forest, path)


@query("ml5_ml9_event_detections", detections_sql(window_sql(300), ""))
def _(t):
    """Event windows through rules, forest and fusion to detection rows."""
    rows = window_output(event_features(t))
    fused = detectors.fuse(detectors.apply_rules(iso.apply_forest(rows, event_forest(t))))
    return detection_columns(detectors.detection_rows(fused, t.assets, F.lit("v1")))


# --- registry -------------------------------------------------------------------------------

def model_rows(t) -> DataFrame:
    """Models of two thirds of the organisations, one recent, one old; each has an inactive predecessor."""
    k = F.col("organization_id").cast("int")
    age = F.when(k % 3 == 1, 10).otherwise(2)
    base = t.organizations.filter(k % 3 != 0).select(
        "organization_id", F.explode(F.array(F.lit(0), F.lit(30))).alias("extra"),
        F.lit("anomaly_detection").alias("model_name"), age.alias("age"))
    at = event_clock() - F.make_interval(days=F.col("age") + F.col("extra"))
    return base.select(
        "organization_id", "model_name", model_version(at).alias("model_version"), at.alias("training_completed_at"),
        (F.col("extra") == 0).alias("is_active"), at.alias("activated_at"), F.lit(None).cast("timestamp_ntz").alias("deactivated_at"))


MODELS_SQL = f"""ages AS (SELECT organization_id, CASE WHEN organization_id % 3 = 1 THEN 10 ELSE 2 END AS age
   FROM organizations WHERE organization_id % 3 <> 0),
models AS (SELECT organization_id, {EVENT_SQL} - INTERVAL 1 DAY * (age + extra) AS done, extra = 0 AS is_active
   FROM ages, (VALUES (0), (30)) x(extra))"""


@query("wn2_active_models", f"""
WITH {MODELS_SQL}
SELECT organization_id, strftime(done, '%Y%m%d.%H%M%S') AS model_version, done AS activated_at FROM models WHERE is_active""")
def _(t):
    return reg.active_models(model_rows(t)).select("organization_id", "model_version", "activated_at")


@query("ml11_retrain_decisions", f"""
WITH {MODELS_SQL},
s AS (SELECT organization_id, count(*) AS n, CAST(count(*) FILTER (WHERE is_false_positive) AS DOUBLE) / count(*) AS share
  FROM anomaly_detections WHERE detected_at > {EVENT_SQL} - INTERVAL 7 DAYS GROUP BY organization_id),
r AS (SELECT o.organization_id, CASE WHEN m.done IS NULL THEN 'no_existing_model'
   WHEN date_diff('day', m.done, {EVENT_SQL}) >= 7 THEN 'scheduled_interval (' || CAST(date_diff('day', m.done, {EVENT_SQL}) AS VARCHAR) || ' days)'
   WHEN s.n > 100 AND s.share > 0.1 THEN 'high_false_positive_rate (' || printf('%.2f', s.share * 100) || '%)'
   ELSE 'not_needed' END AS reason
 FROM organizations o LEFT JOIN (SELECT * FROM models WHERE is_active) m ON m.organization_id = o.organization_id
 LEFT JOIN s ON s.organization_id = o.organization_id)
SELECT organization_id, reason <> 'not_needed' AS should_retrain, reason FROM r""")
def _(t):
    return reg.retrain_decisions(t.organizations, model_rows(t), t.anomaly_detections, event_clock(), share_limit=0.1)


@query("ml12_retrain_due_organisations", f"""
WITH {MODELS_SQL}, {WINDOWS_SQL},
n AS (SELECT organization_id, count(*) AS n FROM w GROUP BY organization_id)
SELECT CAST(o.organization_id AS VARCHAR) AS model_key, 20 AS trees, CAST(20 * least(128, n.n) AS BIGINT) AS sampled
FROM organizations o JOIN n ON n.organization_id = o.organization_id
WHERE o.license_expires_at > {EVENT_SQL} AND o.features LIKE '%true%' AND n.n >= 30
  AND NOT EXISTS (SELECT 1 FROM models m WHERE m.organization_id = o.organization_id AND m.is_active
                  AND date_diff('day', m.done, {EVENT_SQL}) < 7)""")
def _(t):
    params = iso.ForestParams(trees=20, sample=128, min_rows=30)
    _, nodes = reg.retrain(t.organizations, model_rows(t), t.anomaly_detections, stored_features(t), KEY,
                           event_clock(), params)
    root = F.col("node_id") == 0
    return nodes.groupBy("model_key").agg(
        F.count_if(root).cast("int").alias("trees"), F.sum(F.when(root, F.col("size"))).alias("sampled"))


@query("upd4_ml16_activate_models", f"""
WITH {MODELS_SQL}
SELECT organization_id, strftime(done, '%Y%m%d.%H%M%S') AS model_version,
       is_active AND organization_id % 3 <> 1 AS is_active,
       CASE WHEN is_active AND organization_id % 3 = 1 THEN {EVENT_SQL} END AS deactivated_at FROM models
UNION ALL
SELECT organization_id, 'v2', TRUE, NULL FROM organizations WHERE organization_id % 3 <> 2""")
def _(t):
    k = F.col("organization_id").cast("int")
    metrics = t.organizations.filter(k % 3 != 2).select(
        "organization_id", F.lit("v2").alias("model_version"), F.lit(1000).alias("training_samples"),
        F.lit(0.1).alias("false_positive_rate"), event_clock().alias("training_started_at"),
        event_clock().alias("training_completed_at"), F.sha2(F.lit("x"), 256).alias("checksum_sha256"),
        F.lit("{}").alias("hyperparameters"))
    fresh = reg.registry_rows(metrics, event_clock())
    return reg.activate(model_rows(t), fresh, event_clock()).select(
        "organization_id", "model_version", "is_active", "deactivated_at")

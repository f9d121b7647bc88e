import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import features as feat
from palisade.schemas import FEATURES
from palisade.streaming import jobs

EVENTS = ("organization_id long, source_ip string, destination_ip string, ts timestamp, bytes double, protocol int, "
          "failed boolean, dst_port int, src_port int, syn boolean")


def make_events(n=600, seed=3):
    """A small dense fixture: one pair holds most rows, some share a timestamp."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        pair = ("10.0.0.1", "8.8.8.8") if rng.random() < 0.6 else rng.choice(
            [("8.8.8.8", "10.0.0.1"), ("10.0.0.2", "10.0.0.3"), ("10.0.0.2", "1.1.1.1")])
        at = start + dt.timedelta(milliseconds=rng.randrange(0, 900000, 250))
        rows.append((rng.randrange(2), *pair, at, float(rng.choice([40, 60, 1500])), rng.choice([6, 17, 1]),
                     rng.random() < 0.3, rng.choice([80, 443, 5555, None]), rng.choice([None, 1, 2]), rng.random() < 0.2))
    return rows


def brute(rows, window=300):
    groups = defaultdict(list)
    for r in rows:
        ws = int(r[3].replace(tzinfo=dt.timezone.utc).timestamp()) // window * window
        groups[(r[0], r[1], r[2], ws)].append(r)
    out = {}
    for key, g in groups.items():
        at = sorted(r[3].replace(tzinfo=dt.timezone.utc).timestamp() for r in g)
        gaps = np.diff(at)
        sizes = np.array([r[4] for r in g])
        n = len(g)
        p = np.array(list(Counter(sizes).values())) / n
        back = len(groups.get((key[0], key[2], key[1], key[3]), []))
        out[key] = {
            "packets_per_second": n / window, "avg_packet_size": sizes.mean(), "connection_count": n,
            "unique_dst_ports": len({r[7] for r in g} - {None}), "unique_src_ports": len({r[8] for r in g} - {None}),
            "failed_connection_ratio": np.mean([r[6] for r in g]), "payload_entropy": -(p * np.log2(p)).sum(),
            "high_port_ratio": sum(1 for r in g if r[7] and r[7] > 1024) / n,
            "syn_flood_score": sum(r[9] for r in g) / (n / window + 1),
            "flow_duration": at[-1] - at[0], "flow_idle_time": gaps.mean() if n > 1 else 0.0,
            "packet_interval_std": gaps.std() if n > 1 else 0.0, "bidirectional_ratio": (back + 1) / (n + 1),
            "header_repetition_score": 1 - sizes.std() / (sizes.mean() + 1),
            "is_outbound": float(key[1].startswith("10.") and not key[2].startswith("10.")),
        }
    return out


@pytest.mark.parametrize("slice_seconds", [1.0, 7.0, 300.0])
def test_window_features_match_brute_force(spark, slice_seconds):
    rows = make_events()
    got = feat.window_features(spark.createDataFrame(rows, EVENTS), None, 300, slice_seconds).withColumn(
        "ws", F.unix_seconds("window_start")).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        for name, value in want[(r.organization_id, r.source_ip, r.destination_ip, r.ws)].items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-7), (name, r[name], value)


def test_window_features_flag_refused_destinations(spark):
    rules = spark.createDataFrame([
        (0, "8.8.8.0/24", None, 80, 444, "outbound", True), (0, None, "1.1.1.1", None, None, "both", True)],
        "organization_id long, ip_range string, ip_address string, port_lo int, port_hi int, direction string, is_active boolean")
    rows = make_events()
    got = feat.window_features(spark.createDataFrame(rows, EVENTS), rules, 300).collect()
    for r in got:
        ports = {e[7] for e in rows if (e[0], e[1], e[2]) == (r.organization_id, r.source_ip, r.destination_ip)
                 and int(e[3].replace(tzinfo=dt.timezone.utc).timestamp()) // 300 * 300
                 == int(r.window_start.replace(tzinfo=dt.timezone.utc).timestamp())}

        def fine(port):
            if r.organization_id != 0:
                return False
            if r.destination_ip == "1.1.1.1":
                return True
            return r.destination_ip == "8.8.8.8" and (port is None or 80 <= port < 444)

        assert r.is_non_allowlisted == float(any(not fine(p) for p in ports)), r


def test_streamed_intervals_equal_batch(spark, tmp_path):
    rows = make_events()
    # a far later event lets the watermark pass the others
    late = rows + [(0, "10.9.9.9", "8.8.8.8", dt.datetime(2024, 1, 2), 1.0, 6, False, 80, 1, False)]
    df = spark.createDataFrame(late, EVENTS)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"), df.schema)
    jobs.run_to_table(jobs.gap_slices(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {(r.organization_id, r.source_ip, r.destination_ip, int(r.window_start.replace(tzinfo=dt.timezone.utc).timestamp())):
           r.packet_interval_std for r in jobs.interval_deviation(spark.read.parquet(str(tmp_path / "out")), 300).collect()}
    want = {k: v["packet_interval_std"] for k, v in brute(rows).items()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_mapping_tolerates_missing_columns_and_bad_values(spark):
    df = spark.createDataFrame([("BENIGN", "5", "Infinity", None), ("benign", "x", "7", "6"), ("Attack", "1", "1", "6")],
                               ["Label", "Flow Packets/s", "Flow Bytes/s", "Protocol"])
    rows = feat.clean(feat.map_traffic_brief(df), "double").collect()
    assert [(r.packets_per_second, r.bytes_per_second, r.tcp_ratio) for r in rows] == [(5.0, 0.0, 0.0), (0.0, 7.0, 1.0)]
    assert feat.map_traffic_full(df.drop("Label")).count() == 3
    assert rows[0].asDict().keys() == set(FEATURES)


def test_profile_counts(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0), (float("nan"), 2.0), (3.0, 2.0)], "tcp_ratio double, udp_ratio double")
    p = {r.feature: r for r in feat.profile(df).collect()}
    assert (p["tcp_ratio"].nulls, p["tcp_ratio"].infinities, p["tcp_ratio"].mean) == (1, 1, 2.0)
    assert p["udp_ratio"].low_variance and not p["icmp_ratio"].present

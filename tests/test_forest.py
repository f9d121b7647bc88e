import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import detectors, features as feat, forest as iso
from palisade.operators.quantiles import order_statistic, order_statistics, quantile

COLUMNS = ("a", "b", "c")
PARAMS = iso.ForestParams(trees=20, sample=64, min_rows=50, columns=COLUMNS)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, *map(float, rng.normal(size=3))) for i in range(1500)]
    rows += [(1500 + i, 0, 40.0 + i, -40.0, 40.0) for i in range(3)]
    return spark.createDataFrame(rows, "id long, org int, a double, b double, c double")


def test_tree_invariants():
    x = np.random.default_rng(0).normal(size=(200, 4)).astype(np.float32)
    x[:, 3] = 1.0
    t = iso.grow_tree(x, np.random.default_rng(1), iso.height_limit(200))
    leaf = t["feature"] < 0
    assert t["size"][leaf].sum() == 200 and t["depth"].max() <= 8
    assert not (t["feature"] == 3).any()
    inner = np.flatnonzero(~leaf)
    for i in inner:
        l, r = t["left_id"][i], t["right_id"][i]
        assert t["size"][i] == t["size"][l] + t["size"][r] and min(t["size"][l], t["size"][r]) > 0
        assert t["depth"][l] == t["depth"][r] == t["depth"][i] + 1
    # walking the rows down gives the recorded leaf sizes
    at = np.zeros(200, int)
    for _ in range(8):
        go = t["feature"][at] >= 0
        f = np.maximum(t["feature"][at], 0)
        nxt = np.where(x[np.arange(200), f] <= t["threshold"][at], t["left_id"][at], t["right_id"][at])
        at = np.where(go, nxt, at)
    assert (np.bincount(at, minlength=len(leaf))[leaf] == t["size"][leaf]).all()


def test_constant_data_gives_a_single_leaf():
    t = iso.grow_tree(np.ones((10, 2), np.float32), np.random.default_rng(1), 4)
    assert len(t["feature"]) == 1 and t["size"][0] == 10


def test_average_path():
    assert iso.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert math.isclose(float(iso.average_path(256)), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def nodes_of(df):
    return sorted(map(tuple, df.collect()))


def test_same_seed_same_forest_whatever_the_partitioning(spark, points):
    one = nodes_of(iso.grow_forests(points.repartition(1), ["id"], PARAMS))
    many = nodes_of(iso.grow_forests(points.repartition(13, "b"), ["id"], PARAMS))
    assert one == many
    assert len({n[1] for n in one}) == 20 and all(n[8] == 64 for n in one if n[2] == 0)


def test_planted_outliers_rank_on_top_and_share_holds(spark, points):
    forest, nodes = iso.fit_forest(points, ["id"], PARAMS)
    scored = iso.apply_forest(points, forest)
    top = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(3).collect()]
    assert set(top) == {1500, 1501, 1502}
    assert abs(iso.validation_share(scored).first().false_positive_rate - 0.1) < 0.01
    rows = scored.select("distance", "is_anomaly", "anomaly_score").collect()
    assert all(r.is_anomaly == (r.distance < 0) and 0 <= r.anomaly_score <= 1 for r in rows)


def test_stored_model_scores_alike(spark, points, tmp_path):
    forest, nodes = iso.fit_forest(points, ["id"], PARAMS)
    iso.save_model(forest, nodes, str(tmp_path / "m"), {"n": 1})
    row = iso.round_trip_equal(points, forest, str(tmp_path / "m")).first()
    assert (row.rows, row.different) == (1503, 0)
    assert iso.load_model(spark, str(tmp_path / "m")).offsets.collect() == forest.offsets.collect()


def test_grouped_fit_equals_separate_fits(spark, points):
    together = nodes_of(iso.grow_forests(points, ["id"], PARAMS, "org"))
    assert {n[0] for n in together} == {"0", "1", "2"}
    alone = nodes_of(iso.grow_forests(points.filter("org = 1"), ["id"], PARAMS, "org"))
    assert alone == [n for n in together if n[0] == "1"]


def test_many_models_score_in_one_pass(spark, points, monkeypatch):
    forest, nodes = iso.fit_forest(points, ["id"], PARAMS, "org")
    rows = points.union(spark.createDataFrame([(9999, None, 0.0, 0.0, 0.0), (9998, 7, 0.0, 0.0, 0.0)], points.schema))
    want = sorted(iso.raw_score(rows, forest, "org").select("id", "raw_score").collect())
    monkeypatch.setattr(iso, "SLICE_ROWS", 100)
    assert sorted(iso.raw_score(rows.repartition(7), forest, "org").select("id", "raw_score").collect()) == want
    assert [r[1] for r in want[-2:]] == [None, None] and len(want) == 1505
    one = iso.Forest(PARAMS, nodes.filter("model_key = '1'").withColumn("model_key", F.lit(iso.GLOBAL)))
    alone = {r.id: r.raw_score for r in iso.raw_score(points.filter("org = 1"), one).collect()}
    assert alone == {k: v for k, v in want if k in alone} and len(alone) == 500


def test_small_groups_are_listed(spark, points):
    forest, _ = iso.fit_forest(points.unionByName(spark.createDataFrame([(5000, 9, 0.0, 0.0, 0.0)], points.schema)), ["id"],
                               PARAMS, "org")
    assert [(r.model_key, r.rows, r.reason) for r in forest.rejected.collect()] == [("9", 1, "1 rows, needs 50")]


@pytest.mark.parametrize("group", [None, "org"])
@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_sampling_and_scoring_join_by_equality(spark, points, group, limit):
    import io
    from contextlib import redirect_stdout

    nodes = spark.createDataFrame([("global", 0, 0, -1, 0.0, -1, -1, 0, 9)], iso.NODE_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            iso.sample_into_trees(points, ["id"], PARAMS, group).explain()
            iso.apply_forest(points, iso.Forest(PARAMS, nodes, iso.one_offset(spark, -0.5)), group).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = out.getvalue()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if group is None:
        assert "Join" not in plan.split("== Physical Plan ==")[1]
        assert "Exchange" not in plan.split("== Physical Plan ==")[2]  # rows are scored where they are


def test_too_few_rows(points):
    with pytest.raises(ValueError):
        iso.fit_forest(points, ["id"], iso.ForestParams(trees=5, columns=COLUMNS))


def test_exact_quantiles_with_a_heavy_value(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(20000, 0.25), rng.random(40000) ** 9])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ordered = np.sort(values)
    for rank in (0, 1, 19999, 31000, 45000, 59999):
        assert order_statistic(df, "x", rank) == ordered[rank]
    assert math.isclose(quantile(df, "x", 0.9), float(np.quantile(values, 0.9)), rel_tol=1e-12)
    with pytest.raises(ValueError):
        order_statistic(df, "x", 60000)


def test_order_statistics_with_nan_infinities_and_wide_spread(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.exp(rng.normal(size=30000) * 200), -np.exp(rng.normal(size=20000) * 200), np.zeros(500),
                             [np.inf, np.inf, -np.inf, np.nan, np.nan, np.nan, 5e-324, -5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    ordered = np.sort(values)  # NaN last
    ranks = [0, 1, 17000, 20001, 20300, 33333, 50500, len(values) - 5, len(values) - 4, len(values) - 1]
    got = order_statistics(df, "x", ranks)
    assert all(got[r] == ordered[r] or (math.isnan(got[r]) and math.isnan(ordered[r])) for r in ranks)


BASE = dict(packets_per_second=0.0, header_repetition_score=0.0, packet_interval_std=1.0, syn_flood_score=0.0,
            connection_count=0.0, failed_connection_ratio=0.0, is_outbound=0.0, is_non_allowlisted=0.0,
            uses_non_standard_port=0.0, payload_entropy=5.0, high_port_ratio=0.0)


@pytest.mark.parametrize("change, flood, backdoor", [
    (dict(packet_interval_std=0.0, payload_entropy=0.0), (False, 0.2), (False, 0.1)),
    (dict(syn_flood_score=0.6, packet_interval_std=0.0009), (False, 0.5), (False, 0.0)),
    (dict(header_repetition_score=0.8, syn_flood_score=0.6), (True, 0.6), (False, 0.0)),
    (dict(packets_per_second=1000.0), (False, 0.0), (False, 0.0)),
    (dict(packets_per_second=1000.1, header_repetition_score=0.71, packet_interval_std=0.0, syn_flood_score=0.51,
          connection_count=101.0, failed_connection_ratio=0.81), (True, 1.0), (False, 0.0)),
    (dict(is_outbound=1.0, is_non_allowlisted=1.0), (False, 0.0), (False, 0.4)),
    (dict(is_outbound=1.0, is_non_allowlisted=1.0, high_port_ratio=0.81), (False, 0.0), (True, 0.5)),
    (dict(packet_interval_std=0.01), (False, 0.0), (False, 0.0)),
    (dict(packet_interval_std=0.1), (False, 0.0), (False, 0.0)),
    (dict(packet_interval_std=0.05, uses_non_standard_port=1.0, payload_entropy=2.9), (False, 0.0), (True, 0.5)),
])
def test_rule_boundaries(spark, change, flood, backdoor):
    df = spark.createDataFrame([tuple((BASE | change).values())], list(BASE))
    r = detectors.apply_rules(df).first()
    assert ((r.is_flood, r.flood_score), (r.is_backdoor, r.backdoor_score)) == (flood, backdoor)


def test_tie_rules(spark):
    df = spark.createDataFrame([(True, 0.6, True, 0.6, True, 0.55), (False, 0.5, True, 0.5, False, 0.2)],
                               "is_flood boolean, flood_score double, is_backdoor boolean, backdoor_score double, "
                               "is_anomaly boolean, anomaly_score double")
    assert [r.anomaly_type for r in detectors.fuse(df).collect()] == ["backdoor_connection", "backdoor_connection"]
    single = detectors.fuse(df, "single").collect()
    assert [(r.anomaly_type, r.confidence_score) for r in single] == [("general", 0.55), ("normal", 0.8)]


def test_rate_grades(spark):
    rows = spark.createDataFrame([(0.1,), (0.15,), (0.25,), (0.26,)], "r double").select(feat.rate_grade(F.col("r")).alias("g"))
    assert [r.g for r in rows.collect()] == ["excellent", "good", "acceptable", "high"]


def test_quantiles_of_many_groups_are_exact(spark):
    """Ties, a single row, a heavy group, infinities, wide spread, a null group; every share at once equals numpy's."""
    from palisade.operators.quantiles import group_quantiles

    rng = np.random.default_rng(11)
    groups = {"even": rng.normal(size=999), "heavy": np.where(rng.random(8000) < 0.7, -0.5, rng.normal(size=8000)), "one": [3.25],
              "two": [-1.0, 2.0], "wide": np.exp(rng.normal(size=500) * 50) * rng.choice([-1, 1], 500), "zeros": [0.0, -0.0, 0.0],
              None: rng.integers(-3, 3, 70).astype(float), "inf": [-np.inf, -np.inf, 1.0, np.inf, np.inf]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.1, 0.37, 0.5, 1.0):
        got = {r.g: r.quantile for r in group_quantiles(df, "g", "v", share).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            if g == "inf":
                continue
            assert got[g] == pytest.approx(np.quantile(np.array(values, float), share), rel=1e-12, abs=1e-300), (g, share)
    assert {r.g: r.quantile for r in group_quantiles(df.filter("g = 'inf'"), "g", "v", 0.1).collect()} == {"inf": -np.inf}
    assert group_quantiles(df.limit(0), "g", "v", 0.5).count() == 0


def test_offsets_of_groups_equal_those_of_separate_fits(spark, points):
    forest, nodes = iso.fit_forest(points, ["id"], PARAMS, "org")
    scores = {}
    for r in iso.raw_score(points, forest, "org").collect():
        scores.setdefault(str(r.org), []).append(r.raw_score)
    for r in forest.offsets.collect():
        assert r.offset == pytest.approx(np.quantile(scores[r.model_key], PARAMS.contamination), rel=1e-12)


def test_a_stored_model_is_compared_in_one_pass_over_its_columns(spark, tmp_path):
    """Python is entered once, with the columns of the model only."""
    rows = spark.range(300).select(
        "id", F.col("id").cast("string").alias("other"), F.rand(1).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    forest, nodes = iso.fit_forest(rows, ["id"], iso.ForestParams(trees=5, sample=64, min_rows=10, columns=("a", "b")))
    iso.save_model(forest, nodes, str(tmp_path / "m"))
    compared = iso.round_trip_equal(rows, forest, str(tmp_path / "m"))
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "other" not in plan.split("MapInArrow")[1].split("Range")[0]
    assert compared.first().asDict() == {"rows": 300, "different": 0}


def test_paths_of_values_beside_a_threshold():
    """The walk in single precision goes where a comparison with the exact threshold goes; more rows than a block has."""
    rng = np.random.default_rng(3)
    trees = [iso.grow_tree(rng.normal(size=(200, 3)).astype(np.float32), rng, 8) for _ in range(4)]
    cuts = np.concatenate([t["threshold"][t["feature"] >= 0] for t in trees]).astype(np.float32)
    near = np.concatenate([cuts, np.nextafter(cuts, np.float32(np.inf)), np.nextafter(cuts, np.float32(-np.inf)), [0, 1e30, -1e30]])
    x = rng.choice(near, size=(iso.BLOCK_ROWS + 500, 3)).astype(np.float32)
    at = np.zeros((len(trees), len(x)), int)
    for i, t in enumerate(trees):
        for _ in range(9):
            feature = t["feature"][at[i]]
            right = x[np.arange(len(x)), feature].astype(float) > t["threshold"][at[i]]
            at[i] = np.where(feature < 0, at[i], np.where(right, t["right_id"][at[i]], t["left_id"][at[i]]))
    want = sum(t["depth"][a] + iso.average_path(t["size"][a]) for t, a in zip(trees, at)) / len(trees)
    assert np.allclose(iso.mean_path(x, [iso._arrays(t) for t in trees]), want, rtol=0, atol=1e-12)

"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied by Spark.

Rows are sampled into trees by hashing a stable key, so the sample of a tree
does not depend on partitioning and at most trees x sample rows are shuffled,
however long the table is. Each tree grows in one task from its sample. A split
takes a random feature and a uniform threshold between its extremes, which is
unaffected by scaling a column; trees therefore grow on the raw columns, and
the scaler is kept with the model for reports. Values are single precision in
trees and scores alike.

Many models fit in one job: ``group`` names a column whose values each get
their own forest. A single model, whose size trees x sample bounds, is sent to
all tasks, and rows are scored where they are. The rows of many models are
scored next to the trees of their model: both meet in slices, one pass for any
number of models.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palisade.functions.text import invert_score
from palisade.operators.quantiles import group_quantiles
from palisade.schemas import FEATURES
from palisade.session import scratch_dir

EULER = 0.5772156649
GLOBAL = "global"
HASH_RANGE = 1 << 31
SLICE_ROWS = 50_000  # rows that meet the trees of their model in one task, more for large trees
BLOCK_ROWS = 4096  # rows that walk down a tree together
NODES_PER_ROW = 5  # nodes that a slice may bring for each of its rows
SPREAD = 0x9E3779B97F4A7C15  # spreads tree numbers over the key bits
NODE_SCHEMA = ("model_key string, tree_id int, node_id int, feature int, threshold double, "
               "left_id int, right_id int, depth int, size int")


@dataclass(frozen=True)
class ForestParams:
    trees: int = 200
    sample: int = 10000
    contamination: float = 0.1
    seed: int = 42
    min_rows: int = 10000
    columns: tuple[str, ...] = FEATURES


# --- scaling and splits ---------------------------------------------------------------------

def fit_scaler(train: DataFrame, columns=FEATURES, by: list[str] = ()) -> DataFrame:
    """Row counts, means and population deviations (zero becomes one), one row per group."""
    stats = train.groupBy(*by).agg(
        F.count("*").alias("rows"),
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns])
    return stats.select(*by, "rows", *[f"{c}__mean" for c in columns], *[
        F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std")).alias(f"{c}__std") for c in columns])


def scale(df: DataFrame, scaler, columns=FEATURES) -> DataFrame:
    """Standardise with a collected scaler row."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *[
        ((F.col(c) - F.lit(scaler[f"{c}__mean"])) / F.lit(scaler[f"{c}__std"])).alias(c) for c in columns])


def hash_share(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) from a stable key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(HASH_RANGE)) / HASH_RANGE


def split_by_hash(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, decided per row without a shuffle."""
    u = hash_share(seed, *keys)
    return df.filter(u >= share), df.filter(u < share)


def split_by_position(df: DataFrame, key: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The first rows in the order of a unique numeric key train, the last ``share`` validate."""
    from palisade.operators.quantiles import order_statistic

    total = df.count()
    cut = int(total * (1 - share))
    last = order_statistic(df, key, cut - 1)
    return df.filter(F.col(key) <= last), df.filter(F.col(key) > last)


# --- growing --------------------------------------------------------------------------------

def average_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3)
    out = 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One isolation tree, a whole level at a time: the rows of a node lie side by side."""
    columns = {"feature": [-1], "threshold": [0.0], "left_id": [-1], "right_id": [-1], "depth": [0], "size": [len(x)]}
    table = {k: np.array(v) for k, v in columns.items()}
    rows = np.arange(len(x))
    nodes, starts = np.array([0]), np.array([0])
    for level in range(limit):
        if not len(nodes):
            break
        xs = x[rows]
        low, high = np.minimum.reduceat(xs, starts, axis=0), np.maximum.reduceat(xs, starts, axis=0)
        usable = high > low
        draw = np.where(usable, rng.random(usable.shape), -1.0)
        chosen = draw.argmax(axis=1)
        at = np.arange(len(nodes))
        lo, hi = low[at, chosen], high[at, chosen]
        lo, hi = lo.astype(float), hi.astype(float)
        cut = lo + rng.random(len(nodes)) * (hi - lo)
        cut = np.where(cut < hi, cut, lo)
        splits = usable.any(axis=1)
        counts = np.diff(np.append(starts, len(rows)))
        owner = np.repeat(at, counts)
        right = xs[np.arange(len(rows)), chosen[owner]] > cut[owner]
        keep = splits[owner]
        # children are numbered in node order, left before right
        rank = np.cumsum(splits) - 1
        child = (2 * rank[owner] + right)[keep]
        order = np.argsort(child, kind="stable")
        sizes = np.bincount(child, minlength=2 * int(splits.sum()))
        first = len(table["feature"])
        split_nodes = nodes[splits]
        table["feature"][split_nodes] = chosen[splits]
        table["threshold"][split_nodes] = cut[splits]
        table["left_id"][split_nodes] = first + 2 * rank[splits]
        table["right_id"][split_nodes] = first + 2 * rank[splits] + 1
        n = len(sizes)
        added = {"feature": np.full(n, -1), "threshold": np.zeros(n), "left_id": np.full(n, -1),
                 "right_id": np.full(n, -1), "depth": np.full(n, level + 1), "size": sizes}
        table = {k: np.concatenate([table[k], added[k]]) for k in table}
        # only children with two rows or more stay open
        is_open = sizes > 1
        rows = rows[keep][order][np.repeat(is_open, sizes)]
        nodes = first + np.flatnonzero(is_open)
        starts = np.concatenate([[0], np.cumsum(sizes[is_open])])[:-1].astype(int)
    return table


def height_limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def sample_into_trees(train: DataFrame, key: list[str], params: ForestParams, group: str | None) -> DataFrame:
    """Rows with the tree they belong to.

    A first hash thins the table, a hash per tree decides among the rows left;
    each tree gets slightly more than its sample and is trimmed when it grows.
    """
    name = F.col(group).cast("string") if group else F.lit(GLOBAL)
    rows = train.select(name.alias("model_key"), F.xxhash64(*key).alias("row_key"),
                        *[F.col(c).cast("float").alias(c) for c in params.columns])
    wanted = params.sample + 6 * math.sqrt(params.sample)
    first = hash_share(params.seed, "row_key")
    if group:
        rated = _rates(rows.groupBy("model_key").agg(F.count("*").alias("n")), params, wanted)
        # most rows go before they meet the rate of their group: no group keeps more than the largest share
        most = rated.agg(F.max("q")).first()[0] or 0.0
        thin = rows.filter(first < most).join(rated, "model_key").filter(first < F.col("q"))
        share = F.col("p") / F.col("q")
    else:
        n = rows.count()
        p = 1.0 if n <= params.sample else min(1.0, wanted / n)
        q = 1.0 if n <= params.sample else min(1.0, 4 * params.trees * p)
        thin = rows.filter(first < (q if n >= params.min_rows else 0.0))
        share = F.lit(p / q)
    # the constant list of trees unfolds inside generated code; what fails its hash goes no further
    each = thin.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1))))
    return each.filter(hash_share(params.seed + 1, "row_key", "tree_id") < share).drop("p", "q")


def _rates(counts: DataFrame, params: ForestParams, wanted: float) -> DataFrame:
    """model_key, p, q of the groups that are large enough, stored: one row per group."""
    p = F.least(F.lit(1.0), F.lit(wanted) / F.col("n"))
    q = F.least(F.lit(1.0), 4 * params.trees * p)
    whole = F.col("n") <= params.sample
    return _stored(counts.filter(F.col("n") >= params.min_rows).select(
        "model_key", F.when(whole, 1.0).otherwise(p).alias("p"), F.when(whole, 1.0).otherwise(q).alias("q")), "rates")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grower(params: ForestParams):
    columns, seed, sample = list(params.columns), params.seed, params.sample

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id, model = int(pdf["tree_id"].iloc[0]), str(pdf["model_key"].iloc[0])
        keys = pdf["row_key"].to_numpy()
        # the order, and so the tree, depends on the keys and values only
        order = np.lexsort([pdf[c].to_numpy() for c in columns] + [keys ^ np.int64(tree_id * SPREAD % (1 << 63))])
        x = np.nan_to_num(pdf[columns].to_numpy(dtype=np.float32)[order[:sample]])
        words = [seed, tree_id, *model.encode()]
        nodes = grow_tree(x, np.random.default_rng(words), height_limit(min(sample, len(x))))
        out = pd.DataFrame(nodes)
        out.insert(0, "node_id", np.arange(len(out)))
        out.insert(0, "tree_id", tree_id)
        out.insert(0, "model_key", model)
        return out

    return grow


def grow_forests(train: DataFrame, key: list[str], params: ForestParams, group: str | None = None) -> DataFrame:
    """Node rows of all trees of all models."""
    sampled = sample_into_trees(train, key, params, group)
    # growing is work, not bytes: ask for tasks by cores, which adaptive execution would otherwise fold together
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    tasks = tasks if group else min(params.trees, tasks)
    sampled = sampled.repartition(tasks, "model_key", "tree_id")
    return sampled.groupBy("model_key", "tree_id").applyInPandas(_grower(params), NODE_SCHEMA)


# --- applying -------------------------------------------------------------------------------

@dataclass
class Forest:
    """Tables of the models: node rows, and by model_key the offset, the scaler and why a group has no model."""

    params: ForestParams
    nodes: DataFrame
    offsets: DataFrame | None = None
    scaler: DataFrame | None = None
    rejected: DataFrame | None = None
    shared: Broadcast | None = field(default=None, init=False, repr=False, compare=False)

    def trees(self) -> Broadcast:
        """The trees of the single model for all tasks, sent once: at most 2 x trees x sample nodes."""
        if self.shared is None:
            rows = self.nodes.select("tree_id", "node_id", *NODE_FIELDS).toArrow().sort_by([("tree_id", "ascending"), ("node_id", "ascending")])
            columns = {n: rows.column(n).to_numpy() for n in ("tree_id", *NODE_FIELDS)}
            ends = np.flatnonzero(np.diff(columns["tree_id"], append=np.iinfo(np.int32).max)) + 1
            trees = [_arrays({n: columns[n][a:b] for n in NODE_FIELDS}) for a, b in zip([0, *ends[:-1]], ends)]
            self.shared = self.nodes.sparkSession.sparkContext.broadcast(trees)
        return self.shared


def one_offset(spark: SparkSession, offset: float, model: str = GLOBAL) -> DataFrame:
    return spark.createDataFrame([(model, float(offset))], "model_key string, offset double")


def _arrays(part: dict[str, np.ndarray]) -> dict:
    """Node columns of one tree, ordered by node, for walking rows down."""
    inner = part["feature"] >= 0
    own = np.arange(len(inner))
    # the largest single at most the threshold: singles lie above both or neither
    exact = np.where(inner, part["threshold"], np.inf)
    cut = exact.astype(np.float32)
    return {
        # a leaf sends every row back to itself, so a fixed number of steps needs no masks
        "feature": np.where(inner, part["feature"], 0).astype(np.intp),
        "threshold": np.where(cut > exact, np.nextafter(cut, np.float32(-np.inf)), cut),
        "children": np.stack([np.where(inner, part["left_id"], own), np.where(inner, part["right_id"], own)],
                             1).astype(np.intp).ravel(),
        "path": part["depth"] + average_path(part["size"]), "steps": int(part["depth"].max()), "rows": int(part["size"][0]),
    }


def mean_path(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Average path length of every row, in single precision, over the trees: blocks of rows that stay in the cache."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    total = np.zeros(len(x))
    for start in range(0, len(x), BLOCK_ROWS):
        block = x[start:start + BLOCK_ROWS]
        flat, n = block.ravel(), len(block)
        base = np.arange(n, dtype=np.intp) * x.shape[1]
        at, place, path = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n)
        value, cut, right = np.empty(n, np.float32), np.empty(n, np.float32), np.empty(n, bool)
        for tree in trees:
            at.fill(0)
            for _ in range(tree["steps"]):
                # every index is valid; "clip" lets the results go straight into the buffers
                tree["feature"].take(at, out=place, mode="clip")
                place += base
                flat.take(place, out=value, mode="clip")
                tree["threshold"].take(at, out=cut, mode="clip")
                np.greater(value, cut, out=right)
                at += at
                at += right
                tree["children"].take(at, out=place, mode="clip")
                at, place = place, at
            total[start:start + n] += tree["path"].take(at, out=path, mode="clip")
    return total / len(trees)


def negative_score(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Minus the anomaly score, so that lower is worse."""
    norm = float(average_path(max(t["rows"] for t in trees)))
    return -np.power(2.0, -mean_path(x, trees) / max(norm, 1e-12))


def _scorer(columns: list[str], fields: list[str]):
    def score(key, trees: pa.Table, rows: pa.Table) -> pa.Table:
        out = np.full(rows.num_rows, np.nan)
        if trees.num_rows and rows.num_rows:
            order = np.argsort(trees.column("tree_id").to_numpy(), kind="stable")
            packed = trees.column("nodes").combine_chunks()
            walked = []
            for i in order:
                nodes = packed[int(i)].values
                walked.append(_arrays({n: nodes.field(n).to_numpy(zero_copy_only=False) for n in NODE_FIELDS}))
            x = np.column_stack([rows.column(c).to_numpy() for c in columns])
            out = negative_score(np.nan_to_num(x), walked)
        kept = rows.select(fields)
        return kept.append_column("__score", pa.array(out, pa.float64(), mask=np.isnan(out)))

    return score


NODE_FIELDS = ("feature", "threshold", "left_id", "right_id", "depth", "size")


def raw_score(df: DataFrame, forest: Forest, group: str | None = None, name: str = "raw_score") -> DataFrame:
    """Add the negative score; null where a row's group has no model."""
    return _scored_in_slices(df, forest, group, name).drop("__model_key") if group else _scored_in_place(df, {name: forest})


def _scored_in_place(df: DataFrame, forests: dict[str, Forest], keep: list[str] | None = None) -> DataFrame:
    """Rows with the scores of single models, by the name of the score: nothing is shuffled or counted.

    Python sees the columns of the models and those to ``keep``, by default all.
    """
    kept = df.columns if keep is None else keep
    used = list(dict.fromkeys(c for f in forests.values() for c in f.params.columns))
    models = [(f.trees(), [used.index(c) for c in f.params.columns]) for f in forests.values()]
    names = [f"__score{i}" for i in range(len(models))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(kept):]]))
            scores = []
            for shared, places in models:
                out = np.full(batch.num_rows, np.nan)
                if shared.value and batch.num_rows:
                    out = negative_score(values[:, places], shared.value)
                scores.append(pa.array(out, pa.float64(), mask=np.isnan(out)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *scores], [*batch.schema.names[:len(kept)], *names])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(c).cast("float").alias(f"__x{i}") for i, c in enumerate(used)])
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.mapInArrow(score, schema).withColumnsRenamed(dict(zip(names, forests)))


def _scored_in_slices(df: DataFrame, forest: Forest, group: str, name: str) -> DataFrame:
    """Rows with the score of their group's model and its key.

    A model's rows are dealt evenly into slices, each of which gets the model's trees; a slice is so large that the
    trees do not outweigh its rows.
    """
    columns = [f"__x{i}" for i in range(len(forest.params.columns))]
    model = F.col(group).cast("string")
    rows = df.withColumns({"__model_key": model, "__deal": F.monotonically_increasing_id()} | {
        x: F.col(c).cast("float") for x, c in zip(columns, forest.params.columns)})
    packed = (forest.nodes.groupBy("model_key", "tree_id")
              .agg(F.array_sort(F.collect_list(F.struct("node_id", *NODE_FIELDS))).alias("nodes")))
    weights = forest.nodes.groupBy("model_key").agg(F.count("*").alias("__nodes"))
    each = F.greatest(F.lit(SLICE_ROWS), F.coalesce("__nodes", F.lit(0)) / NODES_PER_ROW)
    sizes = df.groupBy(model.alias("__sized_key")).agg(F.count("*").alias("__rows")).join(
        weights, F.col("__sized_key") == F.col("model_key"), "left").select(
        "__sized_key", F.ceil(F.col("__rows") / each).cast("int").alias("__slices"))
    sizes = _stored(sizes, "score-sizes")
    rows = rows.join(sizes, F.col("__model_key").eqNullSafe(F.col("__sized_key")))
    packed = packed.join(sizes, F.col("model_key") == F.col("__sized_key"))
    rows = rows.withColumn("__slice", F.pmod("__deal", "__slices").cast("int")).select(*df.columns, "__model_key", "__slice", *columns)
    packed = packed.select("model_key", "tree_id", "nodes", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("__slice"))
    fields = [*df.columns, "__model_key"]
    schema = T.StructType([*df.schema.fields, T.StructField("__model_key", T.StringType()), T.StructField("__score", T.DoubleType())])
    scored = (packed.groupBy("model_key", "__slice").cogroup(rows.groupBy("__model_key", "__slice"))
              .applyInArrow(_scorer(columns, fields), schema))
    return scored.withColumnRenamed("__score", name)


def apply_forest(df: DataFrame, forest: Forest, group: str | None = None) -> DataFrame:
    """Add ``distance``, ``is_anomaly`` and ``anomaly_score`` (0..1, higher is worse)."""
    if group:
        offsets = forest.offsets.select(F.col("model_key").alias("__model_key"), F.col("offset").alias("__offset"))
        rows = _scored_in_slices(df, forest, group, "raw_score").join(offsets, "__model_key", "left").drop("__model_key")
    else:
        offset = forest.offsets.filter(F.col("model_key") == GLOBAL).first()
        rows = _scored_in_place(df, {"raw_score": forest}).withColumn("__offset", F.lit(offset and offset["offset"]).cast("double"))
    distance = F.col("raw_score") - F.col("__offset")
    return (rows.withColumn("distance", distance).withColumn("is_anomaly", F.coalesce(F.col("distance") < 0, F.lit(False)))
            .withColumn("anomaly_score", invert_score(F.col("distance"))).drop("raw_score", "__offset"))


# --- fitting --------------------------------------------------------------------------------

def fit_forest(train: DataFrame, key: list[str], params: ForestParams = ForestParams(),
               group: str | None = None) -> tuple[Forest, DataFrame]:
    """Fit, then set each model's offset so that the contamination share of its training rows is anomalous.

    Returns the forest and its node table, which lies in the shared scratch folder. Groups with fewer than
    ``min_rows`` rows get no model and a row in ``rejected``; without a group they are an error.
    """
    name = F.col(group).cast("string") if group else F.lit(GLOBAL)
    stats = _stored(fit_scaler(train.withColumn("model_key", name), params.columns, ["model_key"]), "scaler")
    small = F.col("rows") < params.min_rows
    if not group and not stats.filter(~small).count():
        raise ValueError(f"training needs {params.min_rows} rows")
    nodes = _stored(grow_forests(train, key, params, group), "forest")
    forest = Forest(params, nodes, scaler=stats.filter(~small), rejected=stats.filter(small).select(
        "model_key", "rows", F.format_string(f"%d rows, needs {params.min_rows}", "rows").alias("reason")))
    scored = (_scored_in_slices(train, forest, group, "raw_score") if group else
              _scored_in_place(train, {"raw_score": forest}, keep=[]).withColumn("__model_key", F.lit(GLOBAL)))
    scores = scored.select(F.col("__model_key").alias("model_key"), "raw_score")
    forest.offsets = _stored(group_quantiles(scores, "model_key", "raw_score", params.contamination, "offset"), "offsets")
    return forest, nodes


def validation_share(scored: DataFrame) -> DataFrame:
    """Flagged share of validation rows, all taken to be clean."""
    return scored.agg(F.count("*").alias("validation_rows"),
                      F.avg(F.col("is_anomaly").cast("double")).alias("false_positive_rate"))


# --- storing --------------------------------------------------------------------------------

def save_model(forest: Forest, nodes: DataFrame, path: str, metrics: dict | None = None) -> None:
    """Nodes, offsets and scaler as parquet, the parameters as JSON text beside them."""
    nodes.write.parquet(f"{path}/nodes")
    forest.offsets.write.parquet(f"{path}/offsets")
    forest.scaler.write.parquet(f"{path}/scaler")
    meta = {"params": forest.params.__dict__ | {"columns": list(forest.params.columns)}, "metrics": metrics or {}}
    nodes.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Forest:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    params = ForestParams(**(meta["params"] | {"columns": tuple(meta["params"]["columns"])}))
    return Forest(params, spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"),
                  spark.read.parquet(f"{path}/offsets"), spark.read.parquet(f"{path}/scaler"))


def round_trip_equal(sample: DataFrame, forest: Forest, path: str) -> DataFrame:
    """Whether a stored model scores a sample as the one in memory; one row."""
    again = load_model(sample.sparkSession, path)
    both = _scored_in_place(sample, {"raw_score": forest, "stored_score": again}, keep=[])
    return both.agg(F.count("*").alias("rows"),
                    F.count_if(~F.col("raw_score").eqNullSafe(F.col("stored_score"))).alias("different"))

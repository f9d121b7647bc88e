"""Mix sources to target weights: repetition rates per source, then whole copies plus one Bernoulli copy.

Each source has a size (words of its documents) and a weight. The sources share the size of the whole corpus by
weight; a target stops at ``cap`` times the source's size and the rest goes to the others by weight. A document
is then emitted ``floor(rate)`` times, and once more when a draw seeded by its id falls below the fraction.

Defined cases: a null text has size 0 and keeps its source's rate; null sources form one source, after all
others; rows that repeat a doc_id take the same draw; a row without id draws by its text; an empty table gives
no rows; other columns pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN_WORD, fresh, stored, unit_draw

SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long"), F.lit(0).cast("long"))


def draw_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5("text"), F.lit(""))))


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target of each source of ``sized`` (source, size).

    Sources in code-point order take the weights of ``cycle`` in turn. Filled like vessels of width *weight* and
    height *cap x size / weight*: in order of height, a vessel is full when it lies under the level that the
    remaining sum over the remaining width gives. One row per source reaches the ordered window, so its size is
    the number of sources, whatever the number of documents.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = per_source.select("source", "source_size", rank.alias("rank"),
                               F.element_at(weights, (rank - 1) % len(cycle) + 1).alias("weight"))
    room = F.lit(float(cap)) * F.col("source_size")
    ranked = ranked.withColumns({"room": room, "height": room / F.col("weight")})
    by_height = Window.orderBy("height", "rank")
    upto, onward = by_height.rowsBetween(Window.unboundedPreceding, -1), by_height.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("height", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("room").over(upto), F.lit(0.0))
    filled = ranked.withColumn("level", left / F.sum("weight").over(onward))
    open_level = F.first(F.when(F.col("height") > F.col("level"), F.col("level")), ignorenulls=True).over(every)
    return filled.select(
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("height") <= F.col("level"), F.col("room"))
        .otherwise(F.col("weight") * open_level).alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0,
                ) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for each row of ``docs`` (doc_id, text, source).

    Sizes and draws are stored, so texts are read once and only one small row per document goes on.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                               unit_draw(draw_key(), seed).alias("draw")), "mix-sizes")
    goals = source_targets(sized, cycle, cap).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (sized.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
            .withColumn("rate", rate)
            .withColumn("copies", (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")))
            .select("doc_id", "size", "source", "source_size", "target", "copies"))


def mix(docs: DataFrame, seed: str = SEED, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay as they are."""
    sized = stored(docs.select("source", n_words(F.col("text")).alias("size")), "mix-sizes")
    goals = source_targets(sized, cycle, cap)
    name, share = fresh(docs, "goal_source"), fresh(docs, "mix_rate")
    rates = stored(goals.select(F.col("source").alias(name), F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(share)), "mix-rates")
    rate = F.col(share)
    copies = (F.floor(rate) + (unit_draw(draw_key(), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    return (docs.join(rates, docs["source"].eqNullSafe(F.col(name)))
            .withColumn(share, F.explode(F.array_repeat(F.lit(0), copies)))
            .select(*[docs[c] for c in docs.columns]))

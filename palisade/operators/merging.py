"""Set-based upserts: one full outer join instead of a lookup per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.ranking import last_per_key

Rule = Callable[[Column, Column], Column]


def merge_rows(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    matched: dict[str, Rule],
    inserted: dict[str, Column | None],
    order: list[str] = (),
    keep: list[str] = (),
) -> DataFrame:
    """The merged table plus ``action``: ``kept``, ``updated`` or ``new``.

    Of several new rows with one key the last by ``order`` counts; columns in
    ``keep`` take their last value that is not null. ``matched`` gives the value of a column
    when both sides exist, from (old, new); columns not listed keep the old
    value. ``inserted`` lists the columns an added row fills, ``None`` meaning
    the column of the new row.
    """
    new = last_per_key(new, keys, order, keep)
    o = old.select(F.struct(*old.columns).alias("o"), *keys)
    n = new.select(F.struct(*new.columns).alias("n"), *keys)
    joined = o.join(n, keys, "full_outer")
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()
    action = F.when(has_old & has_new, "updated").when(has_new, "new").otherwise("kept")

    def value(field) -> Column:
        name = field.name
        if name in keys:
            return F.col(name)
        before = F.col("o")[name]
        after = F.col("n")[name] if name in new.columns else F.lit(None)
        both = matched[name](before, after) if name in matched else before
        fresh = F.lit(None)
        if name in inserted:
            fresh = after if inserted[name] is None else inserted[name]
        return (F.when(has_old & has_new, both).when(has_new, fresh).otherwise(before)
                .cast(field.dataType).alias(name))

    return joined.select(*[value(f) for f in old.schema], action.alias("action"))


def action_counts(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows a merge added and changed, per optional group."""
    return merged.groupBy(*(by or [])).agg(
        F.count_if(F.col("action") == "new").alias("new_count"),
        F.count_if(F.col("action") == "updated").alias("updated_count"))


def insert_missing(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of ``batch`` whose key is new, the last per key by ``order``."""
    return last_per_key(batch, keys, order).join(existing.select(*keys), keys, "left_anti")


def set_where_listed(rows: DataFrame, listed: DataFrame, key: str, column: str, order: list[str] = ()) -> DataFrame:
    """Overwrite ``column`` for the keys in ``listed`` with the value listed there, the last by ``order``."""
    chosen = last_per_key(listed.select(*dict.fromkeys([key, column, *order])), [key], order).select(
        key, F.col(column).alias("__value"))
    return (rows.join(chosen, key, "left")
            .withColumn(column, F.coalesce("__value", column)).drop("__value"))

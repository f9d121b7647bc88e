"""Model registry and retraining decisions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.parsing import model_path
from palisade.operators.anomalies import false_positive_share
from palisade.operators.forest import Forest, ForestParams, fit_forest
from palisade.operators.inventory import ml_enabled
from palisade.operators.ranking import latest_per_key

MODEL_NAME = "anomaly_detection"
RETRAIN_DAYS = 7
SHARE_LIMIT = 0.3
PREFIX = "ml-models"


def active_models(models: DataFrame) -> DataFrame:
    """Newest active model of every organisation."""
    return latest_per_key(models.filter("is_active"), ["organization_id"], ["activated_at", "model_version"])


def registry_rows(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Rows to register: ``metrics`` has organization_id, model_version, training_samples,
    false_positive_rate, training_started_at, training_completed_at, checksum_sha256, hyperparameters."""
    seconds = F.timestamp_diff("SECOND", F.col("training_started_at"), F.col("training_completed_at"))
    return metrics.select(
        "organization_id", F.lit(MODEL_NAME).alias("model_name"), "model_version",
        F.lit("isolation_forest").alias("model_type"),
        model_path(PREFIX, F.col("organization_id"), F.lit(MODEL_NAME), F.col("model_version")).alias("model_path"),
        "checksum_sha256", "training_samples", "false_positive_rate", "training_started_at",
        "training_completed_at", seconds.alias("training_duration_seconds"), "hyperparameters",
        F.lit(True).alias("is_active"), as_of.alias("activated_at"))


def activate(models: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """Append newly trained models; what they replace is deactivated.

    Several fresh models of one name leave only the latest active.
    """
    key = ["organization_id", "model_name"]
    newest = fresh.groupBy(*key).agg(F.max(F.struct("training_completed_at", "model_version")).alias("__top"))
    retired = (models.join(newest.select(*key, F.lit(True).alias("__hit")), key, "left")
               .withColumn("__off", F.col("__hit").isNotNull() & F.col("is_active"))
               .withColumn("deactivated_at", F.when(F.col("__off"), as_of).otherwise(F.col("deactivated_at")))
               .withColumn("is_active", F.col("is_active") & ~F.col("__off")).drop("__hit", "__off"))
    top = F.struct("training_completed_at", "model_version") == F.col("__top")
    added = (fresh.join(newest, key)
             .withColumn("is_active", top).withColumn("activated_at", as_of)
             .withColumn("deactivated_at", F.when(~top, as_of)).drop("__top"))
    return retired.unionByName(added, allowMissingColumns=True)


def retrain_decisions(orgs: DataFrame, models: DataFrame, anomalies: DataFrame, as_of: Column,
                      interval_days: int = RETRAIN_DAYS, share_limit: float = SHARE_LIMIT) -> DataFrame:
    """Whether each organisation needs a new model, and why."""
    trained = (models.filter(F.col("is_active") & (F.col("model_name") == MODEL_NAME))
               .groupBy("organization_id").agg(F.max("training_completed_at").alias("trained_at")))
    rows = (orgs.select("organization_id").join(trained, "organization_id", "left")
            .join(false_positive_share(anomalies, as_of), "organization_id", "left"))
    age = F.timestamp_diff("DAY", F.col("trained_at"), as_of)
    share = F.col("false_positive_share")
    reason = (F.when(F.col("trained_at").isNull(), "no_existing_model")
              .when(age >= interval_days, F.format_string("scheduled_interval (%d days)", age))
              .when(share > share_limit, F.format_string("high_false_positive_rate (%.2f%%)", share * 100))
              .otherwise("not_needed"))
    return rows.select("organization_id", (reason != "not_needed").alias("should_retrain"), reason.alias("reason"))


def retrain(orgs: DataFrame, models: DataFrame, anomalies: DataFrame, features: DataFrame, key: list[str],
            as_of: Column, params: ForestParams = ForestParams()) -> tuple[Forest, DataFrame]:
    """One fit for all licensed organisations whose model is due; each gets its own forest."""
    due = (retrain_decisions(ml_enabled(orgs, as_of), models, anomalies, as_of)
           .filter("should_retrain").select("organization_id"))
    training = features.join(due, "organization_id", "left_semi")
    return fit_forest(training, key, replace(params), group="organization_id")

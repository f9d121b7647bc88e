"""Remediation tasks as tables: build, approve, apply results, roll back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import render_template
from palisade.operators.ranking import last_per_key, top_per_group

PREVIEW = 500
PENDING_HOURS = 24
DUAL_RISKS = ("high", "critical")

# The built-in templates (name, script, risk, needs downtime, rollback script).
TEMPLATES = (
    ("linux_apt_update", "sudo apt-get update && sudo apt-get upgrade -y", "medium", False, None),
    ("linux_apt_security",
     "sudo apt-get update && sudo apt-get upgrade -y --only-upgrade $(apt-get --just-print upgrade 2>&1 "
     "| grep -i security | awk '{print $2}' | sort -u)", "low", False, None),
    ("linux_restart_service", "sudo systemctl restart {service_name}", "medium", True, None),
    ("linux_firewall_block_ip", "sudo iptables -A INPUT -s {blocked_ip} -j DROP && sudo iptables-save", "medium", False,
     "sudo iptables -D INPUT -s {blocked_ip} -j DROP && sudo iptables-save"),
    ("linux_kill_process", "sudo pkill -9 -f '{process_pattern}'", "high", False, None),
    ("linux_update_package", "sudo apt-get update && sudo apt-get install -y --only-upgrade {package_name}", "low",
     False, None),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(
        list(templates), "template_name string, script string, risk_level string, requires_downtime boolean, "
                         "rollback_script string")


def template_listing(templates: DataFrame) -> DataFrame:
    return templates.select(F.col("template_name").alias("name"), "risk_level", "requires_downtime",
                            F.col("rollback_script").isNotNull().alias("has_rollback"))


def build_tasks(requests: DataFrame, templates: DataFrame, auto_approve_low: bool = False
                ) -> tuple[DataFrame, DataFrame]:
    """Requests to tasks, and requests that cannot become one.

    ``requests``: task_id, template_name, custom_script, parameters (map),
    vulnerability_id, anomaly_id and any columns to carry along.
    """
    t = templates.select("template_name", F.col("script").alias("__script"), F.col("risk_level").alias("__risk"),
                         F.col("requires_downtime").alias("__down"), F.col("rollback_script").alias("__back"))
    joined = requests.join(t, "template_name", "left")
    known = F.col("__script").isNotNull()
    custom = ~known & (F.length("custom_script") > 0)
    joined = (joined.withColumn("__s", F.when(known, render_template(F.col("__script"), F.col("parameters"))))
              .withColumn("__r", F.when(known, render_template(F.col("__back"), F.col("parameters")))))
    missing = F.coalesce(F.size("__s.missing") > 0, F.lit(False)) | F.coalesce(F.size("__r.missing") > 0, F.lit(False))
    reason = (F.when(~known & ~F.coalesce(custom, F.lit(False)), "no_template_or_script")
              .when(missing, "missing_parameter")
              .when(F.col("vulnerability_id").isNull() & F.col("anomaly_id").isNull(), "no_source"))
    rated = joined.withColumn("reject_reason", reason)
    risk = F.when(known, F.col("__risk")).otherwise("high")
    approved = F.lit(auto_approve_low) & (risk == "low")
    tasks = rated.filter(F.col("reject_reason").isNull()).select(
        *requests.columns, F.coalesce(F.col("__s.text"), F.col("custom_script")).alias("script"),
        risk.alias("risk_level"), F.when(known, F.col("__down")).otherwise(True).alias("requires_downtime"),
        F.col("__r.text").alias("rollback_script"), F.col("__r.text").isNotNull().alias("rollback_available"),
        F.when(approved, "approved").otherwise("pending_approval").alias("status"))
    return tasks, rated.filter(F.col("reject_reason").isNotNull()).select(*requests.columns, "reject_reason")


def _place() -> Column:
    return F.struct("approved_at", "seq", "approved_by")


def approval_outcomes(tasks: DataFrame, approvals: DataFrame, dual: bool = True) -> DataFrame:
    """One row per pending task with approvals: both approvers, their times and whether it is decided.

    High and critical risk need two people; until a second one comes, the
    first person's repeated approval only moves the time.
    """
    pending = tasks.filter(F.col("status") == "pending_approval").select(
        "task_id", (F.col("risk_level").isin(*DUAL_RISKS) & F.lit(dual)).alias("needs_two"))
    given = approvals.select("task_id", "approved_by", _place().alias("place"))
    firsts = given.groupBy("task_id", "approved_by").agg(F.min("place").alias("place"))
    two = (top_per_group(firsts, ["task_id"], [F.col("place")], 2).groupBy("task_id")
           .agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("people")))
    decided = (pending.join(two, "task_id")
               .withColumn("b", F.when(F.col("needs_two") & (F.col("people") > 1), F.col("b"))))
    # the last approval of the first person before the second person came
    repeats = decided.filter("needs_two").select("task_id", F.col("a.approved_by").alias("approved_by"), "b").join(
        given, ["task_id", "approved_by"])
    last = (repeats.filter(F.col("b").isNull() | (F.col("place") < F.col("b")))
            .groupBy("task_id").agg(F.max("place").alias("last_a")))
    rows = decided.join(last, "task_id", "left")
    return rows.select(
        "task_id", F.col("a.approved_by").alias("approved_by"),
        F.coalesce(F.col("last_a.approved_at"), F.col("a.approved_at")).alias("approved_at"),
        F.col("b.approved_by").alias("secondary_approved_by"), F.col("b.approved_at").alias("secondary_approved_at"),
        (~F.col("needs_two") | F.col("b").isNotNull()).alias("decided"),
        F.when(F.col("needs_two"), F.col("b")).otherwise(F.col("a")).alias("deciding"))


def apply_approvals(tasks: DataFrame, approvals: DataFrame, as_of: Column, dual: bool = True) -> DataFrame:
    outcome = approval_outcomes(tasks, approvals, dual).withColumn("__hit", F.lit(True)).drop("deciding")
    fields = ("approved_by", "approved_at", "secondary_approved_by", "secondary_approved_at")
    joined = tasks.drop(*fields).join(outcome, "task_id", "left")
    return (joined.withColumn("status", F.when(F.col("decided"), "approved").otherwise(F.col("status")))
            .withColumn("updated_at", F.when(F.col("__hit"), as_of)).drop("decided", "__hit"))


def rejected_approvals(tasks: DataFrame, approvals: DataFrame, dual: bool = True) -> DataFrame:
    """Approvals that find no task, or one no longer pending when they arrive."""
    state = tasks.select("task_id", (F.col("status") == "pending_approval").alias("__pending"))
    deciding = approval_outcomes(tasks, approvals, dual).select("task_id", F.col("deciding").alias("__deciding"))
    rows = approvals.join(state, "task_id", "left").join(deciding, "task_id", "left")
    late = F.coalesce(_place() > F.col("__deciding"), F.lit(False))
    reason = (F.when(F.col("__pending").isNull(), "task_not_found")
              .when(~F.col("__pending") | late, "not_pending_approval"))
    return (rows.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())
            .drop("__pending", "__deciding"))


def rejected_commands(tasks: DataFrame, commands: DataFrame, required: str) -> DataFrame:
    """Commands whose task is missing or not in the required status."""
    rows = commands.join(tasks.select("task_id", F.col("status").alias("__status")), "task_id", "left")
    reason = (F.when(F.col("__status").isNull(), "task_not_found")
              .when(F.col("__status") != required, f"not_{required}"))
    return (rows.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull()).drop("__status"))


def apply_results(tasks: DataFrame, results: DataFrame, as_of: Column, order: list[str] = ("completed_at",)) -> DataFrame:
    """Execution results onto approved tasks; the last per task by ``order`` counts."""
    r = last_per_key(results, ["task_id"], order).select("task_id", *[F.col(c).alias(f"__{c}") for c in
                                    ("exit_code", "stdout", "stderr", "started_at", "completed_at")])
    joined = tasks.join(r, "task_id", "left")
    hit = F.col("__exit_code").isNotNull() & (F.col("status") == "approved")
    good = F.col("__exit_code") == 0

    def put(name: str, value: Column) -> Column:
        old = F.col(name) if name in tasks.columns else F.lit(None)
        return F.when(hit, value).otherwise(old).alias(name)

    changed = {
        "status": F.when(good, "completed").otherwise("failed"), "exit_code": F.col("__exit_code"),
        "execution_output": F.col("__stdout"), "error_message": F.when(~good, F.col("__stderr")),
        "started_at": F.col("__started_at"), "completed_at": F.col("__completed_at"), "updated_at": as_of,
    }
    kept = [c for c in tasks.columns if c not in changed]
    return joined.select(*kept, *[put(c, v) for c, v in changed.items()])


def apply_rollbacks(tasks: DataFrame, rollbacks: DataFrame, as_of: Column,
                    order: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mark tasks rolled back by the last command of each by ``order``; commands on missing tasks or without a rollback script are rejected."""
    c = last_per_key(rollbacks, ["task_id"], order).select("task_id", F.col("rolled_back_by").alias("__by"), F.col("reason").alias("__why"))
    joined = tasks.join(c, "task_id", "left")
    hit = F.col("__by").isNotNull() & (F.length("rollback_script") > 0)
    changed = {"status": F.lit("rolled_back"), "rolled_back_at": as_of, "rolled_back_by": F.col("__by"),
               "rollback_reason": F.col("__why"), "updated_at": as_of}
    kept = [x for x in tasks.columns if x not in changed]
    done = joined.select(*kept, *[
        F.when(hit, v).otherwise(F.col(x) if x in tasks.columns else F.lit(None)).alias(x)
        for x, v in changed.items()])
    state = tasks.select("task_id", F.coalesce(F.length("rollback_script") > 0, F.lit(False)).alias("__can"))
    reason = F.when(F.col("__can").isNull(), "task_not_found").when(~F.col("__can"), "no_rollback_script")
    rejects = (rollbacks.join(state, "task_id", "left").withColumn("reject_reason", reason)
               .filter(F.col("reject_reason").isNotNull()).drop("__can"))
    return done, rejects


def audit_rows(results: DataFrame) -> DataFrame:
    """Audit entries for executed tasks, output cut to a preview."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    preview = F.when(F.length("stdout") > 0, F.substring("stdout", 1, PREVIEW))
    state = F.to_json(F.struct("exit_code", seconds.alias("duration_seconds"), preview.alias("stdout_preview")),
                      {"ignoreNullFields": "false"})
    return results.select(
        "organization_id", F.lit("remediation_executed").alias("action"),
        F.lit("remediation_task").alias("resource_type"), F.col("task_id").alias("resource_id"),
        state.alias("new_state"), (F.col("exit_code") == 0).alias("success"), F.lit("system").alias("actor_type"))


def overdue_approvals(tasks: DataFrame, as_of: Column, hours: int = PENDING_HOURS) -> DataFrame:
    limit = as_of - F.make_interval(hours=F.lit(hours))
    return tasks.filter((F.col("status") == "pending_approval") & (F.col("requested_at") < limit))

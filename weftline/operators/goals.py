"""Goals: acceptance signals over children, status with its basis, refreshes, scope growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.structured import meets
from weftline.operators.joins import delta
from weftline.operators.reconcile import child_status, metric_status

GROWTH = 1


def _statuses(params: Column, path: str) -> Column:
    rows = F.from_json(F.get_json_object(params, path), "array<struct<status:string>>")
    return F.coalesce(F.transform(rows, lambda r: r["status"]), F.array().cast("array<string>"))


def _count(values: Column, *wanted: str) -> Column:
    return F.size(F.filter(values, lambda v: v.isin(*wanted)))


def evaluate_signals(signals: DataFrame, children: DataFrame) -> DataFrame:
    """Signals (goal, signal, kind, child, met, max_open, metric, op, threshold, envs) with what their child (goal, child, params) says.

    Adds now_met and error: ``unresolved`` for a child that is not there, ``missing_metric`` for a metric that is
    no number. A freeform signal keeps its own met.
    """
    known = children.select("goal", "child", "params", F.lit(True).alias("there"))
    rows = signals.join(known, ["goal", "child"], "left")
    p = F.col("params")
    issues, failures, tasks = _statuses(p, "$.issues"), _statuses(p, "$.failures"), _statuses(p, "$.tasks")
    metric = F.expr("try_cast(get_json_object(params, concat('$.current.', metric)) as double)")
    envs = F.from_json(F.get_json_object(p, "$.envs"), "map<string,struct<enabled:boolean>>")
    on = lambda e: F.coalesce(e["enabled"], F.lit(False))
    all_on = F.when(F.col("envs").isNull(), (F.size(F.map_keys(envs)) > 0) & F.forall(F.map_values(envs), on)).otherwise(F.forall("envs", lambda k: F.coalesce(F.try_element_at(envs, k)["enabled"], F.lit(False))))
    kind = F.col("kind")
    met = (
        F.when(kind == "freeform", F.col("met")).when(F.col("there").isNull(), F.lit(False))
        .when(kind == "audit_issues_open_count", _count(issues, "open") <= F.col("max_open"))
        .when(kind == "failure_table_clean", _count(failures, "fail", "flaky") == 0)
        .when(kind == "task_list_complete", (F.size(tasks) > 0) & (_count(tasks, "done") == F.size(tasks)))
        .when(kind == "metric_threshold", meets(metric, F.col("op"), F.col("threshold")))
        .when(kind == "reflective_decided", F.get_json_object(p, "$.status").isin("decided", "archived"))
        .when(kind == "deployment_envs_enabled", all_on)
    )
    error = F.when((kind != "freeform") & F.col("there").isNull(), "unresolved").when((kind == "metric_threshold") & metric.isNull(), "missing_metric")
    return rows.withColumns({"now_met": F.coalesce(met, F.lit(False)), "error": error}).drop("params", "there")


def children_with_basis(children: DataFrame, artifacts: DataFrame, augmented: DataFrame, signals: DataFrame) -> DataFrame:
    """Children (child, artifact_id, archetype) with status and basis: orphan, unknown without augmentation (id, params), or
    from their parameters; a metric baseline from the evaluated signals (child, met) that cite it."""
    rows = children.join(artifacts.select(F.col("id").alias("artifact_id"), F.lit(True).alias("exists")), "artifact_id", "left")
    rows = rows.join(augmented.select(F.col("id").alias("artifact_id"), "params", F.lit(True).alias("augmented")), "artifact_id", "left")
    rows = rows.join(metric_status(signals).withColumnRenamed("status", "cited"), "child", "left")
    baseline = F.col("archetype") == "metric_baseline"
    status = F.when(F.col("exists").isNull(), "orphan").when(F.col("augmented").isNull(), "unknown").when(baseline, F.coalesce("cited", F.lit("active"))).otherwise(child_status(F.col("archetype"), F.col("params")))
    rows = rows.withColumn("status", status)
    basis = (
        F.when(F.col("exists").isNull(), "child unreachable").when(F.col("augmented").isNull(), "no augmentation")
        .when(baseline & F.col("cited").isNull(), "needs parent context").when(F.col("status") == "unknown", F.when(F.col("archetype") == "", "no augmentation").otherwise("unknown archetype"))
        .otherwise("deterministic")
    )
    return rows.select("child", "artifact_id", "archetype", "status", basis.alias("basis"))


def refresh_meta(now: DataFrame, before: DataFrame, prior_streak: int, commits_since: int) -> DataFrame:
    """One row (deltas, unchanged_refreshes): the changes of child statuses, and how often in a row nothing changed."""
    changes = delta(now, before, "child", "status")
    listed = F.array_sort(F.collect_list(F.struct("child", "was", "now")))
    streak = F.when((F.count("*") == 0) & F.lit(commits_since == 0), prior_streak + 1).otherwise(0)
    return changes.agg(listed.alias("deltas"), streak.alias("unchanged_refreshes"))


def scope_growth(new: DataFrame, prior: DataFrame, key: str = "id", most: int = GROWTH) -> DataFrame:
    """One row (added, allowed): ids that are new; the first set of ids may be of any size."""
    had = prior.agg(F.count("*").alias("had"))
    return new.join(prior, key, "left_anti").agg(F.count("*").alias("added")).join(F.broadcast(had)).select("added", ((F.col("had") == 0) | (F.col("added") <= most)).alias("allowed"))  # one row each

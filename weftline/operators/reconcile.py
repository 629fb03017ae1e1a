"""Reconciling what is found with what is on record: backlogs, findings, goals, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.ordering import numbered

RANK = {"high": 3, "med": 2, "low": 1}
RESOLVED, SILENT = ("resolved", "resolved_basename"), ("external", "unknown")
# Severity of each verdict of a reference check.
SEVERITY = {"missing": "high", "file_missing": "high", "symbol_missing": "high", "anchor_missing": "med", "line_oob": "med", "ambiguous_basename": "med"}
# Error families that count as friction in code, and those that count as none.
CODE_FAMILIES = ("ast_extent_fail", "ambiguous_name_path", "replace_dropped_sibling")
INFRA_FAMILIES = ("lsp_disconnect", "lsp_index_locked", "mux_startup_fail", "lsp_not_running")


def backlog(prior: DataFrame, current: DataFrame, today: str) -> DataFrame:
    """Rows (key, status, score, first_seen, closed_at) after a scan: what it found is open with its new score,
    what was open and is not found is closed today, and what was found again after closing is open again."""
    p = prior.select(F.col("key").alias("k"), "status", F.col("score").alias("old"), "first_seen", "closed_at")
    both = p.join(current.select("key", "score"), F.col("k") == F.col("key"), "full")
    found, closing = F.col("key").isNotNull(), F.col("key").isNull() & (F.col("status") == "open")
    return both.select(
        F.coalesce("key", "k").alias("key"), F.when(found, "open").when(closing, "closed").otherwise(F.col("status")).alias("status"),
        F.when(found, F.col("score")).otherwise(F.col("old")).alias("score"), F.coalesce("first_seen", F.lit(today)).alias("first_seen"),
        F.when(found, F.lit(None).cast("string")).when(closing, F.lit(today)).otherwise(F.col("closed_at")).alias("closed_at"),
    )


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "med", 2).when(c == "low", 1).otherwise(0)


def severity(verdict: Column, path: Column) -> tuple[Column, Column]:
    """(severity, reason) of a verdict: archives and issues one step lower, memories two, the first that fits."""
    base = F.lit(1)
    for v, s in SEVERITY.items():
        base = F.when(verdict == v, RANK[s]).otherwise(base)
    archive = F.contains(path, F.lit("docs/archive/")) | path.endswith(".archive.md")
    memory, issues = F.contains(path, F.lit("memories/")), F.contains(path, F.lit("docs/issues/"))
    steps = F.when(archive, 1).when(memory, 2).when(issues, 1).otherwise(0)
    reason = F.when(archive, "archive_drop").when(memory, "memory_drop").when(issues, "issues_drop").otherwise("policy_default")
    return F.element_at(F.array(F.lit("low"), F.lit("med"), F.lit("high")), F.greatest(base - steps, F.lit(1))), reason


def merge_findings(prior: DataFrame, found: DataFrame) -> DataFrame:
    """Issues (n, md_file, raw_ref, status, severity) after an audit's findings (position, md_file, raw_ref, verdict, severity).

    A resolved one that was open is fixed, one that is broken again is open; wontfix stays. Severity only
    rises. New broken ones are open, numbered on in the order of their positions.
    """
    key = ["md_file", "raw_ref"]
    f = found.groupBy(*key).agg(F.min_by(F.struct("position", "verdict"), "position").alias("f"), F.max(F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))["severity"].alias("now"))
    good, quiet = F.col("f.verdict").isin(*RESOLVED), F.col("f.verdict").isin(*SILENT)
    both = prior.join(f, key, "full")
    status = F.when(F.col("f").isNull() | (F.col("status") == "wontfix"), F.col("status")).when(good & (F.col("status") == "open"), "fixed").when(~good & ~quiet & (F.col("status") == "fixed"), "open").otherwise(F.col("status"))
    worse = severity_rank(F.col("now")) > severity_rank(F.col("severity"))
    known = both.where("n is not null").select("n", *key, status.alias("status"), F.when(worse, F.col("now")).otherwise(F.col("severity")).alias("severity"))
    new = both.where(F.col("n").isNull() & ~good & ~quiet)
    last = prior.agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))
    added = numbered(new.select(*key, "now", F.col("f.position").alias("position")), ["position", *key], "i").join(F.broadcast(last))  # one row
    return known.unionByName(added.select((F.col("last") + F.col("i")).alias("n"), *key, F.lit("open").alias("status"), F.col("now").alias("severity")))


def friction(calls: DataFrame) -> DataFrame:
    """Per friction_target: truncations, code-class failures, other failures and sessions, with the score."""
    named = calls.where("friction_target is not null and friction_target != ''")
    code, none = F.col("err_family").isin(*CODE_FAMILIES), F.coalesce(F.col("err_family").isin(*CODE_FAMILIES, *INFRA_FAMILIES), F.lit(False))
    out = named.groupBy("friction_target").agg(
        F.count_if(F.col("overflowed") == 1).alias("truncations"), F.count_if(code).alias("code_fails"),
        F.count_if((F.col("outcome") != "success") & ~none).alias("other"), F.count_distinct("cc_session_id").alias("sessions"),
    )
    return out.withColumn("score", 3 * F.col("truncations") + 2 * F.col("code_fails") + F.col("other"))


def rank_candidates(defects: DataFrame, costs: DataFrame) -> DataFrame:
    """Defects (rel_file, name_path, tokens) with the friction of their name, else of their file, biting ones first."""
    own = ["truncations", "code_fails", "other", "score"]
    by = lambda p: costs.select(F.col("friction_target").alias(f"{p}t"), F.struct(*own).alias(p))
    out = defects.join(by("a"), F.col("name_path") == F.col("at"), "left").join(by("b"), F.col("rel_file") == F.col("bt"), "left")
    f = F.coalesce("a", "b")
    out = out.withColumn("score", F.coalesce(f["score"], F.lit(0))).withColumn("tier", F.when(F.coalesce(f["truncations"] + f["code_fails"] + f["other"], F.lit(0)) > 0, 1).otherwise(2))
    out = out.withColumn("key", F.concat_ws("::", "rel_file", "name_path"))
    return out.select("key", "rel_file", "name_path", "tokens", "tier", "score").orderBy("tier", F.desc("score"), F.desc("tokens"), "key")


def child_status(archetype: Column, params: Column) -> Column:
    """Status of a goal's child from its parameters (JSON text), by archetype."""
    at = lambda p: F.get_json_object(params, p)

    def over(path: str, done, else_: str) -> Column:
        rows = F.from_json(at(path), "array<struct<status:string>>")
        return F.when(rows.isNull(), "unknown").when(F.size(rows) == 0, "pending").when(F.forall(rows, lambda r: F.coalesce(done(r["status"]), F.lit(False))), "done").otherwise(else_)

    envs = F.map_values(F.from_json(at("$.envs"), "map<string,struct<enabled:boolean>>"))
    own = at("$.status")
    return (
        F.when(archetype == "failure_table", over("$.failures", lambda s: s.isin("pass", "wontfix"), "active"))
        .when(archetype == "task_list", over("$.tasks", lambda s: s == "done", "in-progress"))
        .when(archetype == "audit_issues", over("$.issues", lambda s: s.isNull() | (s != "open"), "active"))
        .when(archetype == "reflective", F.when(own.isin("decided", "archived"), "done").when(own == "deferred", "blocked").otherwise("active"))
        .when(archetype == "goal", F.when(own == "done", "done").when(own.isin("blocked", "abandoned"), "blocked").when(own == "scoping", "pending").when(own == "pending-confirmation", "in-progress").otherwise("active"))
        .when(archetype == "deployment_state", F.when(envs.isNull(), "unknown").when(F.size(envs) == 0, "pending").when(F.forall(envs, lambda e: F.coalesce(e["enabled"], F.lit(False))), "done").otherwise("in-progress"))
        .otherwise("unknown")
    )


def goal_gate(children: DataFrame, signals: DataFrame) -> DataFrame:
    """(goal, verdict): auto_close, or the first of too_few_children, children_incomplete and signals_unmet."""
    c = children.groupBy("goal").agg(F.count("*").alias("n"), F.count_if(~F.col("status").eqNullSafe("done")).alias("open"))
    s = signals.groupBy("goal").agg(F.count_if(~F.col("met").eqNullSafe(True)).alias("unmet"))
    verdict = F.when(F.coalesce("n", F.lit(0)) < 2, "too_few_children").when(F.col("open") > 0, "children_incomplete").when(F.coalesce("unmet", F.lit(0)) > 0, "signals_unmet").otherwise("auto_close")
    return c.join(s, "goal", "full").select("goal", verdict.alias("verdict"))


def metric_status(signals: DataFrame) -> DataFrame:
    """(child, status): done if all signals that cite it are met, in-progress if any, else active."""
    return signals.groupBy("child").agg(F.when(F.bool_and("met"), "done").when(F.bool_or("met"), "in-progress").otherwise("active").alias("status"))


def path_problems(path: Column) -> Column:
    """First thing wrong with a stored path, null if nothing is."""
    return F.when(path.isNull() | (path == ""), "empty").when(F.contains(path, F.lit("\\")), "backslash").when(path.rlike(r"(^|/)\.\.(/|$)"), "parent").when(~path.startswith("/"), "relative").when(path.rlike(":[^/]"), "stream")

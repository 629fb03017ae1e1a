"""Reconciliation queries: two periods of events as scans, labels and documents as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import error_family
from weftline.operators import reconcile as rc
from weftline.plans import query
from weftline.plans.telemetry import CALLS_SQL, calls
from weftline.staging import table

P_SQL = """prior AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status, count(*) AS score, '2024-01-01' AS first_seen, CASE WHEN user_id % 3 = 0 THEN '2024-01-02' END AS closed_at FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id % 5 != 0 GROUP BY user_id),
cur AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id % 7 != 0 GROUP BY user_id)"""


@query(
    "reconcile_backlog",
    f"""WITH {P_SQL} SELECT COALESCE(c.key, p.key) AS key, CASE WHEN c.key IS NOT NULL THEN 'open' WHEN p.status = 'open' THEN 'closed' ELSE p.status END AS status, CASE WHEN c.key IS NOT NULL THEN c.score ELSE p.score END AS score,
  COALESCE(p.first_seen, '2024-01-31') AS first_seen, CASE WHEN c.key IS NOT NULL THEN NULL WHEN p.status = 'open' THEN '2024-01-31' ELSE p.closed_at END AS closed_at FROM prior p FULL JOIN cur c ON p.key = c.key""",
)
def reconcile_backlog(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string").alias("key")
    prior = e.where("ts < timestamp'2024-01-10' and user_id % 5 != 0").groupBy("user_id").agg(F.count("*").alias("score"))
    closed = F.col("user_id") % 3 == 0
    prior = prior.select(key, F.when(closed, "closed").otherwise("open").alias("status"), "score", F.lit("2024-01-01").alias("first_seen"), F.when(closed, "2024-01-02").alias("closed_at"))
    now = e.where("ts >= timestamp'2024-01-10' and user_id % 7 != 0").groupBy("user_id").agg(F.count("*").alias("score")).select(key, "score")
    return rc.backlog(prior, now, "2024-01-31")


@query(
    "merge_findings",
    """WITH prior AS (SELECT CAST(doc_id + 1 AS BIGINT) AS n, source AS md_file, CAST(doc_id AS VARCHAR) AS raw_ref, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' ELSE 'wontfix' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE 'med' END AS severity FROM documents WHERE lang != 'fr'),
f AS (SELECT doc_id AS position, source AS md_file, CAST(doc_id AS VARCHAR) AS raw_ref, CASE doc_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'missing' WHEN 2 THEN 'line_oob' ELSE 'unknown' END AS verdict, CASE doc_id % 4 WHEN 1 THEN 'high' WHEN 2 THEN 'med' ELSE 'low' END AS severity FROM documents),
r AS (SELECT * FROM (VALUES ('high', 3), ('med', 2), ('low', 1)) t(s, k))
SELECT p.n, p.md_file, p.raw_ref, CASE WHEN f.verdict IS NULL OR p.status = 'wontfix' THEN p.status WHEN f.verdict = 'resolved' AND p.status = 'open' THEN 'fixed' WHEN f.verdict IN ('missing','line_oob') AND p.status = 'fixed' THEN 'open' ELSE p.status END AS status,
  CASE WHEN COALESCE((SELECT k FROM r WHERE s = f.severity), 0) > (SELECT k FROM r WHERE s = p.severity) THEN f.severity ELSE p.severity END AS severity
FROM prior p LEFT JOIN f USING (md_file, raw_ref)
UNION ALL SELECT (SELECT max(n) FROM prior) + row_number() OVER (ORDER BY position), md_file, raw_ref, 'open', severity FROM f WHERE verdict IN ('missing','line_oob') AND raw_ref NOT IN (SELECT raw_ref FROM prior)""",
)
def merge_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("md_file"), F.col("doc_id").cast("string").alias("raw_ref"))
    prior = d.where("lang != 'fr'").select((F.col("doc_id") + 1).alias("n"), "md_file", "raw_ref", F.expr("CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' ELSE 'wontfix' END").alias("status"), F.expr("if(doc_id % 2 = 0, 'low', 'med')").alias("severity"))
    f = d.select(F.col("doc_id").alias("position"), "md_file", "raw_ref", F.expr("CASE doc_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'missing' WHEN 2 THEN 'line_oob' ELSE 'unknown' END").alias("verdict"), F.expr("CASE doc_id % 4 WHEN 1 THEN 'high' WHEN 2 THEN 'med' ELSE 'low' END").alias("severity"))
    return rc.merge_findings(prior, f)


@query(
    "severity_policy",
    """WITH x AS (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN 'docs/archive/' WHEN 1 THEN 'memories/' ELSE 'docs/' END) || source AS path, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS base FROM documents)
SELECT doc_id, CASE greatest(base - CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END, 1) WHEN 3 THEN 'high' WHEN 2 THEN 'med' ELSE 'low' END AS severity, CASE doc_id % 3 WHEN 0 THEN 'archive_drop' WHEN 1 THEN 'memory_drop' ELSE 'policy_default' END AS reason FROM x""",
)
def severity_policy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s, why = rc.severity(F.expr("CASE doc_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'line_oob' ELSE 'unknown' END"), F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN 'docs/archive/' WHEN 1 THEN 'memories/' ELSE 'docs/' END"), "source"))
    return d.select("doc_id", s.alias("severity"), why.alias("reason"))


def recorded(spark, sf_dir):
    message = F.expr("CASE id % 5 WHEN 0 THEN 'AST parse failed at 3' WHEN 1 THEN 'LSP server disconnected' WHEN 2 THEN 'x: symbol not found' END")
    return calls(spark, sf_dir).select("*", error_family(message).alias("err_family"), F.when(F.expr("id % 17 != 0"), F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("friction_target"), F.when(F.expr("id % 9 != 0"), F.col("session_id")).alias("cc_session_id"))


FRICTION_SQL = f"""(SELECT friction_target, count(*) FILTER (overflowed = 1) AS truncations, count(*) FILTER (fam = 'ast_extent_fail') AS code_fails,
  count(*) FILTER (outcome != 'success' AND (fam IS NULL OR fam NOT IN ('ast_extent_fail','lsp_disconnect'))) AS other, count(DISTINCT sess) AS sessions,
  3 * count(*) FILTER (overflowed = 1) + 2 * count(*) FILTER (fam = 'ast_extent_fail') + count(*) FILTER (outcome != 'success' AND (fam IS NULL OR fam NOT IN ('ast_extent_fail','lsp_disconnect'))) AS score
FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'ast_extent_fail' WHEN 1 THEN 'lsp_disconnect' WHEN 2 THEN 'symbol_not_found' END AS fam, CASE WHEN id % 17 != 0 THEN 't' || id % 40 END AS friction_target, CASE WHEN id % 9 != 0 THEN session_id END AS sess FROM {CALLS_SQL})
WHERE friction_target IS NOT NULL GROUP BY friction_target)"""


@query("friction_by_target", f"SELECT * FROM {FRICTION_SQL}")
def friction_by_target(spark, sf_dir):
    return rc.friction(recorded(spark, sf_dir))


@query(
    "friction_ranked",
    f"""SELECT d.source || '::' || d.np AS key, d.tokens, CASE WHEN COALESCE(a.truncations + a.code_fails + a.other, b.truncations + b.code_fails + b.other, 0) > 0 THEN 1 ELSE 2 END AS tier, COALESCE(a.score, b.score, 0) AS score
FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 't' || doc_id % 40 ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id ELSE 't' || doc_id % 60 END AS np, strlen(text) // 4 AS tokens FROM documents) d
LEFT JOIN {FRICTION_SQL} a ON d.np = a.friction_target LEFT JOIN {FRICTION_SQL} b ON d.source = b.friction_target""",
)
def friction_ranked(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("if(doc_id % 4 = 0, 't' || doc_id % 40, source)").alias("rel_file"), F.expr("if(doc_id % 2 = 0, 'n' || doc_id, 't' || doc_id % 60)").alias("name_path"), F.floor(F.octet_length("text") / 4).alias("tokens"))
    return rc.rank_candidates(d, rc.friction(recorded(spark, sf_dir))).select("key", "tokens", "tier", "score")


@query(
    "goal_gate",
    """WITH c AS (SELECT o_custkey AS goal, CASE WHEN o_orderstatus = 'F' OR o_custkey % 3 = 0 THEN 'done' ELSE 'active' END AS status FROM orders), s AS (SELECT c_custkey AS goal, c_acctbal > 0 AS met FROM customer)
SELECT COALESCE(x.goal, y.goal) AS goal, CASE WHEN COALESCE(n, 0) < 2 THEN 'too_few_children' WHEN open > 0 THEN 'children_incomplete' WHEN COALESCE(unmet, 0) > 0 THEN 'signals_unmet' ELSE 'auto_close' END AS verdict
FROM (SELECT goal, count(*) AS n, count(*) FILTER (status != 'done') AS open FROM c GROUP BY goal) x FULL JOIN (SELECT goal, count(*) FILTER (NOT met) AS unmet FROM s GROUP BY goal) y ON x.goal = y.goal""",
)
def goal_gate(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("goal"), F.expr("if(o_orderstatus = 'F' or o_custkey % 3 = 0, 'done', 'active')").alias("status"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("goal"), (F.col("c_acctbal") > 0).alias("met"))
    return rc.goal_gate(c, s)


@query("metric_status", "SELECT o_custkey AS child, CASE WHEN bool_and(o_totalprice > 50000) THEN 'done' WHEN bool_or(o_totalprice > 50000) THEN 'in-progress' ELSE 'active' END AS status FROM orders GROUP BY o_custkey")
def metric_status(spark, sf_dir):
    return rc.metric_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child"), (F.col("o_totalprice") > 50000).alias("met")))


@query(
    "child_status",
    """SELECT o_custkey AS child, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'done' ELSE 'in-progress' END AS tasks, CASE WHEN bool_and(o_orderstatus != 'O') THEN 'done' ELSE 'active' END AS issues FROM orders GROUP BY o_custkey""",
)
def child_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("child")).agg(F.collect_list(F.struct(F.expr("if(o_orderstatus = 'F', 'done', 'todo')").alias("status"))).alias("tasks"), F.collect_list(F.struct(F.expr("if(o_orderstatus = 'O', 'open', 'fixed')").alias("status"))).alias("issues"))
    rows = rows.withColumn("p", F.to_json(F.struct("tasks", "issues")))
    return rows.select("child", rc.child_status(F.lit("task_list"), F.col("p")).alias("tasks"), rc.child_status(F.lit("audit_issues"), F.col("p")).alias("issues"))

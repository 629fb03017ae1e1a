"""Queries of goals, event creation, grouped candidates: orders and customers as goals and children."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import structured as sd
from weftline.functions.text import dirname
from weftline.operators import goals as go
from weftline.operators import graph as gr
from weftline.operators import joins as jn
from weftline.operators import reconcile as rc
from weftline.plans import query
from weftline.plans.catalog import ARTIFACTS_SQL, artifacts
from weftline.plans.events import EDGES_SQL, LOG_SQL, edges, log
from weftline.staging import table


@query(
    "goal_signals",
    """WITH c AS (SELECT o_custkey AS goal, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) AS top FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS goal, k FROM customer, (VALUES ('task_list_complete'), ('audit_issues_open_count'), ('metric_threshold')) v(k))
SELECT s.goal, s.k AS kind, CASE WHEN c.goal IS NULL THEN false WHEN k = 'task_list_complete' THEN n = f WHEN k = 'metric_threshold' THEN top >= 400000 ELSE o <= 3 END AS now_met, CASE WHEN c.goal IS NULL THEN 'unresolved' END AS error FROM s LEFT JOIN c ON s.goal = c.goal""",
)
def goal_signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = lambda test, a, b: F.collect_list(F.struct(F.expr(f"if(o_orderstatus = '{test}', '{a}', '{b}')").alias("status")))
    made = o.groupBy(F.col("o_custkey").alias("goal")).agg(status("F", "done", "todo").alias("tasks"), status("O", "open", "fixed").alias("issues"), F.struct(F.max("o_totalprice").alias("top")).alias("current"))
    kids = made.select("goal", F.lit("k").alias("child"), F.to_json(F.struct("tasks", "issues", "current")).alias("params"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("task_list_complete", "audit_issues_open_count", "metric_threshold")]))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("goal"), F.lit("k").alias("child"), kinds.alias("kind"), F.lit(False).alias("met"), F.lit(3).alias("max_open"), F.lit("top").alias("metric"), F.lit(">=").alias("op"), F.lit(400000.0).alias("threshold"), F.lit(None).cast("array<string>").alias("envs"))
    return go.evaluate_signals(s, kids).select("goal", "kind", "now_met", "error")


@query(
    "child_basis",
    """SELECT c_custkey AS child, CASE WHEN c_custkey % 7 = 0 THEN 'orphan' WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'done' ELSE 'active' END ELSE 'active' END WHEN c_custkey % 3 = 1 THEN 'blocked' ELSE 'unknown' END AS status,
  CASE WHEN c_custkey % 7 = 0 THEN 'child unreachable' WHEN c_custkey % 5 = 0 THEN 'no augmentation' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'deterministic' ELSE 'needs parent context' END WHEN c_custkey % 3 = 1 THEN 'deterministic' ELSE 'unknown archetype' END AS basis FROM customer""",
)
def child_basis(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.col("c_custkey").alias("artifact_id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'metric_baseline' WHEN 1 THEN 'reflective' ELSE 'strange' END").alias("archetype"), "c_acctbal")
    ids = c.select(F.col("artifact_id").alias("id"))
    signals = c.where("child % 2 = 0").select("child", (F.col("c_acctbal") > 0).alias("met"))
    return go.children_with_basis(c, ids.where("id % 7 != 0"), ids.where("id % 5 != 0").withColumn("params", F.lit('{"status": "deferred"}')), signals).select("child", "status", "basis")


@query("refresh_streak", "SELECT 0 AS n_deltas, 4 AS unchanged_refreshes UNION ALL SELECT (SELECT count(*) FROM labels WHERE doc_id % 4 = 0), 0")
def refresh_streak(spark, sf_dir):
    now = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("child"), F.col("quality").cast("string").alias("status"))
    other = now.withColumn("status", F.when(F.expr("child % 4 = 0"), F.lit("x")).otherwise(F.col("status")))
    size = lambda df: df.select(F.size("deltas").alias("n_deltas"), "unchanged_refreshes")
    return size(go.refresh_meta(now, now, 3, 0)).unionByName(size(go.refresh_meta(now, other, 3, 0)))


@query("scope_growth", "SELECT count(*) AS added, count(*) <= 1 AS allowed FROM documents WHERE doc_id % 50 = 0")
def scope_growth(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return go.scope_growth(d, d.where("id % 50 != 0"))


@query(
    "graph_with_events",
    f"""WITH n AS (SELECT DISTINCT artifact_id AS id FROM {LOG_SQL}), m AS (SELECT * FROM {LOG_SQL} WHERE artifact_id IN (SELECT id FROM n)), e AS (SELECT * FROM {EDGES_SQL} WHERE src_event_id IN (SELECT id FROM m))
SELECT 'artifact' AS what, count(*) AS n FROM n UNION ALL SELECT 'event', count(*) FROM m UNION ALL SELECT 'edge', count(*) FROM e UNION ALL SELECT 'source', count(DISTINCT artifact_id) FROM m WHERE id % 5 = 0""",
)
def graph_with_events(spark, sf_dir):
    e = log(spark, sf_dir)
    n = e.select(F.col("artifact_id").alias("id")).distinct()
    none = F.lit(None).cast("long")
    to_sources = e.where("id % 5 = 0").select(F.col("id").alias("src_event_id"), none.alias("dst_event_id"), none.alias("dst_artifact_id"), F.col("artifact_id").alias("dst_source_id"), F.lit("triggered_by").alias("rel"))
    nodes, links = gr.with_events(n, spark.createDataFrame([], "src long, dst long, rel string"), e, edges(spark, sf_dir).unionByName(to_sources), e.select(F.col("artifact_id").alias("id")).distinct())
    return nodes.groupBy(F.col("node_type").alias("what")).agg(F.count("*").alias("n")).unionByName(links.where("rel != 'triggered_by'").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@query("direct_successor", f"SELECT artifact_id AS id, arg_max(dst, (created_at, id)) AS superseded_by FROM {LOG_SQL} WHERE kind = 'superseded_by' GROUP BY artifact_id")
def direct_successor(spark, sf_dir):
    return gr.successor(log(spark, sf_dir))


@query(
    "create_links",
    f"""SELECT 'links' AS what, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) UNION ALL SELECT 'rejected', count(*) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 != 0
UNION ALL SELECT 'superseded', count(*) FROM {ARTIFACTS_SQL} a WHERE id % 2 = 0 AND (status = 'superseded' OR id % 6 = 0) UNION ALL SELECT 'events', count(*) FROM documents WHERE doc_id % 6 = 0""",
)
def create_links(spark, sf_dir):
    a = artifacts(spark, sf_dir).where("id % 2 = 0")
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("supersedes").alias("rel"))
    out = jn.create_links(new.limit(0), new, a, 5)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(out["links"], "links").unionByName(count(out["rejected"], "rejected")).unionByName(count(out["artifacts"].where("status = 'superseded'"), "superseded")).unionByName(count(out["events"], "events"))


@query(
    "create_events",
    """WITH i AS (SELECT event_id FROM events WHERE event_type = 'view'), v AS (SELECT event_id + 1000000 AS id, user_id, ts, event_id // 2 AS resolves FROM events WHERE event_type = 'click'),
r AS (SELECT v.*, CASE WHEN resolves NOT IN (SELECT event_id FROM i) THEN 'no such intent' WHEN row_number() OVER (PARTITION BY resolves ORDER BY ts, id) > 1 THEN 'resolved before' END AS reason FROM v)
SELECT COALESCE(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""",
)
def create_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("artifact_id"), F.lit("intent").alias("kind"), F.lit('{"text": "x"}').alias("payload"), F.col("ts").alias("created_at"))
    new = e.where("event_type = 'click'").select((F.col("event_id") + 1000000).alias("id"), F.col("user_id").alias("artifact_id"), F.lit("verdict").alias("kind"), F.lit('{"outcome": "met"}').alias("payload"), F.col("ts").alias("created_at"), F.floor(F.col("event_id") / 2).alias("resolves"))
    good, bad = jn.create_events(old, new, spark.createDataFrame([], "dst_event_id long, rel string"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n"))


@query("upsert_commits", "SELECT CAST(o_orderkey AS VARCHAR) AS hash, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS subject, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS topo_order FROM orders")
def upsert_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").alias("authored_at"), F.lit("old").alias("subject"), (F.col("o_orderkey") + 1).alias("topo_order"), "o_orderkey")
    new = o.where("o_orderkey % 2 = 0").withColumn("subject", F.lit("new")).withColumn("topo_order", F.when(F.expr("o_orderkey % 4 = 0"), F.col("o_orderkey")))
    return jn.upsert_commits(o.drop("o_orderkey"), new.drop("o_orderkey")).select("hash", "subject", "topo_order")


@query("orphan_sweep", f"SELECT id FROM {ARTIFACTS_SQL} a WHERE NOT starts_with(abs_path, '/ws/fr/') OR starts_with(abs_path, '/ws/fr/src1/')")
def orphan_sweep(spark, sf_dir):
    return jn.orphan_sweep(artifacts(spark, sf_dir), "abs_path", ["/ws/fr"], ["/ws/fr/src1"]).select("id")


@query(
    "first_seen_union",
    "SELECT id, min(l) AS list, CAST(min_by(position, (l, position)) AS BIGINT) AS position FROM (SELECT doc_id AS id, 0 AS l, n_chars AS position FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY id",
)
def first_seen_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = jn.first_seen_union(d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("position")), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position")))
    return out.select("id", "at.list", "at.position")


@query(
    "candidate_groups",
    "SELECT source AS key, list_sort(list_distinct(list(lang))) AS defects, min(doc_id % 2) + 1 AS tier, max(n_chars) AS tokens, max(doc_id) AS lines, max(doc_id % 7) AS score FROM documents GROUP BY source",
)
def candidate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("lang").alias("defect"), F.col("lang").alias("defect_rank"), (F.col("doc_id") % 2 + 1).alias("tier"), F.col("n_chars").alias("tokens"), F.col("doc_id").alias("lines"), (F.col("doc_id") % 7).alias("score"))
    return jn.group_candidates(d).withColumn("defects", F.array_sort("defects"))


@query("drift_doctor", "SELECT CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'backslash' WHEN 2 THEN 'parent' WHEN 3 THEN 'relative' END AS problem, count(*) AS n FROM documents WHERE doc_id % 5 != 4 GROUP BY 1")
def drift_doctor(spark, sf_dir):
    p = F.expr(r"CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'C:\\x' WHEN 2 THEN '/a/../b' WHEN 3 THEN 'a/b' ELSE '/a/b' END")
    d = table(spark, sf_dir, "documents").select(rc.path_problems(p).alias("problem")).where("problem is not null")
    return d.groupBy("problem").agg(F.count("*").alias("n"))


@query("outcome_classify", "SELECT CASE WHEN event_id % 4 = 0 THEN 'error' WHEN event_id % 4 = 1 THEN 'recoverable_error' ELSE 'success' END AS outcome, event_id % 4 = 2 AS overflowed, count(*) AS n, count(DISTINCT user_id) AS targets FROM events GROUP BY 1, 2")
def outcome_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    result = F.expr("""CASE event_id % 4 WHEN 1 THEN '{"error": "x"}' WHEN 2 THEN '{"output_id": "@1"}' ELSE '{}' END""")
    call = F.to_json(F.struct(F.lit("").alias("symbol"), F.col("user_id").cast("string").alias("path")))
    rows = e.select(sd.outcome(F.expr("event_id % 4 = 0"), result).alias("o"), sd.friction_target(call).alias("target"))
    return rows.groupBy("o.outcome", "o.overflowed").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query("folders", "SELECT regexp_replace(abs_path, '/[^/]*$', '') AS dir, count(*) AS n FROM " + ARTIFACTS_SQL + " a GROUP BY 1")
def folders(spark, sf_dir):
    return artifacts(spark, sf_dir).groupBy(dirname(F.col("abs_path")).alias("dir")).agg(F.count("*").alias("n"))


@query("backfill_nulls", "SELECT doc_id, COALESCE(quality, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def backfill_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 2000, 1).otherwise(0)).alias("quality"))

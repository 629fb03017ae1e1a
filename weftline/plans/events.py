"""Event-log queries over ``events``, with users in the role of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import events as ev
from weftline.operators.ordering import latest_per
from weftline.operators.ordering import numbered
from weftline.plans import query
from weftline.staging import table

LOG_SQL = """(SELECT event_id AS id, user_id AS artifact_id,
  CASE event_type WHEN 'purchase' THEN 'status_change' WHEN 'error' THEN 'field_patch' WHEN 'click' THEN 'reviewed' WHEN 'signup' THEN 'superseded_by' ELSE 'note' END AS kind,
  's' || CAST(event_id % 5 AS VARCHAR) AS dst, CASE WHEN event_id % 3 = 0 THEN 'topic' ELSE 'owner' END AS field, ts AS created_at FROM events)"""
CUT, CUT2 = "2024-01-15 12:00:00", "2024-01-25 00:00:00"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'status_change' WHEN 'error' THEN 'field_patch' WHEN 'click' THEN 'reviewed' WHEN 'signup' THEN 'superseded_by' ELSE 'note' END")
    to = F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string"))
    field = F.when(F.col("event_id") % 3 == 0, "topic").otherwise("owner")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("artifact_id"), kind.alias("kind"), F.to_json(F.struct(to.alias("to"), field.alias("field"), to.alias("target_artifact_id"))).alias("payload"), F.col("ts").alias("created_at"))


def users(spark, sf_dir):
    mtime = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(user_id % 28 as int), 0, 0, 0)")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").alias("id"), F.lit("current").alias("status"), mtime.alias("file_mtime"))


def fold_sql(cut):
    return f"""(SELECT artifact_id, arg_max(dst, (created_at, id)) FILTER (kind = 'status_change') AS status, max(created_at) FILTER (kind = 'reviewed') AS reviewed_at,
  arg_max(dst, (created_at, id)) FILTER (kind = 'superseded_by') AS superseded_by, arg_max(kind, (created_at, id)) AS latest_kind, arg_max(id, (created_at, id)) AS latest_id,
  arg_max(dst, (created_at, id)) FILTER (kind = 'field_patch' AND field = 'topic') AS topic, arg_max(dst, (created_at, id)) FILTER (kind = 'field_patch' AND field = 'owner') AS owner
  FROM {LOG_SQL} WHERE created_at <= TIMESTAMP '{cut}' GROUP BY artifact_id)"""


USERS_SQL = "(SELECT DISTINCT user_id AS id, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 28 AS INTEGER)) AS file_mtime FROM events)"
FRESH_SQL = "CASE WHEN {f}.latest_kind = 'superseded_by' THEN 'superseded' WHEN {f}.reviewed_at IS NULL THEN 'unknown' WHEN u.file_mtime > {f}.reviewed_at THEN 'stale' ELSE 'fresh' END"


@query("latest_event_per_entity", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_entity(spark, sf_dir):
    return latest_per(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "state_as_of",
    f"""SELECT u.id, COALESCE(f.status, 'current') AS status_as_of, f.topic, f.owner, f.superseded_by, f.latest_id, {FRESH_SQL.format(f="f")} AS freshness
FROM {USERS_SQL} u LEFT JOIN {fold_sql(CUT)} f ON u.id = f.artifact_id""",
)
def state_as_of(spark, sf_dir):
    s = ev.state_at(users(spark, sf_dir), log(spark, sf_dir), F.lit(CUT).cast("timestamp"))
    return s.select("id", "status_as_of", F.try_element_at("patches", F.lit("topic")).alias("topic"), F.try_element_at("patches", F.lit("owner")).alias("owner"), "superseded_by", "latest_id", "freshness")


@query(
    "freshness_then_vs_now",
    f"""SELECT u.id, {FRESH_SQL.format(f="a")} AS was, {FRESH_SQL.format(f="b")} AS now, {FRESH_SQL.format(f="a")} != {FRESH_SQL.format(f="b")} AS changed
FROM {USERS_SQL} u LEFT JOIN {fold_sql(CUT)} a ON u.id = a.artifact_id LEFT JOIN {fold_sql(CUT2)} b ON u.id = b.artifact_id""",
)
def freshness_then_vs_now(spark, sf_dir):
    u, e = users(spark, sf_dir), log(spark, sf_dir)
    at = lambda cut, name: ev.state_at(u, e, F.lit(cut).cast("timestamp")).select("id", F.col("freshness").alias(name))
    return at(CUT, "was").join(at(CUT2, "now"), "id").withColumn("changed", F.col("was") != F.col("now"))


@query("parent_chain", "SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id FROM events")
def parent_chain(spark, sf_dir):
    return ev.parents(log(spark, sf_dir)).select("id", "parent_id")


@query("timeline_since_after_limit", f"SELECT id, kind FROM (SELECT id, kind, created_at FROM {LOG_SQL} WHERE artifact_id = 7 AND kind IN ('note','reviewed') AND created_at <= TIMESTAMP '{CUT2}' ORDER BY created_at DESC, id DESC LIMIT 20) WHERE created_at >= TIMESTAMP '{CUT}'")
def timeline_since_after_limit(spark, sf_dir):
    stamp = lambda s: F.lit(s).cast("timestamp")
    return ev.timeline(log(spark, sf_dir), 7, ["note", "reviewed"], stamp(CUT2), stamp(CUT), 20).select("id", "kind")


EDGES_SQL = f"""(SELECT id AS src_event_id, id + 1 AS dst_event_id, NULL AS dst_artifact_id, CASE WHEN id % 4 = 0 THEN 'parent' ELSE 'resolves' END AS rel FROM {LOG_SQL} WHERE id % 2 = 0
  UNION ALL SELECT id, NULL, artifact_id, 'mutates' FROM {LOG_SQL} WHERE id % 3 = 0)"""


def edges(spark, sf_dir):
    e = log(spark, sf_dir)
    none = F.lit(None).cast("long")
    a = e.where("id % 2 = 0").select(F.col("id").alias("src_event_id"), (F.col("id") + 1).alias("dst_event_id"), none.alias("dst_artifact_id"), none.alias("dst_source_id"), F.when(F.expr("id % 4 = 0"), "parent").otherwise("resolves").alias("rel"))
    b = e.where("id % 3 = 0").select(F.col("id").alias("src_event_id"), none.alias("dst_event_id"), F.col("artifact_id").alias("dst_artifact_id"), none.alias("dst_source_id"), F.lit("mutates").alias("rel"))
    return a.unionByName(b)


@query(
    "event_edges_pivot",
    f"""SELECT l.id, min(e.dst_event_id) FILTER (e.rel = 'parent') AS parent_event_id, min(e.dst_event_id) FILTER (e.rel = 'resolves') AS resolves_intent_id, count(DISTINCT e.dst_artifact_id) AS n_mutates,
  (SELECT min(src_event_id) FROM {EDGES_SQL} x WHERE x.rel = 'resolves' AND x.dst_event_id = l.id) AS resolved_by_verdict_id
FROM {LOG_SQL} l LEFT JOIN {EDGES_SQL} e ON l.id = e.src_event_id GROUP BY l.id""",
)
def event_edges_pivot(spark, sf_dir):
    rows = ev.with_edges(log(spark, sf_dir), edges(spark, sf_dir))
    return rows.select("id", "parent_event_id", "resolves_intent_id", F.coalesce(F.size("mutates"), F.lit(0)).cast("long").alias("n_mutates"), "resolved_by_verdict_id")


@query("open_intents", f"SELECT id FROM (SELECT id, CASE WHEN kind = 'note' THEN 'intent' ELSE kind END AS kind FROM {LOG_SQL}) WHERE kind = 'intent' AND id NOT IN (SELECT dst_event_id FROM {EDGES_SQL} WHERE rel = 'resolves')")
def open_intents(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "note", "intent").otherwise(F.col("kind")))
    return ev.open_intents(e, edges(spark, sf_dir)).select("id")


@query("orphan_verdicts", f"SELECT id FROM (SELECT id, CASE WHEN kind = 'note' THEN 'verdict' ELSE kind END AS kind FROM {LOG_SQL}) WHERE kind = 'verdict' AND id NOT IN (SELECT src_event_id FROM {EDGES_SQL} WHERE rel = 'resolves')")
def orphan_verdicts(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "note", "verdict").otherwise(F.col("kind")))
    return ev.orphan_verdicts(e, edges(spark, sf_dir)).select("id")


COMMITS_SQL = "(SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderdate AS authored_at, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS topo_order FROM orders)"


def commits(spark, sf_dir):
    o = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.col("o_orderdate").alias("authored_at"), (F.col("n") - 1).alias("topo_order"))


@query("as_of_commit_cutoff", f"SELECT p AS prefix, count(*) AS matches, CASE WHEN count(*) = 1 THEN max(authored_at) END AS cutoff FROM {COMMITS_SQL} c, (VALUES ('6b86b2'), ('4')) v(p) WHERE starts_with(hash, p) GROUP BY p")
def as_of_commit_cutoff(spark, sf_dir):
    c = commits(spark, sf_dir)
    one = lambda p: ev.cutoff_of_commit(c, p).select(F.lit(p).alias("prefix"), "matches", "cutoff")
    return one("6b86b2").unionByName(one("4"))


@query("topo_distance", f"SELECT abs(a.topo_order - b.topo_order) AS distance FROM {COMMITS_SQL} a, {COMMITS_SQL} b WHERE a.hash = sha256('1') AND b.hash = sha256('2')")
def topo_distance(spark, sf_dir):
    import hashlib

    h = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    return ev.topo_distance(commits(spark, sf_dir), *h)


@query("payload_errors", f"SELECT kind, count(*) AS n FROM {LOG_SQL} WHERE kind = 'field_patch' AND id % 6 = 0 GROUP BY kind UNION ALL SELECT 'bad', count(*) FROM {LOG_SQL} WHERE kind = 'note' AND id % 6 = 0")
def payload_errors(spark, sf_dir):
    e = log(spark, sf_dir)
    e = e.withColumn("kind", F.when((F.col("kind") == "note") & (F.col("id") % 6 == 0), "bad").otherwise(F.col("kind"))).withColumn("payload", F.when(F.col("id") % 6 == 0, F.lit('{"to": "x", "target_artifact_id": 1}')).otherwise(F.col("payload")))
    return e.withColumn("error", ev.payload_error()).where("error is not null").groupBy("kind").agg(F.count("*").alias("n"))

"""Catalog queries over ``documents`` with ``labels`` in the role of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import filters as fx
from weftline.operators import joins as jn
from weftline.operators import ordering as od
from weftline.plans import query
from weftline.staging import table

ARTIFACTS_SQL = """(SELECT d.doc_id AS id, d.source AS kind,
  CASE WHEN l.toxic = 1 THEN 'superseded' WHEN l.quality = 0 THEN 'archived' WHEN l.quality = 1 THEN 'active' END AS status,
  d.text AS title, d.lang AS topic, d.n_chars AS updated_at, string_split(lower(d.text), ' ') AS tags,
  '/ws/' || d.lang || '/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS abs_path, d.text AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def artifacts(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "of")
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 0, "archived").when(F.col("quality") == 1, "active")
    return d.join(lab, F.col("doc_id") == F.col("of"), "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("kind"), status.alias("status"), F.col("text").alias("title"), F.col("lang").alias("topic"), F.col("n_chars").alias("updated_at"),
        F.split(F.lower("text"), " ", -1).alias("tags"), F.concat(F.lit("/ws/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("abs_path"), F.col("text").alias("body"),
    )


FIELDS = ("id", "kind", "status", "title", "topic", "updated_at", "tags", "abs_path")


def columns(df):
    return {**{f: F.col(f) for f in FIELDS}, "rel_path": F.col("abs_path")}, {**dict(df.dtypes), "rel_path": "string"}


def where(df, node, mode="sql"):
    return df.where(fx.compile_filter(node, *columns(df), mode=mode)) if node else df


@query(
    "find_filtered_page",
    f"""SELECT id, kind, status, title, updated_at FROM {ARTIFACTS_SQL} a
WHERE (topic = 'en' OR title ILIKE '%tion%') AND updated_at >= 500 AND (status NOT IN ('archived','superseded','retired'))
ORDER BY updated_at DESC, id LIMIT 50 OFFSET 10""",
)
def find_filtered_page(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    node = fx.find_filter({"and": [{"or": [{"topic": {"eq": "en"}}, {"title": {"contains": "tion"}}]}, {"updated_at": {"gte": 500}}]})
    return od.page(where(a, node), [F.desc("updated_at"), F.col("id")], 50, 10).select("id", "kind", "status", "title", "updated_at")


@query("filter_not_in_prefix", f"SELECT id, status FROM {ARTIFACTS_SQL} a WHERE NOT (kind IN ('src1','src2') OR abs_path ILIKE '/ws/e%') AND status != 'archived'")
def filter_not_in_prefix(spark, sf_dir):
    node = {"and": [{"not": {"or": [{"kind": {"in": ["src1", "src2"]}}, {"rel_path": {"prefix": "/ws/e"}}]}}, {"status": {"ne": "archived"}}]}
    return where(artifacts(spark, sf_dir), node).select("id", "status")


@query("filter_array_contains", f"SELECT id, len(tags) AS n_tags FROM {ARTIFACTS_SQL} a WHERE list_contains(tags, 'the') AND updated_at < 3000")
def filter_array_contains(spark, sf_dir):
    return where(artifacts(spark, sf_dir), {"and": [{"tags": {"contains": "the"}}, {"updated_at": {"lt": 3000}}]}).select("id", F.size("tags").cast("long").alias("n_tags"))


@query(
    "filter_eval_mode_nulls",
    f"""SELECT id, COALESCE(status, '-') AS status FROM {ARTIFACTS_SQL} a
WHERE NOT COALESCE(status = 'active', false) AND COALESCE(status != 'archived', true) AND contains(lower(title), 'er')""",
)
def filter_eval_mode_nulls(spark, sf_dir):
    node = {"and": [{"not": {"status": {"eq": "active"}}}, {"status": {"ne": "archived"}}, {"title": {"contains": "ER"}}]}
    return where(artifacts(spark, sf_dir), node, "eval").select("id", F.coalesce("status", F.lit("-")).alias("status"))


@query("count_matching", f"SELECT count(*) AS n FROM {ARTIFACTS_SQL} a WHERE kind IN ('src3') AND status = 'active'")
def count_matching(spark, sf_dir):
    return where(artifacts(spark, sf_dir), fx.find_filter(None, ["src3"], ["active"])).agg(F.count("*").alias("n"))


@query(
    "facet_summary",
    f"""SELECT kind, count(*) AS total, count(*) FILTER (id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS augmented
FROM {ARTIFACTS_SQL} a GROUP BY ROLLUP (kind)""",
)
def facet_summary(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("of")).distinct()
    a = artifacts(spark, sf_dir).join(good, F.col("id") == F.col("of"), "left")
    return a.rollup("kind").agg(F.count("*").alias("total"), F.count("of").alias("augmented"))


@query("augmented_semi", "SELECT doc_id AS id, source AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def augmented_semi(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"))


@query("augmented_anti", "SELECT doc_id AS id, source AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def augmented_anti(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"))


@query(
    "scope_progressive_hints",
    """SELECT count(*) FILTER (host = 'blog.tionsh.example.net') AS here, count(*) FILTER (host LIKE '%.example.net' AND host != 'blog.tionsh.example.net') AS wider,
  count(*) FILTER (host NOT LIKE '%.example.net') AS everywhere, count(*) FILTER (url LIKE '%/fr/%' AND host = 'blog.tionsh.example.net') AS hidden
FROM (SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""",
)
def scope_progressive_hints(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    here, near = F.col("host") == "blog.tionsh.example.net", F.col("host").endswith(".example.net")
    return p.agg(F.count_if(here).alias("here"), F.count_if(near & ~here).alias("wider"), F.count_if(~near).alias("everywhere"), F.count_if(here & F.contains("url", F.lit("/fr/"))).alias("hidden"))


@query("scope_umbrella", f"SELECT id, abs_path FROM {ARTIFACTS_SQL} a WHERE starts_with(abs_path, '/ws/fr/src1/') OR starts_with(abs_path, '/ws/de/src2/')")
def scope_umbrella(spark, sf_dir):
    return artifacts(spark, sf_dir).where(fx.scope_filter("umbrella", F.col("abs_path"), umbrella=["/ws/fr/src1", "/ws/de/src2"])).select("id", "abs_path")


@query("hidden_count", f"SELECT count(*) FILTER (status IN ('archived','superseded','retired')) AS hidden, count(*) FILTER (status IS NULL) AS unknown, count(*) AS total FROM {ARTIFACTS_SQL} a WHERE topic = 'de'")
def hidden_count(spark, sf_dir):
    node = fx.without_status(fx.find_filter({"topic": {"eq": "de"}}))
    return where(artifacts(spark, sf_dir), node).agg(F.count_if(F.col("status").isin(list(fx.HIDDEN))).alias("hidden"), F.count_if(F.col("status").isNull()).alias("unknown"), F.count("*").alias("total"))


@query("point_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "source", "n_chars")


@query("artifact_ids", "SELECT doc_id, substr(sha256('/ws/' || source || '/' || CAST(doc_id AS VARCHAR)), 1, 16) AS artifact_id, strlen(text) // 4 AS tokens, (strlen(text) // 4) > 2500 AS over FROM documents")
def artifact_ids(spark, sf_dir):
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.artifact_id(path).alias("artifact_id"), tx.token_estimate(F.col("text")).alias("tokens"), tx.over_inline_limit(F.col("text")).alias("over"))


@query(
    "upsert_keeps_created",
    """WITH old AS (SELECT doc_id AS id, n_chars AS created, source AS v FROM documents WHERE doc_id % 3 != 0),
new AS (SELECT doc_id AS id, -1 AS created, 'new' AS v FROM documents WHERE doc_id % 5 = 0)
SELECT COALESCE(o.id, n.id) AS id, COALESCE(o.created, n.created) AS created, CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END AS v FROM old o FULL JOIN new n ON o.id = n.id""",
)
def upsert_keeps_created(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created"), F.col("source").alias("v"))
    new = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("created"), F.lit("new").alias("v"))
    return jn.merge_keyed(old, new, ["id"], keep=["created"])


@query(
    "insert_ignore_links",
    """SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 != 0""",
)
def insert_ignore_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return jn.insert_ignore(o.where("dst % 2 = 0"), o.where("dst % 3 = 0"), ["src", "dst"])


@query("replace_vectors", "SELECT vec_id, label, false AS fresh FROM embeddings WHERE vec_id % 4 != 0 UNION ALL SELECT vec_id, label, true FROM embeddings WHERE vec_id % 4 = 0")
def replace_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return jn.replace_keyed(e.withColumn("fresh", F.lit(False)), e.where("vec_id % 4 = 0").withColumn("fresh", F.lit(True)), ["vec_id"])


@query("unseen_sweep", "SELECT doc_id, source FROM documents WHERE source != 'src1' OR doc_id % 2 = 0")
def unseen_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return jn.sweep(d, d.where("doc_id % 2 = 0").select("doc_id"), "doc_id", F.col("source") == "src1")


@query("cascade_delete_orders", "SELECT count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade_delete_orders(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("id"))
    left = jn.cascade_delete(gone, {"lines": (table(spark, sf_dir, "lineitem"), ["l_orderkey"])}, "id")["lines"]
    return left.agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("numbers"))


@query(
    "snapshot_diff",
    """WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 != 0), new AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' || CAST(doc_id AS VARCHAR) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 != 0),
both_ AS (SELECT COALESCE(n.doc_id, o.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h != n.h THEN 'modified' END AS change, COALESCE(n.h, o.h) AS content FROM old o FULL JOIN new n ON o.doc_id = n.doc_id),
moved AS (SELECT a.content, a.p AS new_path, g.p AS old_path FROM (SELECT content, min(path) AS p FROM both_ WHERE change = 'added' GROUP BY content) a JOIN (SELECT content, min(path) AS p FROM both_ WHERE change = 'deleted' GROUP BY content) g USING (content))
SELECT b.path, CASE WHEN m.old_path IS NOT NULL THEN 'renamed' ELSE b.change END AS change, m.old_path FROM both_ b LEFT JOIN moved m ON b.path = m.new_path
WHERE b.change IS NOT NULL AND NOT (b.change = 'deleted' AND b.path IN (SELECT old_path FROM moved))""",
)
def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 5 != 0").select(F.col("doc_id").alias("path"), F.when(F.expr("doc_id % 11 = 0"), F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.sha2("text", 256)).alias("hash"))
    return jn.diff_snapshots(old, new)


@query(
    "chunk_hash_drift",
    """WITH local AS (SELECT source || ':' || sha256(text) AS cid, doc_id FROM documents WHERE doc_id % 3 != 0), server AS (SELECT source || ':' || sha256(text) AS cid FROM documents WHERE doc_id % 4 != 0)
SELECT 'upsert' AS op, cid, doc_id FROM local WHERE cid NOT IN (SELECT cid FROM server) UNION ALL SELECT 'delete', cid, NULL FROM server WHERE cid NOT IN (SELECT cid FROM local)""",
)
def chunk_hash_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.sha2("text", 256)).alias("cid"), "doc_id")
    up, gone = jn.drift(d.where("doc_id % 3 != 0"), d.where("doc_id % 4 != 0").select("cid"), "cid")
    return up.select(F.lit("upsert").alias("op"), "cid", "doc_id").unionByName(gone.select(F.lit("delete").alias("op"), "cid", F.lit(None).cast("long").alias("doc_id")))


@query(
    "anchor_staleness",
    """SELECT a.doc_id, CASE WHEN c.doc_id IS NULL THEN 'deleted' WHEN c.h = a.h THEN 'fresh' ELSE 'changed' END AS state
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) a
LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 != 0) c ON a.doc_id = c.doc_id""",
)
def anchor_staleness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    now = d.where("path % 10 != 0").withColumn("hash", F.when(F.expr("path % 6 = 0"), F.lit("changed")).otherwise(F.col("hash")))
    return jn.anchor_state(d.where("path % 2 = 0"), now).select(F.col("path").alias("doc_id"), "state")


@query(
    "status_delta",
    """WITH now AS (SELECT doc_id, quality AS v FROM labels), was AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS v FROM labels WHERE doc_id % 5 != 0)
SELECT n.doc_id, CASE WHEN w.doc_id IS NULL THEN '(new)' ELSE CAST(w.v AS VARCHAR) END AS was, CAST(n.v AS VARCHAR) AS now FROM now n LEFT JOIN was w ON n.doc_id = w.doc_id WHERE w.doc_id IS NULL OR w.v IS DISTINCT FROM n.v""",
)
def status_delta(spark, sf_dir):
    now = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    was = table(spark, sf_dir, "labels").where("doc_id % 5 != 0").select("doc_id", F.when(F.expr("doc_id % 4 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")).cast("string").alias("v"))
    return jn.delta(now, was, "doc_id", "v")


def _hits(words):
    quoted = (w.replace("'", "''") for w in words)
    return " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in quoted)


@query(
    "bucket_classify",
    f"""WITH t AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), s AS (SELECT *, {_hits(tx.CODE_WORDS)} + CASE WHEN {' OR '.join(f"contains(low, '{x}')" for x in tx.CODE_SUFFIXES)} THEN 2 ELSE 0 END AS c,
  {_hits(tx.SYSTEM_WORDS)} AS s, {_hits(tx.PREFERENCE_WORDS)} AS p FROM t)
SELECT conv_id, turn, CASE WHEN c + s + p = 0 THEN 'unstructured' WHEN p > 0 AND p >= c AND p >= s THEN 'preferences' WHEN c >= s THEN 'code' ELSE 'system' END AS bucket FROM s""",
)
def bucket_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.classify_bucket(F.col("text")).alias("bucket"))


@query(
    "fair_round_robin_cap",
    """WITH t AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + l_linenumber) AS turn, count(*) OVER (PARTITION BY l_suppkey) AS group_size FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, turn, group_size FROM t ORDER BY turn, group_size DESC, l_suppkey LIMIT 250""",
)
def fair_round_robin_cap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return od.fair_cap(li, "l_suppkey", "pos", 250).select("l_suppkey", "l_orderkey", "l_linenumber", "turn", "group_size")


@query(
    "budgeted_prefix",
    """SELECT source, doc_id, running FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER w AS BIGINT) AS running, row_number() OVER w AS nth FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) WHERE running <= 40000 OR nth = 1""",
)
def budgeted_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return od.budget_prefix(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], F.col("n_chars"), 40000).select("source", "doc_id", "running")


@query(
    "head_tail_sample",
    """SELECT lang, doc_id, CAST(greatest(total - 30, 0) AS BIGINT) AS omitted FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE n <= 20 OR n > total - 10""",
)
def head_tail_sample(spark, sf_dir):
    return od.head_and_tail(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"]).select("lang", "doc_id", "omitted")


@query("per_file_diversity", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def per_file_diversity(spark, sf_dir):
    return od.top_per(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "rank")


@query("stale_first", "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 50")
def stale_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return od.page(d, [F.asc_nulls_first("quality"), F.col("doc_id")], 50).select("doc_id", "quality")

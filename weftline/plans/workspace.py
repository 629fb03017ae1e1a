"""Queries of symbols, documents and memory: parts as symbols, documents as notes, orders as commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import documents as dc
from weftline.operators import memory as mm
from weftline.operators import symbols as sy
from weftline.operators import text as to
from weftline.plans import query
from weftline.plans.catalog import ARTIFACTS_SQL, artifacts
from weftline.plans.events import USERS_SQL, commits, log, users
from weftline.staging import table

SYMBOLS_SQL = """(SELECT p_name AS name, p_brand || '/' || p_name AS name_path, CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'constant' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN 'target/' ELSE 'src/' END || p_type || '/' || p_brand || '.rs' AS file, p_partkey % 100 AS start_line, p_partkey % 100 + p_size AS end_line, p_partkey AS id FROM part)"""


def symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'constant' END")
    return p.select(F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_name").alias("name_path"), kind.alias("kind"), F.concat(F.expr("if(p_size % 5 = 0, 'target/', 'src/')"), "p_type", F.lit("/"), "p_brand", F.lit(".rs")).alias("file"),
                    (F.col("p_partkey") % 100).alias("start_line"), (F.col("p_partkey") % 100 + F.col("p_size")).alias("end_line"), F.col("p_partkey").alias("id"))


@query("symbol_name_match", f"SELECT id, name_path FROM {SYMBOLS_SQL} WHERE (name = 'ring' OR name_path = 'ring' OR starts_with(name, 'ring ') OR ends_with(name, ' ring') OR ends_with(name_path, ' ring') OR ends_with(name_path, '/ring')) AND kind IN ('function','method','constructor')")
def symbol_name_match(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return s.where(sy.name_matches("ring", F.col("name"), F.col("name_path")) & sy.kind_matches(F.col("kind"), "function")).select("id", "name_path")


@query("by_file_distribution", f"SELECT file, count(*) AS n FROM {SYMBOLS_SQL} GROUP BY file ORDER BY n DESC, file LIMIT 15")
def by_file_distribution(spark, sf_dir):
    return sy.by_file(symbols(spark, sf_dir))


@query("group_by_file", f"SELECT file, count(*) AS n, list(name ORDER BY id) AS items FROM {SYMBOLS_SQL} GROUP BY file")
def group_by_file(spark, sf_dir):
    return sy.grouped_by_file(symbols(spark, sf_dir), "id", "name")


@query("symbol_at_position", f"SELECT file, line, min_by(name_path, (end_line - start_line, name_path)) AS name_path FROM {SYMBOLS_SQL} s JOIN (SELECT DISTINCT file AS f, 50 AS line FROM {SYMBOLS_SQL}) p ON s.file = p.f AND line BETWEEN start_line AND end_line GROUP BY file, line")
def symbol_at_position(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return sy.at_position(s, s.select("file").distinct().withColumn("line", F.lit(50)))


@query("subdir_counts", f"SELECT string_split(file, '/')[2] AS dir, count(*) AS files FROM {SYMBOLS_SQL} GROUP BY 1")
def subdir_counts(spark, sf_dir):
    return sy.subdir_counts(symbols(spark, sf_dir).select(F.col("file").alias("path")), 1)


@query("excluded_build_dirs", f"SELECT count(*) FILTER (NOT starts_with(file, 'target/')) AS kept, count(*) FILTER (starts_with(file, 'target/')) AS excluded FROM {SYMBOLS_SQL}")
def excluded_build_dirs(spark, sf_dir):
    kept, out = sy.without_build_dirs(symbols(spark, sf_dir))
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(out))  # one row each


@query("library_classify", f"SELECT id, CASE WHEN starts_with(file, 'src/ECONOMY/') THEN 'eco' WHEN starts_with(file, 'src/') THEN 'own' ELSE 'project' END AS library FROM {SYMBOLS_SQL}")
def library_classify(spark, sf_dir):
    libs = spark.createDataFrame([("src/ECONOMY", "eco", 0), ("src", "own", 1), ("src/PROMO", "never", 2)], "root string, name string, position int")
    s = symbols(spark, sf_dir)
    found = sy.classify_library(s.select(F.col("file").alias("path")).distinct(), libs)
    return s.join(found, F.col("file") == F.col("path")).select("id", "library")


@query("call_site_check", "SELECT coalesce(a.s, b.s) AS symbol, coalesce(call_sites, 0) AS call_sites, coalesce(refs, 0) AS refs, coalesce(call_sites, 0) > coalesce(refs, 0) AS warn FROM (SELECT l_partkey AS s, count(*) AS call_sites FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS s, count(*) AS refs FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) b ON a.s = b.s")
def call_site_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), "l_linenumber")
    return sy.missed_call_sites(li.where("l_linenumber % 2 = 1"), li.where("l_linenumber % 2 = 0"))


@query("regex_likeness", "SELECT count(*) FILTER (position('ing.' in text) > 0) AS n FROM documents")
def regex_likeness(spark, sf_dir):
    # A full stop alone makes no pattern; a quantified one does.
    probe = F.regexp_replace("text", r"ing\.", "ing.*")
    plain = F.regexp_replace(probe, r"[|^$\[\]()\\+?*](?<!ing\.\*)", "")
    return table(spark, sf_dir, "documents").select(plain.alias("q")).agg(F.count_if(sy.regex_like(F.col("q"))).alias("n"))


NOTES_SQL = "(SELECT doc_id AS id, '/ws/' || CASE doc_id % 4 WHEN 0 THEN 'docs/issues/' WHEN 1 THEN 'docs/review-' WHEN 2 THEN 'src/' ELSE 'docs/TODO-' END || doc_id || '.md' AS path, source, lang FROM documents)"


@query(
    "index_rows",
    f"""SELECT path, CASE WHEN id % 5 = 0 THEN source WHEN id % 4 IN (0, 3) THEN 'tracker' WHEN id % 4 = 1 THEN 'memory' ELSE 'unknown' END AS kind, CASE WHEN id % 4 IN (0, 3) THEN 'active' END AS status,
  CASE WHEN id % 5 = 0 THEN lang ELSE 'T ' || source END AS title, CAST(CASE WHEN id % 5 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM {NOTES_SQL}""",
)
def index_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/ws/"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'docs/issues/' WHEN 1 THEN 'docs/review-' WHEN 2 THEN 'src/' ELSE 'docs/TODO-' END"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = F.when(F.expr("doc_id % 5 = 0"), F.concat(F.lit("---\nkind: "), "source", F.lit('\ntitle: "'), "lang", F.lit('"\n---\n# no\n'))).otherwise(F.concat(F.lit("intro\n# T "), "source", F.lit("\nbody\n")))
    return dc.index_row(d.select(path.alias("path"), text.alias("text")))


@query("checklist_progress", "SELECT source AS id, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS done, (list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) FILTER (doc_id % 3 != 0))[1:3] AS next FROM documents GROUP BY source")
def checklist_progress(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.expr("if(doc_id % 3 = 0, '- [x] ', '- [ ] ')"), F.col("doc_id").cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]), "\n")
    notes = d.groupBy(F.col("source").alias("id")).agg(F.concat(F.lit("```\n- [ ] fenced\n```\n"), body).alias("text"))
    return dc.checklist(notes)


@query("tiered_read", "SELECT doc_id AS id, CASE WHEN strlen(text) > 10000 THEN 'map' WHEN len(string_split(text, chr(10))) > 150 THEN 'hint' ELSE 'full' END AS tier FROM documents")
def tiered_read(spark, sf_dir):
    return dc.tiered_read(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "truncate_lines_bytes",
    """SELECT id, CAST(count(*) FILTER (used <= 500 AND i <= 5) AS BIGINT) AS shown, max(i) AS total FROM (SELECT id, i, sum(strlen(c) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used
FROM (SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS c FROM documents)) GROUP BY id""",
)
def truncate_lines_bytes(spark, sf_dir):
    return dc.truncated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 5, 500).select("id", "shown", "total")


@query("section_coverage", "SELECT lang AS id, count(*) FILTER (source IN ('src1','src2','src3')) AS read, count(*) AS total FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def section_coverage(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select(F.col("lang").alias("id"), F.col("source").alias("text")).distinct()
    return dc.section_coverage(h.where("text in ('src1', 'src2', 'src3')"), h).select("id", "read", "total")


@query(
    "basename_resolution",
    """WITH f AS (SELECT DISTINCT source || '/' || lang || '.md' AS path FROM documents), b AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '.md' WHEN 1 THEN lang || '.md' WHEN 2 THEN '../' || lang ELSE 'gone/' || lang || '.md' END AS ref FROM documents)
SELECT id, ref, CASE WHEN starts_with(ref, '../') THEN 'unknown' WHEN ref IN (SELECT path FROM f) THEN 'resolved' WHEN NOT contains(ref, '/') AND n = 1 THEN 'resolved_basename' WHEN NOT contains(ref, '/') AND n > 1 THEN 'ambiguous_basename' ELSE 'missing' END AS verdict FROM r LEFT JOIN b ON r.ref = b.name""",
)
def basename_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("path")).distinct()
    refs = d.select(F.col("doc_id").alias("id"), F.expr("CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '.md' WHEN 1 THEN lang || '.md' WHEN 2 THEN '../' || lang ELSE 'gone/' || lang || '.md' END").alias("ref"))
    return dc.resolve_paths(refs, files)


@query(
    "memory_recall",
    """SELECT query_id, rank, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 9), e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label % 2 = 0) WHERE rank <= 5""",
)
def memory_recall(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("if(label % 2 = 0, 'code', 'system')").alias("bucket"), "embedding")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return mm.recall(v, q, 5, "code").select("query_id", "rank", "id")


@query(
    "context_pack",
    f"""SELECT id, priority FROM (SELECT id, CASE WHEN kind = 'src1' THEN 0 WHEN status = 'active' THEN 1 ELSE 2 END AS priority, row_number() OVER w AS nth, sum(length(body)) OVER w AS running
FROM {ARTIFACTS_SQL} a WHERE topic = 'fr' WINDOW w AS (ORDER BY CASE WHEN kind = 'src1' THEN 0 WHEN status = 'active' THEN 1 ELSE 2 END, updated_at, id ROWS UNBOUNDED PRECEDING)) WHERE running <= 80000 OR nth = 1""",
)
def context_pack(spark, sf_dir):
    a = artifacts(spark, sf_dir).where("topic = 'fr'")
    rows = a.select("id", F.expr("if(kind = 'src1', 'tracker', 'doc')").alias("kind"), F.coalesce(F.col("status") == "active", F.lit(False)).alias("augmented"), F.col("updated_at").alias("position"), "body")
    return mm.context_pack(rows, 20_000).select("id", "priority")


@query("index_freshness", "SELECT project, CASE WHEN project = 'P3' THEN 'up_to_date' ELSE 'behind' END AS status, CASE project WHEN 'P1' THEN top - 10 WHEN 'P2' THEN 0 ELSE 0 END AS behind FROM (SELECT 'P' || p AS project, (SELECT count(*) - 1 FROM orders) AS top FROM range(1, 4) t(p))")
def index_freshness(spark, sf_dir):
    c = commits(spark, sf_dir).withColumn("project", F.explode(F.array(F.lit("P1"), F.lit("P2"), F.lit("P3"))))
    head = c.groupBy().agg(F.max_by("hash", "topo_order").alias("h"))
    rows = c.where("project = 'P1' and topo_order = 10").select("project", F.col("hash").alias("indexed_commit"))
    rows = rows.unionByName(spark.createDataFrame([("P2", "rebased")], "project string, indexed_commit string")).unionByName(head.select(F.lit("P3").alias("project"), F.col("h").alias("indexed_commit")))
    return mm.index_state(rows, c)


@query("git_log_source", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' AND regexp_matches(o_orderpriority, '^1-|^2-') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def git_log_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("authored_at"), F.col("o_orderpriority").alias("subject"))
    return mm.git_log(o, F.expr("timestamp_ntz'1996-06-01 00:00:00'"), "^1-|^2-").select(F.col("hash").alias("o_orderkey"), F.col("authored_at").alias("o_orderdate"))


@query("stale_augmentations", f"SELECT id, CAST(CASE WHEN id % 10 = 0 THEN NULL ELSE date_diff('hour', file_mtime, TIMESTAMP '2024-02-01') END AS BIGINT) AS age_hours FROM {USERS_SQL} WHERE id % 10 = 0 OR file_mtime < TIMESTAMP '2024-01-22' ORDER BY CASE WHEN id % 10 = 0 THEN NULL ELSE file_mtime END NULLS FIRST, id LIMIT 50")
def stale_augmentations(spark, sf_dir):
    u = users(spark, sf_dir)
    aug = u.select("id", F.when(F.expr("id % 10 != 0"), F.col("file_mtime")).alias("last_refreshed_at"))
    return mm.stale_augmentations(aug, u.select("id", "status"), F.lit("2024-02-01").cast("timestamp"), 240).select("id", "age_hours")


@query("observations_recent", "SELECT event_id AS id FROM events WHERE user_id = 11 AND ts > TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 25")
def observations_recent(spark, sf_dir):
    return mm.observations(log(spark, sf_dir), 11, F.lit("2024-01-10").cast("timestamp"), 25).select("id")


@query("workspace_state_cap_first", f"SELECT id FROM (SELECT id, updated_at FROM {ARTIFACTS_SQL} a WHERE status IS NULL OR status NOT IN ('archived','superseded') ORDER BY updated_at DESC, id LIMIT 200) WHERE id % 3 = 0")
def workspace_state_cap_first(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    states = a.select("id", F.expr("if(id % 3 = 0, 'stale', 'fresh')").alias("freshness"))
    return mm.workspace_state(a, states, "stale").select("id")


@query("entry_filter", "SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS entries, count(*) AS entry_total FROM orders GROUP BY o_custkey")
def entry_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderstatus").alias("status"))).alias("rows"))).alias("params"))
    return mm.entry_filter(o, "rows", F.try_element_at("entry", F.lit("status")) == "F")


@query("gather_sources", "SELECT 'labels' AS source, count(*) AS n FROM labels UNION ALL SELECT 'nations', count(*) FROM nation")
def gather_sources(spark, sf_dir):
    rows, unknown = mm.gather({"labels": table(spark, sf_dir, "labels"), "nations": table(spark, sf_dir, "nation")}, ["labels", "nothing", "nations"])
    assert unknown == ["nothing"]
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("log_summaries", "SELECT user_id AS id, CAST(sum(event_id % 50) AS BIGINT) AS passed, CAST(sum(event_id % 3) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS ignored FROM events WHERE event_type = 'view' GROUP BY user_id")
def log_summaries(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    line = F.concat(F.lit("test result: "), (F.col("event_id") % 50).cast("string"), F.lit(" passed; "), (F.col("event_id") % 3).cast("string"), F.lit(" failed; 0 ignored"))
    return to.test_log(e.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.collect_list(line), "\n").alias("text")))


@query(
    "config_blame",
    """WITH o AS (SELECT o_custkey % 10 AS f, o_orderkey AS k, o_orderstatus AS status, o_orderpriority[1:1] AS level, CASE WHEN o_orderstatus != 'P' THEN CAST(year(o_orderdate) AS VARCHAR) END AS extra FROM orders),
v AS (SELECT f, k, 'status' AS key, status AS value FROM o UNION ALL SELECT f, k, 'order.level', level FROM o UNION ALL SELECT f, k, 'extra', extra FROM o),
c AS (SELECT *, row_number() OVER (PARTITION BY f, key ORDER BY k) AS n, lag(value) OVER (PARTITION BY f, key ORDER BY k) AS old FROM v)
SELECT 'app' || f || '.json' AS file, key, arg_max({'v': value}, k).v AS value, CAST(max(k) FILTER (n = 1 OR value IS DISTINCT FROM old) AS VARCHAR) AS commit FROM c GROUP BY f, key""",
)
def config_blame(spark, sf_dir):
    from pyspark.sql import Window as W

    from weftline.operators import blame

    o = table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("app"), (F.col("o_custkey") % 10).cast("string"), F.lit(".json"))).withColumn("commit", F.col("o_orderkey").cast("string"))
    order = W.partitionBy("file").orderBy("o_orderkey")
    commits = o.select("commit", F.array_compact(F.array(F.lag("commit").over(order))).alias("parents"), F.col("o_orderkey").alias("at"))
    extra = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate").cast("string"))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.substring("o_orderpriority", 1, 1).alias("level")).alias("order"), extra.alias("extra")))
    versions = o.select("file", "commit", text.alias("text"))
    heads = o.groupBy("file").agg(F.max_by("commit", "o_orderkey").alias("head"))
    return blame.last_changes(commits, versions, blame.key_values(versions), heads).select("file", "key", "value", "commit")

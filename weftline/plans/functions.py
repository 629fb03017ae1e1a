"""Queries of scalar functions, workspace files and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import structured as sd
from weftline.functions import text as tx
from weftline.functions.schema import schema_violations as schema_column
from weftline.functions.template import render_json
from weftline.operators import documents as dc
from weftline.operators import graph as gr
from weftline.operators import memory as mm
from weftline.operators import ordering as od
from weftline.operators import reconcile as rc
from weftline.operators import retrieval as rx
from weftline.operators import symbols as sy
from weftline.operators import text as to
from weftline.plans import query
from weftline.plans.graph import LINKS_SQL, links
from weftline.plans.workspace import SYMBOLS_SQL, symbols
from weftline.sources import files
from weftline.staging import table


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


PATHS_SQL = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


@query("directory_listing", f"SELECT path, max(kind) AS kind FROM (SELECT string_split(path, '/')[1] AS path, CASE WHEN contains(path, '/') THEN 'dir' ELSE 'file' END AS kind FROM {PATHS_SQL}) GROUP BY path ORDER BY path LIMIT 201")
def directory_listing(spark, sf_dir):
    return files.listing(pages(spark, sf_dir).select("path"), 1).groupBy("path").agg(F.max("kind").alias("kind"))


@query("glob_search", f"SELECT path FROM {PATHS_SQL} WHERE regexp_matches(path, '^(?:.*/)?fr/[^/]*\\.html$') ORDER BY path LIMIT 100")
def glob_search(spark, sf_dir):
    return files.glob_search(pages(spark, sf_dir).select("path"), "**/fr/*.html")


@query("nearest_manifest", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a/b/Cargo.toml' ELSE 'package.json' END AS manifest, CASE WHEN doc_id % 2 = 0 THEN 'rust' ELSE 'node' END AS ecosystem FROM documents")
def nearest_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr("if(doc_id % 2 = 0, 'a/b/c/', 'a/x/')"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"))
    known = spark.createDataFrame([("a/b/Cargo.toml",), ("package.json",), ("z/go.mod",)], "path string")
    return d.join(files.nearest_manifest(d.select("path"), known), "path").select("doc_id", "manifest", "ecosystem")


@query("locked_versions", "SELECT source AS package, CAST(min(doc_id) AS VARCHAR) || '.0' AS version FROM documents GROUP BY source")
def locked_versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").cast("string").alias("v"))
    entry = F.concat(F.lit('[[package]]\nname = "'), "source", F.lit('"\nversion = "'), "v", F.lit('.0"\n'))
    lock = d.agg(F.array_join(F.collect_list(entry), "\n").alias("content")).select(F.lit("Cargo.lock").alias("path"), "content")
    return files.locked_versions(lock).select("package", "version")


@query(
    "text_functions",
    """SELECT doc_id, regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}\\s_-]', '', 'g') AS bare, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS cut,
  CASE WHEN doc_id % 8 BETWEEN 1 AND 6 THEN doc_id % 8 END AS level, 'red' AS plain FROM documents""",
)
def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    heading = F.concat(F.expr("repeat('#', cast(doc_id % 8 as int))"), F.lit(" x"))
    bare = F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}\s_-]", "")
    return d.select("doc_id", bare.alias("bare"), tx.truncate(F.col("text"), 60).alias("cut"), tx.heading_level(heading).alias("level"), tx.strip_ansi(F.concat(F.lit("\u001b[31mred"), F.lit("\u001b[0m"))).alias("plain"))


@query("slugs", "SELECT n_nationkey, lower(replace(n_name, '_', '_')) || '-of-' || n_regionkey AS slug FROM nation")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.slugify(F.concat("n_name", F.lit(" (of) "), F.col("n_regionkey").cast("string"), F.lit("!"))).alias("slug"))


@query("first_line_previews", "SELECT doc_id, CASE WHEN length(l) > 50 THEN left(l, list_max(list_filter(range(48), lambda k: strlen(left(l, k)) <= 47))) || '...' ELSE l END AS preview FROM (SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '\\r$', '')) AS l FROM documents)")
def first_line_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sd.first_line_preview(F.col("text")).alias("preview"))


@query("json_negative_index", "SELECT user_id, CAST(list(event_id ORDER BY event_id)[-1] AS VARCHAR) AS last, CAST(list(event_id ORDER BY event_id)[1] AS VARCHAR) AS first, count(*) AS n FROM events GROUP BY user_id")
def json_negative_index(spark, sf_dir):
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("event_id")).alias("ids"))).alias("j"))
    shape = sd.json_shape(F.get_json_object("j", "$.ids"))
    return docs.select("user_id", sd.json_at(F.col("j"), "$.ids[-1]").alias("last"), sd.json_at(F.col("j"), "$.ids[0]").alias("first"), shape["count"].cast("long").alias("n"))


@query("template_render", "SELECT n_nationkey, 'Nation ' || n_name || ' in ' || CASE WHEN n_regionkey = 0 THEN 'nowhere' ELSE CAST(n_regionkey AS VARCHAR) END AS line FROM nation")
def template_render(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.lower("n_name"), F.lit("region"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", sd.render('Nation {{ name | upper }} in {{ region | default("nowhere") }}', values).alias("line"))


@query("schema_problems", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '$.k: not of type string' END AS problem FROM events")
def schema_problems(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.when(F.expr("event_id % 3 = 0"), F.lit('{"k": 1}')).otherwise(F.lit('{"k": "v"}'))
    return e.select("event_id", sd.schema_problem(doc, {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}}).alias("problem"))


@query(
    "schema_violations",
    """WITH j AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k < 20 THEN '/props/k: ' || k || ' is less than 20' WHEN k % 5 = 0 AND event_type = 'error' THEN '/props/k: ' || k || ' is valid under a schema that it must not match' WHEN event_type NOT IN ('view', 'click', 'error') THEN '/type: "' || event_type || '" is not one of ["view", "click", "error"]' END AS problem
FROM (SELECT event_id, event_type, k FROM j)""",
)
def schema_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit("}"))
    least = {"type": "integer", "minimum": 20}
    error = {"if": {"properties": {"type": {"const": "error"}, "props": {"properties": {"k": {"minimum": 20}}}}}, "then": {"properties": {"props": {"properties": {"k": {"not": {"multipleOf": 5}}}}}}}
    schema = {"$defs": {"least": least, "props": {"type": "object", "required": ["k"], "properties": {"k": {"$ref": "#/$defs/least"}}, "additionalProperties": False}}, "properties": {"props": {"$ref": "#/$defs/props"}}, "allOf": [error, {"properties": {"type": {"enum": ["view", "click", "error"]}}}]}
    problem = F.substring_index(schema_column(doc, schema), "; ", 1)
    return e.select("event_id", problem.alias("problem"))


@query(
    "template_tables",
    """SELECT conv_id, '# ' || conv_id || chr(10) || string_agg(CASE WHEN role = 'system' THEN '' ELSE '| ' || i || ' | ' || upper(role) || ' | ' || length(text) || CASE WHEN i = n THEN ' (last)' ELSE '' END || ' |' || chr(10) END, '' ORDER BY turn) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id""",
)
def template_tables(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("id"), turns.alias("turns"))).alias("params"))
    source = "# {{ id }}\n{% for t in turns %}{% if t.role == 'system' %}{% else %}| {{ loop.index }} | {{ t.role|upper }} | {{ t.text|length }}{% if loop.last %} (last){% endif %} |\n{% endif %}{% endfor %}"
    return c.select("conv_id", render_json(source, F.col("params")).alias("body"))


@query("terminal_filters", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(6 AS BIGINT) END AS at FROM events")
def terminal_filters(spark, sf_dir):
    command = F.when(F.expr("event_id % 2 = 0"), "cat x | grep y").otherwise("cat 'a | head' || true")
    return table(spark, sf_dir, "events").select("event_id", command.alias("c")).select("event_id", sd.terminal_filter_at("c").alias("at"))


@query("command_kinds", "SELECT event_type, CASE event_type WHEN 'error' THEN 'test' WHEN 'view' THEN 'build' ELSE 'generic' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def command_kinds(spark, sf_dir):
    c = F.expr("CASE event_type WHEN 'error' THEN 'cd x && cargo test -q' WHEN 'view' THEN 'make all' ELSE 'ls' END")
    return table(spark, sf_dir, "events").groupBy("event_type", to.command_kind(c).alias("kind")).agg(F.count("*").alias("n"))


@query("reference_kinds", "SELECT doc_id % 6 AS k, CASE doc_id % 6 WHEN 0 THEN 'file_line' WHEN 1 THEN 'file_symbol' WHEN 2 THEN 'path' WHEN 3 THEN 'module' WHEN 4 THEN 'link' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def reference_kinds(spark, sf_dir):
    ref = F.expr("CASE doc_id % 6 WHEN 0 THEN source || '/a.rs:' || doc_id WHEN 1 THEN source || '/a.rs::run' WHEN 2 THEN source || '/' || lang WHEN 3 THEN lang || '.' || source WHEN 4 THEN 'https://x.y/' || source ELSE 'word' END")
    return table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 6).alias("k"), dc.reference_kind(ref).alias("kind")).agg(F.count("*").alias("n"))


@query("first_paragraphs", "SELECT conv_id * 1000 + turn AS id, CASE WHEN length(s) <= 200 THEN s ELSE (CASE WHEN contains(h, ' ') AND 200 - position(' ' in reverse(h)) > 100 THEN substr(h, 1, 200 - position(' ' in reverse(h))) ELSE h END) || '…' END AS summary FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, substr(s, 1, 200) AS h FROM conversations) WHERE s != ''")
def first_paragraphs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("# Head\n```\nfenced\n```\n\n"), "text", F.lit("\n\nmore\n")).alias("text"))
    return dc.first_paragraph(c)


@query("config_keys", "SELECT source AS id, 's' || CAST(doc_id AS VARCHAR) AS key, 2 * row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line, 2 * row_number() OVER (PARTITION BY source ORDER BY doc_id) AS end_line FROM documents")
def config_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entry = F.concat(F.lit("[s"), F.col("doc_id").cast("string"), F.lit("]\nv = 1"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "\n")
    return dc.config_keys(d.groupBy(F.col("source").alias("id")).agg(body.alias("text")), "toml")


@query("file_summaries", "SELECT doc_id AS id, 'text' AS type, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INT) AS lines, string_split(text, chr(10))[1] AS first FROM documents")
def file_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("path"), "text")
    return dc.file_summary(d).select("id", "type", "lines", F.try_element_at("head", F.lit(1)).alias("first"))


@query("previews", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'plan' ELSE 'spec' END AS shape, CASE WHEN doc_id % 2 = 0 THEN '1/2' ELSE '# ' || source || ' | ## ' || lang END AS detail FROM documents")
def previews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.when(F.expr("doc_id % 2 = 0"), F.lit("- [x] a\n- [ ] b\n")).otherwise(F.concat(F.lit("# "), "source", F.lit("\nx\n## "), "lang", F.lit("\n")))
    return dc.preview(d.select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 2 = 0, 'plan', 'spec')").alias("kind"), text.alias("text")))


@query("lines_around", "SELECT doc_id AS id, 2 AS line, array_to_string(l[1:3], chr(10)) AS content FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents) WHERE len(l) >= 2")
def lines_around(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return to.around(d, d.select("id", F.lit(2).alias("line")), 1)


@query("section_resolve", "SELECT doc_id AS id, 3 AS line, 4 AS end_line, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS tier FROM documents")
def section_resolve(spark, sf_dir):
    text = F.concat(F.lit("# Top\nx\n## Set"), F.expr("if(doc_id % 2 = 0, '', 'up')"), F.lit("\ny\n## Other\n"))
    found = to.headings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))
    return to.resolve_section(found, "Set").select("id", "line", "end_line", "tier")


@query("failure_blocks", "SELECT doc_id AS id, 'failures:' || chr(10) || source || chr(10) || 'failures:' || chr(10) || lang AS block FROM documents")
def failure_blocks(spark, sf_dir):
    log = F.concat(F.lit("start\nfailures:\n"), "source", F.lit("\nfailures:\n"), "lang", F.lit("\ntest result: FAILED. 0 passed; 1 failed\nend"))
    return dc.failure_block(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), log.alias("text")))


@query("build_logs", "SELECT source AS id, count(*) FILTER (doc_id % 3 = 0) AS errors, count(*) FILTER (doc_id % 3 = 1) AS warnings, 'error: ' || CAST(min(doc_id) FILTER (doc_id % 3 = 0) AS VARCHAR) AS first_error FROM documents GROUP BY source")
def build_logs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN 'error: ' WHEN 1 THEN 'warning: ' ELSE 'note ' END"), F.col("doc_id").cast("string"), F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]), "\n")
    return to.build_log(d.groupBy(F.col("source").alias("id")).agg(body.alias("text")))


@query("tag_unions", "SELECT doc_id, list_sort(list_distinct([lang, source, 'x'])) AS tags FROM documents")
def tag_unions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(dc.tag_union(F.array("lang", "source"), F.array("source", F.lit("x")))).alias("tags"))


@query("anchor_merge", "SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 != 1")
def anchor_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    old = d.where("path % 3 = 0").withColumn("hash", F.lit("old"))
    return mm.merge_anchors(old, d.where("path % 3 = 2"), d.where("path % 2 = 0"))


@query("history_trim", "SELECT source AS id, count(*) AS dated FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 4 GROUP BY source")
def history_trim(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), (F.col("doc_id") + 1).alias("line"), F.lit("## 2024-01-01").alias("text"))
    kept = mm.trim_history(mm.append_history(s, "## 2024-02-01"), 5)
    return kept.where("text != '## 2024-02-01'").groupBy("id").agg(F.count("*").alias("dated"))


@query("memory_states", "SELECT source AS id, CASE WHEN bool_or(doc_id % 90 = 5) THEN 'stale' WHEN bool_or(doc_id % 2 = 0) THEN 'fresh' ELSE 'untracked' END AS state FROM documents GROUP BY source")
def memory_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return mm.memory_staleness(d.select(F.col("source").alias("id"), F.expr("CASE WHEN doc_id % 90 = 5 THEN 'changed' WHEN doc_id % 2 = 0 THEN 'fresh' END").alias("state")))


@query("memory_list", "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user' AND turn = 2 ORDER BY conv_id DESC, id LIMIT 20")
def memory_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("bucket"), F.array(F.struct(F.col("turn").cast("string").alias("path"))).alias("anchors"), F.col("conv_id").alias("updated_at"))
    return mm.listed(c, "user", "2", 20).select("id")


@query("library_versions", "SELECT p_partkey, p_size % 2 = 0 AND p_brand != p_type AS stale FROM part")
def library_versions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", mm.library_stale(F.col("p_size") % 2 == 0, F.col("p_brand"), F.col("p_type")).alias("stale"))


@query("commit_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS topo_order FROM orders")
def commit_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("position"))
    return mm.topo_order(o).select(F.col("hash").alias("o_orderkey"), "topo_order")


@query("suite_score", "SELECT CAST(sum(event_id % 4) AS BIGINT) AS score, median(value) AS p50, list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INT)] AS p95 FROM events")
def suite_score(spark, sf_dir):
    return rx.suite_score(table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("score"), F.col("value").alias("ms")))


@query("code_mode", "SELECT doc_id FROM documents WHERE doc_id % 5 != 0")
def code_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'markdown' WHEN doc_id % 5 = 1 THEN null ELSE 'rust' END").alias("language"))
    return rx.code_only(d, "code").select("doc_id")


@query("drift_report", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS added, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS deleted, 0 AS updated")
def drift_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rx.drift_report(d.where("doc_id % 4 = 0"), d.where("doc_id % 9 = 0"))


@query("directed_links", f"SELECT src, dst FROM {LINKS_SQL} WHERE rel = 'has' AND dst = 'n4'")
def directed_links(spark, sf_dir):
    return gr.directed(links(spark, sf_dir), "n4", "in", ["has"]).select("src", "dst")


@query("symbol_search", f"SELECT h.id FROM {SYMBOLS_SQL} h WHERE (name = 'ring' OR ends_with(name, ' ring')) AND NOT EXISTS (SELECT 1 FROM {SYMBOLS_SQL} o WHERE (o.name = 'ring' OR ends_with(o.name, ' ring')) AND o.kind IN ('function','method') AND o.file = h.file AND h.start_line >= o.start_line AND h.end_line <= o.end_line AND starts_with(h.name_path, o.name_path || '/'))")
def symbol_search(spark, sf_dir):
    return sy.search(symbols(spark, sf_dir), "ring").select("id")


@query("body_caps", f"SELECT id, n > 5 AS omitted FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM {SYMBOLS_SQL})")
def body_caps(spark, sf_dir):
    s = symbols(spark, sf_dir).withColumn("body", F.col("name"))
    return sy.capped_bodies(s, "id").select("id", "omitted")


@query("shared_file", f"SELECT CASE WHEN count(DISTINCT file) = 1 THEN min(file) END AS file FROM {SYMBOLS_SQL} UNION ALL SELECT 'src/one' FROM region WHERE r_regionkey = 0")
def shared_file(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return sy.hoisted_file(s).unionByName(sy.hoisted_file(s.withColumn("file", F.lit("src/one"))))


@query("priority_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def priority_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rank = od.fixed_order(d, "lang", ["fr", "de"])
    return od.top_per(d.withColumns({"priority": rank, "part": F.lit(0)}), ["part"], [F.col("priority"), F.col("doc_id")], 100, "place").select("doc_id", "place")


@query("stored_path_checks", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'relative' END AS problem FROM pages")
def stored_path_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rc.path_problems(F.expr("if(page_id % 2 = 0, 'a/', '/a/') || page_id")).alias("problem"))


@query("metric_thresholds", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value >= 50 WHEN 1 THEN value < 50 ELSE abs(value - 50) < 1e-15 END AS met FROM events")
def metric_thresholds(spark, sf_dir):
    op = F.expr("CASE event_id % 3 WHEN 0 THEN '>=' WHEN 1 THEN '<' ELSE '==' END")
    return table(spark, sf_dir, "events").select("event_id", sd.meets(F.col("value"), op, F.lit(50.0)).alias("met"))


@query("distance_scores", "SELECT event_id, round(1 / (1 + value), 9) AS score FROM events")
def distance_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(rx.similarity(F.col("value")), 9).alias("score"))

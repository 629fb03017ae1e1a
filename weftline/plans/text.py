"""Text queries over documents, conversations, pages and the JSON of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import text as to
from weftline.plans import query
from weftline.staging import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


LINES_SQL = "(SELECT id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content, len(l) AS n FROM (SELECT doc_id AS id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))"


@query("grep_matches", f"SELECT id, line, content FROM {LINES_SQL} WHERE regexp_matches(content, 'License|password|token')")
def grep_matches(spark, sf_dir):
    return to.grep(docs(spark, sf_dir), "License|password|token")


@query(
    "grep_context_islands",
    f"""WITH h AS (SELECT id, greatest(line - 2, 1) AS s, least(line + 2, n) AS e FROM {LINES_SQL} WHERE regexp_matches(content, 'tion\\.$|^The ')),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS o FROM h),
i AS (SELECT *, sum(o) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT id, min(s) AS start_line, max(e) AS end_line, count(*) AS matches FROM i GROUP BY id, isl""",
)
def grep_context_islands(spark, sf_dir):
    return to.grep_blocks(docs(spark, sf_dir), r"tion\.$|^The ", 2).drop("content")


@query(
    "heading_sections",
    f"""WITH t AS (SELECT id, line, n, CASE WHEN starts_with(content, 'The ') THEN '## ' || content WHEN starts_with(content, 'In ') THEN '# ' || content ELSE content END AS content FROM {LINES_SQL}),
h AS (SELECT id, line, n, content, len(regexp_extract(content, '^(#+)', 1)) AS level FROM t WHERE regexp_matches(content, '^#{{1,6}}\\s'))
SELECT id, line, level, content AS text, COALESCE((SELECT min(x.line) - 1 FROM h x WHERE x.id = h.id AND x.line > h.line AND x.level <= h.level), n) AS end_line FROM h""",
)
def heading_sections(spark, sf_dir):
    marked = F.regexp_replace(F.regexp_replace("text", "(?m)^The ", "## The "), "(?m)^In ", "# In ")
    return to.headings(docs(spark, sf_dir).withColumn("text", marked))


@query("line_counts", f"SELECT id, count(*) AS lines, CAST(sum(length(content)) AS BIGINT) AS chars FROM {LINES_SQL} GROUP BY id")
def line_counts(spark, sf_dir):
    return to.numbered_lines(docs(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


@query("chunk_lines")
def chunk_lines(spark, sf_dir):
    return to.chunk(docs(spark, sf_dir), 1200, 200)


@query("chunk_markdown")
def chunk_markdown(spark, sf_dir):
    return to.chunk(docs(spark, sf_dir), 1200, markdown=True)


LINES_SQL = "SELECT id, t, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS line FROM (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM (SELECT *, string_split(t, chr(10)) AS p FROM d))"
LOOSE_SQL = f"""l AS ({LINES_SQL}), f AS (SELECT *, regexp_replace(c, '^\\s+', '') AS s FROM l),
o AS (SELECT *, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) % 2 AS open FROM f),
h AS (SELECT id, line, length(regexp_extract(s, '^(#{{1,6}}) ', 1)) AS level, regexp_replace(substr(s, length(regexp_extract(s, '^(#{{1,6}}) ', 1)) + 2), '^\\s+|\\s+$', '', 'g') AS text FROM o WHERE open = 0 AND NOT starts_with(s, '```') AND regexp_matches(s, '^#{{1,6}} '))"""
#: Sentences as headings of changing levels, some of them indented, and a fence line for each comma.
OUTLINE_SQL = "SELECT doc_id AS id, replace(replace(text, '. ', chr(10) || repeat(' ', CAST(doc_id % 3 AS INT)) || repeat('#', CAST(doc_id % 8 AS INT)) || ' '), ', ', chr(10) || '```' || chr(10)) AS t FROM documents WHERE text IS NOT NULL"
#: Each word a line, those that begin with ba a heading.
WORDS_SQL = "SELECT doc_id AS id, replace(replace(text, ' ', chr(10)), chr(10) || 'ba', chr(10) || '# ba') AS t FROM documents WHERE text IS NOT NULL"


def outline(spark, sf_dir):
    d = docs(spark, sf_dir).where("text is not null")
    return d.select("id", F.expr("replace(replace(text, '. ', concat('\n', repeat(' ', cast(id % 3 as int)), repeat('#', cast(id % 8 as int)), ' ')), ', ', '\n```\n')").alias("text"))


@query("loose_headings", f"WITH d AS ({OUTLINE_SQL}), {LOOSE_SQL} SELECT * FROM h")
def loose_headings(spark, sf_dir):
    return to.loose_headings(outline(spark, sf_dir))


@query("soft_capped", f"WITH d AS ({WORDS_SQL}), {LOOSE_SQL}, k AS (SELECT id, string_agg(text, '|' ORDER BY line) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS nth FROM h WHERE level <= 2) WHERE nth <= 10 GROUP BY id), "
  "n AS (SELECT id, count(*) AS total, array_to_string((list(c ORDER BY line))[1:500], chr(10)) AS head FROM l GROUP BY id) "
  "SELECT d.id, CASE WHEN total > 500 THEN md5(head) ELSE md5(t) END AS text, CASE WHEN total > 500 THEN 500 END AS shown, CASE WHEN total > 500 THEN total END AS total, CASE WHEN total > 500 THEN coalesce(headings, '') END AS headings FROM d LEFT JOIN n ON d.id = n.id LEFT JOIN k ON d.id = k.id")  # fmt: skip
def soft_capped(spark, sf_dir):
    d = docs(spark, sf_dir).where("text is not null").select("id", F.expr("replace(replace(text, ' ', '\n'), '\nba', '\n# ba')").alias("text"))
    return to.soft_capped(d).select("id", F.md5("text").alias("text"), "shown", "total", F.array_join("headings", "|").alias("headings"))


@query("section_details")
def section_details(spark, sf_dir):
    return to.section_details(outline(spark, sf_dir), "a")


@query(
    "section_filter",
    f"""WITH d AS (SELECT doc_id AS id, regexp_replace(text, '(?m)^The ', '### The' || chr(10), 'g') AS t FROM documents), l AS ({LINES_SQL}),
s AS (SELECT *, CASE WHEN starts_with(c, '### ') THEN trim(substr(c, 5)) END AS title FROM l), r AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS section FROM s),
k AS (SELECT id, string_agg(c, chr(10) ORDER BY line) FILTER (section IS NULL OR lower(section) = 'the') AS kept, bool_or(coalesce(lower(section) = 'the', false)) AS matched, string_agg(title, '|' ORDER BY line) AS available FROM r GROUP BY id)
SELECT d.id, coalesce(kept, '') || CASE WHEN ends_with(t, chr(10)) THEN chr(10) ELSE '' END AS kept, coalesce(matched, false) AS matched, CASE WHEN coalesce(matched, false) THEN 'gone' ELSE 'the|gone' END AS missing, coalesce(available, '') AS available FROM d LEFT JOIN k ON d.id = k.id""",
)
def section_filter(spark, sf_dir):
    titled = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "(?m)^The ", "### The\n"))
    return to.filter_sections(titled, ["the", "gone"]).withColumns({c: F.array_join(c, "|") for c in ("missing", "available")})


@query(
    "inline_and_paths",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)_(.*?)_', '\\1', 'g'), '(?s)\\*(.*?)\\*', '\\1', 'g'), '\\s+', ' ', 'g')) AS plain, source || '/x' || doc_id AS below, CASE WHEN doc_id % 2 = 0 THEN 'a/' || source || '/' ELSE 'a/' END AS folder
FROM (SELECT doc_id, source, replace(replace(replace(replace(text, '`', ''), '*', ''), '_', ''), ' the ', ' *the* ') AS text FROM documents)""",
)
def inline_and_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    marked = F.expr("replace(replace(replace(replace(text, '`', ''), '*', ''), '_', ''), ' the ', ' **`the`** ')")
    below = tx.relative_path(F.concat(F.lit("/ws\\"), "source", F.lit("\\x"), F.col("doc_id").cast("string")), F.lit("/ws/"))
    paths = F.array(F.concat(F.lit("a/"), "source", F.lit("/x")), F.expr("if(doc_id % 2 = 0, concat('a/', source, '/y/z'), concat('a/', source, 'y'))"))
    return d.select("doc_id", tx.strip_inline(marked).alias("plain"), below.alias("below"), tx.common_folder(paths).alias("folder"))


@query("json_path_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("merge_patch", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind FROM events")
def merge_patch(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("target", F.from_json("props", "map<string,string>"))
    patch = F.create_map(F.lit("kind"), F.col("event_type"), F.when(F.expr("event_id % 2 = 0"), F.lit("k")).otherwise(F.lit("_")), F.lit(None).cast("string"))
    e = e.withColumn("m", to.merge_patch(F.col("target"), patch))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"))


@query(
    "url_ref_audit",
    """WITH known AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
refs AS (SELECT DISTINCT page_id AS id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT CASE WHEN k.path IS NULL THEN 'missing' ELSE 'resolved' END AS verdict, count(*) AS refs, count(DISTINCT id) AS pages FROM refs r LEFT JOIN known k ON r.target = k.path GROUP BY 1""",
)
def url_ref_audit(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    known = p.select(F.regexp_extract("url", "://[^/?#]*(/[^?#]*)", 1).alias("path")).distinct()
    refs = to.links(p.select(F.col("page_id").alias("id"), F.col("html").alias("text")))
    verdict = F.when(F.col("path").isNull(), "missing").otherwise("resolved")
    return refs.join(known, F.col("target") == F.col("path"), "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("refs"), F.count_distinct("id").alias("pages"))


@query("path_functions", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'html' AS is_html FROM pages")
def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.basename(F.col("url")).alias("base"), F.coalesce(tx.language_of(F.col("url")) == "html", F.lit(False)).alias("is_html"))


@query("whole_word", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])erer($|[^A-Za-z0-9_])')")
def whole_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(tx.whole_word(F.col("text"), "erer")).select("doc_id")

"""Code queries over sources that are made of the documents: every eight words are a method with docs, a text and a call.

Texts and comments hold words with brackets in them, which a reader of the source must not take for code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import code, syntax
from weftline.plans import query
from weftline.staging import table

OTHER = "[^A-Za-z0-9.,;:!?(){}\\[\\]]+"
WORDS = 8


def sources(spark, sf_dir):
    """(path, language, text): a file for each document, of its whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), OTHER, " "), " "), lambda w: w != "").alias("w"))
    n = F.ceil(F.size("w") / WORDS).cast("int")
    said = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("w", i * WORDS + 1, WORDS), " "))
    name = lambda i: F.concat(F.lit("s"), i.cast("string"))
    method = lambda x, i: F.concat(F.lit("    /// "), x, F.lit("\n    fn "), name(i), F.lit('() {\n        let t = "} '), x, F.lit('"; // { '), x, F.lit("\n        self."), name(i + 1), F.lit("();\n    }\n"))
    body = F.when(n > 0, F.array_join(F.transform(said, method), "")).otherwise("")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return d.select(path.alias("path"), F.lit("rust").alias("language"), F.concat(F.lit("impl D"), F.col("doc_id").cast("string"), F.lit(" {\n"), body, F.lit("}\n")).alias("text"))


SQL = f"""w AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '{OTHER}', ' ', 'g'), ' '), lambda x: x != '') AS w FROM documents),
d AS (SELECT 'doc/' || doc_id || '.rs' AS file, 'D' || doc_id AS owner, CAST(ceil(len(w) / {WORDS}) AS INTEGER) AS n, w FROM w),
f AS (SELECT *, CAST(i AS BIGINT) AS k, array_to_string(w[i * {WORDS} + 1:i * {WORDS} + {WORDS}], ' ') AS said FROM (SELECT *, unnest(range(n)) AS i FROM d WHERE n > 0))"""


@query(
    "code_chunks",
    f"""WITH {SQL} SELECT file AS path, CAST(1 AS BIGINT) AS start_line, CAST(CASE WHEN n = 0 THEN 2 ELSE 1 END AS BIGINT) AS end_line, 'impl ' || owner || ' {{' || CASE WHEN n = 0 THEN chr(10) || '}}' ELSE '' END AS content, file || ' :: impl ' || owner AS header FROM d
UNION ALL SELECT file, 2 + 5 * k, 6 + 5 * k, '    /// ' || said || chr(10) || '    fn s' || k || '() {{' || chr(10) || '        let t = "}} ' || said || '"; // {{ ' || said || chr(10) || '        self.s' || (k + 1) || '();' || chr(10) || '    }}', file || ' :: impl ' || owner || ' :: fn s' || k || '()' FROM f""",
)
def code_chunks(spark, sf_dir):
    return code.chunk_code(sources(spark, sf_dir), 1 << 20)


@query(
    "symbol_trees",
    f"""WITH {SQL} SELECT file, owner AS name, owner AS name_path, 'impl' AS kind, CAST(1 AS BIGINT) AS start_line, CAST(2 + 5 * n AS BIGINT) AS end_line, CAST(NULL AS VARCHAR) AS doc FROM d
UNION ALL SELECT file, 's' || k, owner || '/s' || k, 'fn', 3 + 5 * k, 6 + 5 * k, said FROM f""",
)
def symbol_trees(spark, sf_dir):
    found = syntax.symbols(syntax.parsed(sources(spark, sf_dir)))
    return found.select("file", "name", "name_path", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "doc")


@query(
    "call_edges",
    f"""WITH {SQL}, lone AS (SELECT k, min(file) AS lone_file, min(owner) AS lone_owner FROM f GROUP BY k HAVING count(*) = 1)
SELECT 's' || f.k AS caller, 's' || (f.k + 1) AS callee, f.file, 5 + 5 * f.k AS line, CASE WHEN f.k + 1 < n THEN f.file ELSE lone_file END AS callee_file, CASE WHEN f.k + 1 < n THEN owner ELSE lone_owner END || '/s' || (f.k + 1) AS callee_path,
  CASE WHEN f.k + 1 < n THEN 'file' WHEN lone_file IS NOT NULL THEN 'unique' END AS how FROM f LEFT JOIN lone ON f.k + 1 = lone.k""",
)
def call_edges(spark, sf_dir):
    return syntax.call_edges(syntax.parsed(sources(spark, sf_dir))).select("caller", "callee", "file", F.col("line").cast("long").alias("line"), "callee_file", "callee_path", "how")

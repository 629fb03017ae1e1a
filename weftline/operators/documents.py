"""Markdown and configuration files: frontmatter, titles, previews, checklists, references, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.sources.files import glob_regex

# The ordered default rules that give a path its kind, status and time scope.
PATH_RULES = (
    ("**/CHANGELOG.md", "doc", None, None),
    ("**/CONTRIBUTING.md", "doc", None, None),
    ("**/docs/ARCHITECTURE.md", "doc", None, None),
    ("**/docs/QUICK-START.md", "doc", None, None),
    ("**/docs/QUICKSTART.md", "doc", None, None),
    ("**/docs/concepts/**/*.md", "doc", None, None),
    ("**/docs/configuration/**/*.md", "doc", None, None),
    ("**/docs/experimental/**/*.md", "doc", None, None),
    ("**/docs/issues/**/*.md", "tracker", "active", None),
    ("**/docs/TODO-*.md", "tracker", "active", None),
    ("**/docs/TODO/*.md", "tracker", "active", None),
    ("**/docs/review-*.md", "memory", None, "dated_snapshot"),
    ("**/prompts/*.md", "doc", None, None),
    ("**/src/**/prompts/*.md", "doc", None, None),
    ("**/crates/**/prompts/*.md", "doc", None, None),
)


def classify_path(path: Column, rules: tuple = PATH_RULES) -> Column:
    """(kind, status, time_scope) of the first rule whose glob fits, null if none does."""
    out = F.lit(None).cast("struct<kind: string, status: string, time_scope: string>")
    for glob, kind, status, scope in reversed(rules):
        made = F.struct(F.lit(kind).alias("kind"), F.lit(status).cast("string").alias("status"), F.lit(scope).cast("string").alias("time_scope"))
        out = F.when(path.rlike(glob_regex(glob)), made).otherwise(out)
    return out


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(map of the plain ``key: value`` lines of a leading block between --- lines, the body after it).

    A text that opens no block, or none that is closed, has a null map and is its own body.
    """
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)(?:^|(?<=\n))---\r?(?:\n|$)", 1)
    has = text.rlike(r"(?s)^---\r?\n(?:.*?\n)?---\r?(?:\n|$)")
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("v")))
    return F.when(has, F.map_from_entries(entries)), F.when(has, F.regexp_replace(text, r"(?s)^---\r?\n(?:.*?\n)??---\r?(?:\n|$)", "")).otherwise(text)


def index_row(files: DataFrame) -> DataFrame:
    """(path, kind, status, title, confidence) of markdown files (path, text): frontmatter, then the path's rule, then defaults."""
    front, body = frontmatter(F.col("text"))
    rows = files.withColumns({"front": front, "body": body, "rule": classify_path(F.col("path"))})
    own = lambda k: F.try_element_at("front", F.lit(k))
    title = F.coalesce(own("title"), F.nullif(F.trim(F.regexp_extract("body", r"(?m)^# +(.+?)\s*$", 1)), F.lit("")), tx.basename(F.col("path")))
    return rows.select("path", F.coalesce(own("kind"), F.col("rule.kind"), F.lit("unknown")).alias("kind"), F.coalesce(own("status"), F.col("rule.status")).alias("status"), title.alias("title"), F.when(own("kind").isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


def unfenced(docs: DataFrame) -> DataFrame:
    """(id, line, content) of the lines of docs (id, text) outside fences; an unclosed fence reaches to the end."""
    rows = docs.select("id", F.posexplode(tx.lines(F.col("text"))).alias("pos", "content"))
    fence = F.ltrim("content").startswith("```").cast("int")
    opened = F.sum(fence).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"fence": fence, "open": opened % 2}).where("fence = 0 and open = 0").select("id", (F.col("pos") + 1).alias("line"), "content")


def first_paragraph(docs: DataFrame, most: int = 200) -> DataFrame:
    """(id, summary): the first lines of prose outside fences and after headings, white space folded, cut at a word."""
    rows = unfenced(docs).withColumn("t", F.trim("content"))
    plain = (F.col("t") != "") & tx.heading_level(F.col("t")).isNull()
    first = rows.groupBy("id").agg(F.min(F.when(plain, F.col("line"))).alias("first"))
    rows = rows.join(first, "id").where("line >= first")
    stop = rows.groupBy("id").agg(F.min(F.when(~plain, F.col("line"))).alias("stop"))
    kept = rows.join(stop, "id").where("stop is null or line < stop")
    text = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " "), r"\s+", " ")
    out = kept.groupBy("id").agg(text.alias("s"))
    head = F.substring("s", 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.contains(head, F.lit(" ")) & (space > most // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    return out.select("id", F.when(F.length("s") <= most, F.col("s")).otherwise(F.concat(cut, F.lit("…"))).alias("summary"))


def checklist(docs: DataFrame, open_next: int = 3) -> DataFrame:
    """(id, total, done, next): tasks of ``- [ ]`` and ``- [x]`` lines outside fences, and the first open ones."""
    rows = unfenced(docs).withColumn("mark", F.regexp_extract("content", r"^\s*- \[([^\]]*)\] ", 1)).where(F.col("content").rlike(r"^\s*- \[\s*[xX]?\s*\] "))
    done = F.lower(F.trim("mark")) == "x"
    task = F.when(~done, F.struct("line", F.regexp_replace("content", r"^\s*- \[[^\]]*\] ", "").alias("task")))
    out = rows.groupBy("id").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.array_sort(F.collect_list(task)).alias("o"))
    return out.select("id", "total", "done", F.transform(F.slice("o", 1, open_next), lambda x: x["task"]).alias("next"))


def config_keys(docs: DataFrame, kind: str) -> DataFrame:
    """(id, key, line, end_line): top sections of TOML or YAML texts; each ends before the next."""
    pattern = r"^\[+([^\]]+)\]+\s*$" if kind == "toml" else r"^([A-Za-z_][\w-]*):"
    rows = docs.select("id", tx.lines(F.col("text")).alias("l")).select("id", F.size("l").alias("n"), F.posexplode("l").alias("pos", "content"))
    heads = rows.withColumn("key", F.regexp_extract("content", pattern, 1)).where("key != ''")
    return heads.select("id", "key", (F.col("pos") + 1).alias("line"), F.coalesce(F.lead("pos").over(W.partitionBy("id").orderBy("pos")), "n").alias("end_line"))


def reference_kind(ref: Column) -> Column:
    """link, file_symbol, file_line, path, module or null: what a token in a text refers to."""
    path = r"[\w.@+-]*(?:/[\w.@+-]+)+|[\w@+-]+\.(?:rs|py|ts|tsx|js|go|java|kt|md|toml|json|yaml|yml|sh|html|css)"
    return (
        F.when(ref.rlike(r"^[a-z][a-z0-9+.-]*://"), "link")
        .when(ref.rlike(rf"^(?:{path})::?[A-Za-z_][\w/.]*$"), "file_symbol")
        .when(ref.rlike(rf"^(?:{path}):\d+(?:-\d+)?$"), "file_line")
        .when(ref.rlike(rf"^(?:{path})$"), "path")
        .when(ref.rlike(r"^[a-z0-9_]+(?:\.[a-z0-9_]+)+$"), "module")
    )


def resolve_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (id, ref) with a verdict: unknown (outside), resolved, resolved_basename, ambiguous_basename or missing."""
    known = files.select(F.col("path").alias("at"), F.lit(True).alias("there")).distinct()
    base = files.groupBy(tx.basename(F.col("path")).alias("name")).agg(F.count_distinct("path").alias("n"))
    bare = ~F.contains("ref", F.lit("/"))
    out = refs.join(known, F.col("ref") == F.col("at"), "left").join(base, bare & (F.col("ref") == F.col("name")), "left")
    verdict = F.when(F.col("ref").startswith("../") | F.col("ref").startswith("/"), "unknown").when(F.col("there"), "resolved").when(F.col("n") == 1, "resolved_basename").when(F.col("n") > 1, "ambiguous_basename").otherwise("missing")
    return out.select("id", "ref", verdict.alias("verdict"))


def tiered_read(docs: DataFrame) -> DataFrame:
    """(id, tier): full up to 150 lines, map for over 10 kB or 40 headings, else hint."""
    rows = docs.select("id", F.octet_length("text").alias("bytes"), tx.lines(F.col("text")).alias("l"))
    heads = F.size(F.filter("l", lambda x: tx.heading_level(x).isNotNull()))
    return rows.select("id", F.when((F.col("bytes") > 10_000) | (heads > 40), "map").when(F.size("l") > 150, "hint").otherwise("full").alias("tier"))


def truncated(docs: DataFrame, max_lines: int, max_bytes: int) -> DataFrame:
    """(id, shown, total, content): whole lines within both limits."""
    rows = docs.select("id", tx.lines(F.col("text")).alias("l")).select("id", F.size("l").alias("total"), F.posexplode("l").alias("pos", "content"))
    used = F.sum(F.octet_length("content") + F.when(F.col("pos") > 0, 1).otherwise(0)).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("used", used).withColumn("ok", (F.col("used") <= max_bytes) & (F.col("pos") < max_lines))
    return kept.groupBy("id").agg(F.count_if("ok").alias("shown"), F.first("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "content")))), lambda x: x["content"]), "\n").alias("content"))


def section_coverage(seen: DataFrame, headings: DataFrame) -> DataFrame:
    """(id, read, total, unread): which headings (id, text) of each file were read (id, text)."""
    done = seen.select("id", "text").distinct().withColumn("was_read", F.lit(True))
    rows = headings.join(done, ["id", "text"], "left")
    return rows.groupBy("id").agg(F.count("was_read").alias("read"), F.count("*").alias("total"), F.array_sort(F.collect_set(F.when(F.col("was_read").isNull(), F.col("text")))).alias("unread"))


def failure_block(docs: DataFrame) -> DataFrame:
    """(id, block): lines of a test log from its first ``failures:`` line to the result line after the second."""
    rows = docs.select("id", F.posexplode(tx.lines(F.col("text"))).alias("pos", "content"))
    seen = F.sum((F.trim("content") == "failures:").cast("int")).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("seen", seen).where("seen > 0")
    end = rows.groupBy("id").agg(F.min(F.when((F.col("seen") >= 2) & F.col("content").startswith("test result:"), F.col("pos"))).alias("end"))
    kept = rows.join(end, "id").where("end is null or pos < end")
    return kept.groupBy("id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")).alias("block"))


def file_type(path: Column) -> Column:
    """source, markdown, json, toml, yaml, config or text, by the name."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(md|markdown)$"), "markdown").when(p.endswith(".json"), "json").when(p.endswith(".toml"), "toml").when(p.rlike(r"\.ya?ml$"), "yaml")
        .when(p.rlike(r"\.(ini|cfg|conf|env|properties)$"), "config").when(tx.language_of(path).isNotNull(), "source").otherwise("text")
    )


def file_summary(files: DataFrame, head: int = 20, tail: int = 10) -> DataFrame:
    """(id, type, lines, keys, head, tail) of files (id, path, text): headings, keys or sections by type, first and last lines of the rest."""
    rows = files.select("id", file_type(F.col("path")).alias("type"), "text", tx.lines(F.col("text")).alias("l"))
    of = lambda pattern, group=1: F.filter(F.transform("l", lambda x: F.regexp_extract(x, pattern, group)), lambda k: k != "")
    keys = (
        F.when(F.col("type") == "markdown", F.filter("l", lambda x: tx.heading_level(x).isNotNull())).when(F.col("type") == "json", F.json_object_keys("text"))
        .when(F.col("type") == "toml", of(r"^\[+([^\]]+)\]+\s*$")).when(F.col("type") == "yaml", of(r"^([A-Za-z_][\w-]*):"))
    )
    plain = F.col("type").isin("text", "config", "source")
    last = F.slice("l", F.greatest(F.size("l") - tail, F.lit(head)) + 1, F.lit(tail))
    return rows.select("id", "type", F.size("l").alias("lines"), F.slice(keys, 1, 30).alias("keys"), F.when(plain, F.slice("l", 1, head)).alias("head"), F.when(plain & (F.size("l") > head), last).alias("tail"))


def preview(notes: DataFrame) -> DataFrame:
    """(id, shape, detail) of notes (id, kind, text): tasks of plans, headings of specs, else the first paragraph."""
    plans = checklist(notes.where("kind = 'plan'")).select("id", F.lit("plan").alias("shape"), F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("detail"))
    heads = F.array_join(F.slice(F.filter(tx.lines(F.col("text")), lambda x: tx.heading_level(x).isNotNull()), 1, 10), " | ")
    specs = notes.where("kind = 'spec'").select("id", F.lit("spec").alias("shape"), heads.alias("detail"))
    rest = first_paragraph(notes.where("kind is null or kind not in ('plan', 'spec')")).select("id", F.lit("summary").alias("shape"), F.col("summary").alias("detail"))
    return plans.unionByName(specs).unionByName(rest)


def tag_union(first: Column, second: Column) -> Column:
    """Tags of two lists, each once, those of the first ahead; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(first, none), F.coalesce(second, none))


def config_value(files: DataFrame, path: str, key: str) -> DataFrame:
    """(path, value) of a dotted key in a JSON, TOML or YAML file (path, text); paths that leave the root have none."""
    if path.startswith("/") or ".." in path.split("/"):
        return files.sparkSession.createDataFrame([], "path string, value string")
    section, _, leaf = key.rpartition(".")
    flat = rf"(?ms)^{leaf}\s*[:=]\s*(.*?)\s*$"
    nested = rf"(?ms)^(?:\[{section}\]\s*?$|{section}:\s*?$)(?:(?!^\[|^\S+:).)*?^\s*{leaf}\s*[:=]\s*([^\n]*?)\s*$"
    from weftline.functions.structured import json_at

    line = F.regexp_replace(F.regexp_extract("text", nested if section else flat, 1), r"^([\"'])(.*)\1$", "$2")
    return files.where(F.col("path") == path).select("path", F.when(F.col("path").endswith(".json"), json_at(F.col("text"), key)).otherwise(F.nullif(line, F.lit(""))).alias("value"))

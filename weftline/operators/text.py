"""Table-valued text operators: matches, context blocks, headings, sections, chunks, log summaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators.ordering import islands


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(id, line, content) of docs (id, text); lines count from 1."""
    return docs.select("id", F.posexplode(tx.lines(F.col("text"))).alias("pos", "content")).select("id", (F.col("pos") + 1).alias("line"), "content")


def _may_match(docs: DataFrame, pattern: str) -> DataFrame:
    """Docs whose whole text a pattern finds, so that the others need no splitting; all if it is tied to a text's ends."""
    return docs if re.search(r"\\[AzZG]", pattern) else docs.where(F.col("text").rlike(f"(?m){pattern}"))


def grep(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, line, content) of lines that a regular expression finds."""
    return numbered_lines(_may_match(docs, pattern)).where(F.col("content").rlike(pattern))


def grep_blocks(docs: DataFrame, pattern: str, context: int) -> DataFrame:
    """(id, start_line, end_line, matches, content): matches with ``context`` lines around, touching blocks merged."""
    lines = _may_match(docs, pattern).select("id", tx.lines(F.col("text")).alias("l"))
    hits = lines.select("id", F.size("l").alias("n"), F.posexplode("l").alias("pos", "content")).where(F.col("content").rlike(pattern))
    ranges = hits.select("id", F.greatest(F.col("pos") + 1 - context, F.lit(1)).alias("start_line"), F.least(F.col("pos") + 1 + context, F.col("n")).alias("end_line"))
    merged = islands(ranges, ["id"], "start_line", "end_line")
    return merged.join(lines, "id").select("id", "start_line", "end_line", F.col("ranges").alias("matches"), F.array_join(F.slice("l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"))


def headings(docs: DataFrame) -> DataFrame:
    """(id, line, level, text, end_line): headings outside fences, unless a text's fences do not pair; each ends before the next of its level or above."""
    per = W.partitionBy("id")
    rows = docs.select("id", tx.lines(F.col("text")).alias("l")).where(F.exists("l", lambda x: x.startswith("#")))
    rows = rows.select("id", F.size("l").alias("n"), F.posexplode("l").alias("pos", "content")).where(F.col("content").startswith("#") | F.col("content").startswith("```"))
    fence = F.col("content").startswith("```").cast("int")
    rows = rows.withColumn("fences", F.sum(fence).over(per)).withColumn("open", F.sum(fence).over(per.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) % 2)
    found = rows.withColumn("level", tx.heading_level(F.col("content"))).where(F.col("level").isNotNull() & ((F.col("fences") % 2 == 1) | (F.col("open") == 0)))
    later = per.orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    after = F.array(*[F.min(F.when(F.col("level") <= k, F.col("pos"))).over(later) for k in range(1, 7)])
    return found.withColumn("next", F.element_at(after, F.col("level"))).select("id", (F.col("pos") + 1).alias("line"), "level", F.col("content").alias("text"), F.coalesce("next", "n").alias("end_line"))


def resolve_section(found: DataFrame, wanted: str) -> DataFrame:
    """(id, line, end_line, tier, same): the heading that a name means: the raw line, its text, a start of it or a part, in that order."""
    bare = F.trim(F.regexp_replace("text", r"^#+\s*", ""))
    low = F.lit(wanted.lower())
    tier = F.when(F.col("text") == wanted, 1).when(bare == F.lit(wanted.lstrip("#").strip()), 2).when(F.lower(bare).startswith(low), 3).when(F.contains(F.lower(bare), low), 4)
    hits = found.withColumn("tier", tier).where("tier is not null")
    best = hits.groupBy("id").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["id", "tier"]).groupBy("id", "tier").agg(F.min_by(F.struct("line", "end_line"), "line").alias("s"), F.count("*").alias("same")).select("id", "s.line", "s.end_line", "tier", "same")


def section_details(docs: DataFrame, wanted: str) -> DataFrame:
    """(id, line, end_line, content, breadcrumb, siblings) of the section that a name means.

    The breadcrumb has the headings above it, outermost first, and its own; siblings are the other
    headings of its level. A text's headings are gathered, so they are held by one task at a time.
    """
    found = headings(docs)
    all_ = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "level", "text"))).alias("hs"))
    own = resolve_section(found, wanted).select("id", "line", "end_line")
    rows = docs.select("id", tx.lines(F.col("text")).alias("l")).join(own.join(all_, "id"), "id")
    this = F.element_at(F.filter("hs", lambda h: h["line"] == F.col("line")), 1)
    rows = rows.withColumn("level", this["level"]).withColumn("own", this["text"])
    climb = F.expr("""aggregate(reverse(filter(hs, h -> h.line <= line)), named_struct('level', level, 'path', cast(array() as array<string>)),
        (s, h) -> if(h.line = line or h.level < s.level, named_struct('level', h.level, 'path', array_prepend(s.path, h.text)), s), s -> s.path)""")
    siblings = F.transform(F.filter("hs", lambda h: (h["level"] == F.col("level")) & (h["text"] != F.col("own"))), lambda h: h["text"])
    content = F.array_join(F.slice("l", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    return rows.select("id", "line", "end_line", content.alias("content"), climb.alias("breadcrumb"), siblings.alias("siblings"))


def loose_headings(docs: DataFrame) -> DataFrame:
    """(id, line, level, text): headings as catalog bodies have them: spaces may stand before, each fence line
    turns fences on or off, and one to six # and a space begin the text."""
    start = F.regexp_replace("content", r"^\s+", "")
    rows = numbered_lines(docs).withColumn("s", start).where(F.col("s").startswith("#") | F.col("s").startswith("```"))
    fence = F.col("s").startswith("```")
    so_far = F.sum(fence.cast("int")).over(W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("open", so_far % 2).withColumn("marks", F.regexp_extract("s", "^(#{1,6}) ", 1)).where((F.col("open") == 0) & ~fence & (F.col("marks") != ""))
    return rows.select("id", "line", F.length("marks").alias("level"), F.regexp_replace(F.expr("substring(s, length(marks) + 2)"), r"^\s+|\s+$", "").alias("text"))


def loose_section(docs: DataFrame, wanted: str) -> DataFrame:
    """(id, line, content): the first section whose heading, without # and case, is the wanted one."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^\s*#*\s*|\s+$", ""))
    found = loose_headings(docs)
    first = found.where(plain(F.col("text")) == plain(F.lit(wanted))).groupBy("id").agg(F.min_by(F.struct("line", "level"), "line").alias("own"))
    after = found.join(first, "id").where("line > own.line and level <= own.level").groupBy("id").agg(F.min("line").alias("next"))
    rows = docs.select("id", tx.lines(F.col("text")).alias("l")).join(first, "id").join(after, "id", "left")
    last = F.coalesce(F.col("next") - 1, F.size("l"))
    return rows.select("id", F.col("own.line").alias("line"), F.array_join(F.slice("l", F.col("own.line"), last - F.col("own.line") + 1), "\n").alias("content"))


def soft_capped(docs: DataFrame, most: int = 500, top: int = 10) -> DataFrame:
    """(id, text, shown, total, headings): texts of more than ``most`` lines cut there, with their line counts and
    first headings of level 1 and 2; the others whole, with nulls."""
    sized = docs.select("id", "text", tx.lines(F.col("text")).alias("l")).withColumn("total", F.size("l"))
    heads = loose_headings(docs.join(sized.where(F.col("total") > most).select("id"), "id", "left_semi")).where("level <= 2")
    heads = heads.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("line"))).where(F.col("nth") <= top)
    heads = heads.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("headings"))
    over = F.col("total") > most
    out = sized.join(heads, "id", "left")
    cut = F.when(over, F.array_join(F.slice("l", 1, most), "\n")).otherwise(F.col("text"))
    return out.select("id", cut.alias("text"), F.when(over, F.lit(most)).alias("shown"), F.when(over, F.col("total")).alias("total"), F.when(over, F.coalesce("headings", F.array().cast("array<string>"))).alias("headings"))


def filter_sections(docs: DataFrame, names: list[str], mark: str = "### ") -> DataFrame:
    """(id, kept, matched, missing, available): a text's preamble and those sections below a mark whose heading
    is named, case of A-Z aside; the names that no heading has, and all headings in their order."""
    rows = numbered_lines(docs).withColumn("is_head", F.col("content").startswith(mark))
    w = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    title = F.trim(F.expr(f"substring(content, {len(mark) + 1})"))
    rows = rows.withColumn("title", F.when(F.col("is_head"), title)).withColumn("section", F.last("title", True).over(w))
    wanted = tx.ascii_lower(F.col("section")).isin([n.lower() if n.isascii() else n for n in names])
    held = F.col("section").isNull() | wanted
    gather = lambda keep, c: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line", F.col(c).alias("c"))))), lambda x: x["c"])
    out = rows.groupBy("id").agg(F.array_join(gather(held, "content"), "\n").alias("kept"), F.coalesce(F.bool_or(wanted), F.lit(False)).alias("matched"), gather(F.col("is_head"), "title").alias("available"))
    out = docs.select("id", F.endswith("text", F.lit("\n")).alias("ends")).join(out, "id", "left")
    asked = F.array(*[F.lit(n) for n in names])
    available = F.coalesce("available", F.array().cast("array<string>"))
    missing = F.filter(asked, lambda n: ~F.exists(available, lambda a: tx.ascii_lower(a) == tx.ascii_lower(n)))
    kept = F.concat(F.coalesce("kept", F.lit("")), F.when(F.col("ends"), "\n").otherwise(""))
    return out.select("id", kept.alias("kept"), F.coalesce("matched", F.lit(False)).alias("matched"), missing.alias("missing"), available.alias("available"))


HELD = 1 << 20  # characters of chunks that a task gathers before they leave it


def split_lines(source: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, content) of chunks of at most ``size`` UTF-8 bytes, a line at least.

    A chunk repeats the fewest last lines of the one before that come to ``overlap`` bytes, and moves on by
    a line at least. The chunk that reaches the end is the last.
    """
    lines = [x.removesuffix("\r") for x in source.split("\n")]
    if lines[-1] == "":
        lines.pop()
    cost = [len(x.encode()) + 1 for x in lines]
    out, start = [], 0
    while start < len(lines):
        end, used = start + 1, cost[start]
        while end < len(lines) and used + cost[end] <= size:
            used += cost[end]
            end += 1
        out.append((start + 1, end, "\n".join(lines[start:end])))
        if end == len(lines):
            break
        back = reached = 0
        while overlap and back < end - start and reached < overlap:
            back += 1
            reached += cost[end - back]
        start += max(1, end - start - back)
    return out


def split_markdown(source: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Chunks that start anew at headings of level 1 to 3; a section over ``size`` bytes is split by lines."""
    lines = source.split("\n")
    heads = [i for i, x in enumerate(lines) if x.startswith(("# ", "## ", "### "))]
    bounds = sorted({0, *heads, len(lines)})
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        body = "\n".join(lines[a:b])
        if not body.strip():
            continue
        if len(body.encode()) <= size:
            out.append((a + 1, b, body))
        else:
            out.extend((a + s, a + e, c) for s, e, c in split_lines(body, size, overlap))
    return out


def chunk(docs: DataFrame, size: int = 1200, overlap: int = 0, markdown: bool = False) -> DataFrame:
    """(id, start_line, end_line, content) chunks of docs (id, text); null and empty texts have none."""
    split = split_markdown if markdown else split_lines
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        for batch in batches:
            types, rows, held = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()], [], 0

            def packed(rows, types=types):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "start_line", "end_line", "content"])

            for key, text in zip(*batch.columns[:2], strict=True):  # scalars, so one text at a time leaves Arrow
                for c in split(t, size, overlap) if (t := text.as_py()) else ():
                    rows.append((key.as_py(), *c))
                    held += len(c[2])
                    if held >= HELD:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, start_line long, end_line long, content string")


def command_kind(command: Column) -> Column:
    """test, build or generic."""
    return F.when(command.rlike(r"\b(cargo test|pytest|npm test|go test|jest)\b"), "test").when(command.rlike(r"\b(cargo (build|check|clippy)|npm run build|make|go build|tsc)\b"), "build").otherwise("generic")


def test_log(docs: DataFrame) -> DataFrame:
    """(id, passed, failed, ignored) summed over the result lines of logs (id, text)."""
    line = r"(\d+) passed; (\d+) failed(?:; (\d+) ignored)?"
    rows = grep(docs, line)
    take = lambda i: F.sum(F.coalesce(F.expr(f"try_cast(regexp_extract(content, '{line.replace(chr(92), chr(92) * 2)}', {i}) as bigint)"), F.lit(0)))
    return rows.groupBy("id").agg(take(1).alias("passed"), take(2).alias("failed"), take(3).alias("ignored"))


def links(docs: DataFrame) -> DataFrame:
    """(id, target) of the links in documents (id, text): markdown targets and href values, each once."""
    found = F.array_union(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), 1), F.regexp_extract_all("text", F.lit(r'href="([^"]*)"'), 1))
    return docs.select("id", F.explode(F.array_distinct(found)).alias("target"))


def merge_patch(target: Column, patch: Column) -> Column:
    """A map with another's entries over it; a null in the patch takes the key away. Needs no recursion and keeps the target's order."""
    kept = F.map_filter(target, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda k, v: v.isNotNull()))


def build_log(docs: DataFrame) -> DataFrame:
    """(id, errors, warnings, first_error): diagnostics of build logs, and the first error up to a blank line or the next one."""
    error, warning = r"^error(\[[A-Z]\d+\])?:", r"^warning(\[.*\])?:"
    rows = numbered_lines(docs).withColumns({"is_error": F.col("content").rlike(error), "is_warning": F.col("content").rlike(warning)})
    w = W.partitionBy("id")
    rows = rows.withColumn("first", F.min(F.when(F.col("is_error"), F.col("line"))).over(w))
    stops = (F.col("line") > F.col("first")) & ((F.col("content") == "") | F.col("is_error") | F.col("is_warning"))
    rows = rows.withColumn("stop", F.min(F.when(stops, F.col("line"))).over(w))
    inside = (F.col("line") >= F.col("first")) & (F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("line", "content")))), lambda x: x["content"]), "\n")
    out = rows.groupBy("id").agg(F.count_if("is_error").alias("errors"), F.count_if("is_warning").alias("warnings"), F.nullif(block, F.lit("")).alias("first_error"))
    return out.where("errors + warnings > 0")


def around(docs: DataFrame, positions: DataFrame, context: int = 0) -> DataFrame:
    """(id, line, content): the lines of docs at positions (id, line), with some around them."""
    rows = docs.join(positions, "id").select("id", "line", tx.lines(F.col("text")).alias("l"))
    first = F.greatest(F.col("line") - context, F.lit(1))
    return rows.where(F.col("line").between(1, F.size("l"))).select("id", "line", F.array_join(F.slice("l", first, F.col("line") + context - first + 1), "\n").alias("content"))


def markdown_paths(text: Column) -> Column:
    """Paths of files that a markdown text names in code spans, each once in order, without line numbers."""
    found = F.regexp_extract_all(text, F.lit(r"`([\w.@/-]+/[\w.@-]+\.\w+|[\w@-]+\.(?:rs|py|ts|js|go|java|md|toml|json|ya?ml))(?::\d+(?:-\d+)?)?`"), 1)
    return F.array_distinct(found)

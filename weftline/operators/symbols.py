"""Symbols as flattened rows (name, name_path, kind, file, start_line, end_line): matching, search, overviews."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Symbol kinds that each kind filter admits; an unknown filter admits all.
KINDS = {
    "function": ("function", "method", "constructor"),
    "class": ("class",),
    "struct": ("struct",),
    "interface": ("interface",),
    "type": ("type_parameter",),
    "enum": ("enum", "enum_member"),
    "module": ("module", "namespace", "package"),
    "constant": ("constant",),
}
FUNCTIONS = KINDS["function"]
MOST_LIBRARIES = 10_000
BUILD_DIRS = ("target", "node_modules", "dist", "build", ".git", "__pycache__", "vendor")


def kind_matches(kind: Column, wanted: str) -> Column:
    return kind.isin(*KINDS[wanted]) if wanted in KINDS else F.lit(True)


def name_matches(query: str, name: Column, path: Column) -> Column:
    """Equal, or a start before ``<``, ``(`` or a space, or an end after a space, ``/`` or ``:``, backticks aside."""
    q = re.escape(query)
    each = lambda c: (c == query) | c.rlike(f"^{q}[<( ]") | c.rlike(f"[ /:]{q}$") | (F.replace(c, F.lit("`"), F.lit("")) == query.replace("`", ""))
    return F.coalesce(each(name), F.lit(False)) | F.coalesce(each(path), F.lit(False))


def regex_like(text: Column) -> Column:
    """Whether a query looks like a regular expression: alternatives, quantified dots, anchors, class ranges, escapes or groups."""
    alternatives = F.size(F.filter(F.split(text, r"\|", -1), lambda p: p != "")) >= 2
    inside = F.regexp_extract(text, r"^[^\[]*\[([^\]]*)\]", 1)
    return (F.contains(text, F.lit("|")) & alternatives) | text.rlike(r"\.[*+?]|^\^|\$$|\\[bwds]|\([^)]*\)") | (F.contains(inside, F.lit("-")) & (F.length(inside) > 2))


def search(symbols: DataFrame, query: str) -> DataFrame:
    """Matches; what lies in a matched function is left out, what lies in a matched container is not."""
    hits = symbols.where(name_matches(query, F.col("name"), F.col("name_path")))
    owners = hits.where(F.col("kind").isin(*FUNCTIONS)).select(F.col("file").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.col("name_path").alias("p"))
    within = (F.col("file") == F.col("f")) & (F.col("start_line") >= F.col("a")) & (F.col("end_line") <= F.col("b")) & F.col("name_path").startswith(F.concat(F.col("p"), F.lit("/")))
    return hits.join(owners, within, "left_anti")


def by_file(symbols: DataFrame, most: int = 15) -> DataFrame:
    """(file, n): files with the most rows first, ties by name."""
    return symbols.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(most)


def grouped_by_file(rows: DataFrame, position: str, item: str) -> DataFrame:
    """(file, n, items): each file's items by position."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(position, item))), lambda x: x[item])
    return rows.groupBy("file").agg(F.count("*").alias("n"), listed.alias("items"))


def at_position(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """Each position (file, line) with the narrowest symbol around it."""
    around = positions.join(symbols, "file").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    span = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "name_path")
    return around.groupBy("file", "line").agg(F.min(span)["name_path"].alias("name_path"))


def subdir_counts(paths: DataFrame, below: int) -> DataFrame:
    """(dir, files): files by their path component after the first ``below``; files right there count as ``.``."""
    parts = F.split("path", "/")
    name = F.when(F.size(parts) > below + 1, F.try_element_at(parts, F.lit(below + 1))).otherwise(".")
    return paths.groupBy(name.alias("dir")).agg(F.count("*").alias("files"))


def without_build_dirs(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows outside of build folders, one row with how many are inside)."""
    inside = F.col("file").rlike("(^|/)(" + "|".join(map(re.escape, BUILD_DIRS)) + ")/")
    return refs.where(~inside), refs.agg(F.count_if(inside).alias("excluded"))


def classify_library(paths: DataFrame, libraries: DataFrame) -> DataFrame:
    """Paths with the first registered library (root, name, position) that they lie in, else ``project``.

    Each path meets all roots, so there may be no more than ``MOST_LIBRARIES`` of them.
    """
    if libraries.limit(MOST_LIBRARIES + 1).count() > MOST_LIBRARIES:
        raise ValueError(f"more than {MOST_LIBRARIES} libraries")
    under = (F.col("path") == F.col("root")) | F.col("path").startswith(F.concat(F.col("root"), F.lit("/")))
    hits = paths.join(F.broadcast(libraries), under).groupBy("path").agg(F.min_by("name", "position").alias("library"))
    return paths.join(hits, "path", "left").withColumn("library", F.coalesce("library", F.lit("project")))


def capped_bodies(rows: DataFrame, order: str, most: int = 5) -> DataFrame:
    """Bodies of the first rows only, by a column without ties; the rest say that theirs is left out."""
    last = rows.select(order).orderBy(order).limit(most).agg(F.max(order).alias("_last"))
    return rows.join(F.broadcast(last)).withColumn("omitted", F.col(order) > F.col("_last")).withColumn("body", F.when(~F.col("omitted"), F.col("body"))).drop("_last")  # one row


def hoisted_file(rows: DataFrame) -> DataFrame:
    """One row (file): the file that all rows share, null if there are several."""
    return rows.agg(F.when(F.count_distinct("file") == 1, F.min("file")).alias("file"))


def missed_call_sites(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol, call_sites, refs, warn): whether a symbol has more call sites than references."""
    c, r = calls.groupBy("symbol").agg(F.count("*").alias("call_sites")), refs.groupBy("symbol").agg(F.count("*").alias("refs"))
    out = c.join(r, "symbol", "full").fillna(0, ["call_sites", "refs"])
    return out.withColumn("warn", F.col("call_sites") > F.col("refs"))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)

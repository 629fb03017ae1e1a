"""When values of configuration files were last changed, along the commits' parents."""

from __future__ import annotations

import json
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.staging import stage, unstage

LINE = re.compile(r"^(\s*)([\w.-]+)\s*:\s*(.*?)\s*$")


def _yaml(text: str) -> dict:
    """Nested keys with scalar values; other YAML is left out."""
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        m = LINE.match(line.split(" #")[0]) if not line.lstrip().startswith("#") else None
        if not m:
            continue
        while levels[-1][0] >= len(m[1]):
            levels.pop()
        value = m[3].strip("'\"")
        if m[3]:
            levels[-1][1][m[2]] = value
        else:
            levels[-1][1][m[2]] = {}
            levels.append((len(m[1]), levels[-1][1][m[2]]))
    return root


def _leaves(value: object, at: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict | list) and value:
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        return [x for k, v in pairs for x in _leaves(v, f"{at}.{k}" if at else str(k))]
    return [(at, value if isinstance(value, str) else json.dumps(value, default=str))] if at else []


def key_values(versions: DataFrame) -> DataFrame:
    """``(file, commit, key, value)``: the leaves of JSON, TOML and YAML files (file, commit, text), keys with dots between their parts.

    Which one it is, the file's suffix says. A text that doesn't parse, and a null one, has no keys.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for file, commit, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    read = json.loads if file.endswith(".json") else tomllib.loads if file.endswith(".toml") else _yaml if file.endswith((".yaml", ".yml")) else None
                    out += [(file, commit, k, v) for k, v in _leaves(read(text))] if read and text is not None else []
                except ValueError:
                    continue
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["file", "commit", "key", "value"])

    rows = versions.select(*[F.col(c).cast("string").alias(c) for c in ("file", "commit", "text")]).where("file is not null")
    return rows.mapInArrow(run, "file string, commit string, key string, value string")


def last_changes(commits: DataFrame, versions: DataFrame, values: DataFrame, heads: DataFrame) -> DataFrame:
    """``(file, key, value, commit, at)``: of every key that a file has ever had, its value at the head and the commit that made it so.

    commits has commit, parents (first parent first) and at; versions (file, commit) says at which commits there is a file,
    values (file, commit, key, value) what is in it, and heads (file, head) where to begin. From a commit the walk goes to the first parent with the
    same value and ends where there is none, so a merge is to blame only for what neither side had, and time doesn't
    matter. A key that is gone has a null value and the commit that took it out. All walks go on at once, twice as far in each round.
    """
    keys = values.select("file", "key").distinct()
    grid = versions.select("file", "commit").distinct().join(keys, "file").join(values, ["file", "commit", "key"], "left")
    grid = stage(grid.select("file", "key", "commit", "value"), "values")
    up = commits.select("commit", F.posexplode("parents").alias("place", "parent"))
    before = grid.select("file", "key", F.col("commit").alias("parent"), F.col("value").alias("old"))
    same = grid.join(up, "commit").join(before, ["file", "key", "parent"]).where(F.col("value").eqNullSafe(F.col("old")))
    first = same.groupBy("file", "key", "commit").agg(F.min_by("parent", "place").alias("to"))
    # Where the walk ends there is no row, so what changed at a commit is neither moved nor written again.
    walk = stage(first, "walks")
    while True:
        on = walk.select("file", "key", F.col("commit").alias("to"), F.col("to").alias("further"))
        new = stage(walk.join(on, ["file", "key", "to"], "left").select("file", "key", "commit", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "walks")
        moved = new.where("moved").limit(1).count()
        unstage(walk)
        walk = new.drop("moved")
        if not moved:
            break
    found = grid.join(heads.select("file", F.col("head").alias("commit")), ["file", "commit"]).join(walk, ["file", "key", "commit"], "left").withColumn("to", F.coalesce("to", "commit"))
    return found.select("file", "key", "value", F.col("to").alias("commit")).join(commits.select("commit", "at"), "commit", "left").select("file", "key", "value", "commit", "at")

"""Logs, previews, summaries, anchors, history, embedding hook."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import documents as dc
from weftline.operators import memory as mm
from weftline.operators import retrieval as rx
from weftline.operators import symbols as sy
from weftline.operators import text as to


def test_build_log(spark):
    log = "warning: unused\nerror[E0001]: bad\n  --> a.rs\n\nerror: two\nx"
    got = to.build_log(spark.createDataFrame([(1, log), (2, "fine"), (3, None)], "id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, "error[E0001]: bad\n  --> a.rs")]


def test_lines_around_and_paths(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd")], "id long, text string")
    at = spark.createDataFrame([(1, 2), (1, 4), (1, 9)], "id long, line int")
    assert {r.line: r.content for r in to.around(df, at, 1).collect()} == {2: "a\nb\nc", 4: "c\nd"}
    text = spark.createDataFrame([("see `src/a.rs:12`, `b.md` and `src/a.rs` not `word`",)], "t string")
    assert text.select(to.markdown_paths(F.col("t")).alias("p")).first().p == ["src/a.rs", "b.md"]


def test_file_summaries(spark):
    rows = [(1, "a.md", "# A\ntext\n## B\n"), (2, "x.json", '{"k": 1, "l": 2}'), (3, "c.toml", "[s]\nv = 1\n"), (4, "n.txt", "\n".join(str(i) for i in range(40))), (5, "y.yml", "k:\n  v: 1\n"), (6, "z.py", None)]
    got = {r.id: r for r in dc.file_summary(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert [got[i].type for i in range(1, 7)] == ["markdown", "json", "toml", "text", "yaml", "source"]
    assert got[1]["keys"] == ["# A", "## B"] and got[2]["keys"] == ["k", "l"] and got[3]["keys"] == ["s"] and got[5]["keys"] == ["k"]
    assert got[4]["head"] == [str(i) for i in range(20)] and got[4]["tail"] == [str(i) for i in range(30, 40)]


def test_previews_and_tags(spark):
    rows = [(1, "plan", "- [x] a\n- [ ] b\n"), (2, "spec", "# A\nx\n## B\n"), (3, None, "# H\nFirst.\n")]
    got = {r.id: (r["shape"], r.detail) for r in dc.preview(spark.createDataFrame(rows, "id long, kind string, text string")).collect()}
    assert got == {1: ("plan", "1/2"), 2: ("spec", "# A | ## B"), 3: ("summary", "First.")}
    tags = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["x"])], "p array<string>, q array<string>").coalesce(1)
    assert [r.t for r in tags.select(dc.tag_union(F.col("p"), F.col("q")).alias("t")).collect()] == [["a", "b", "c"], ["x"]]


@pytest.mark.parametrize(("path", "key", "want"), [("c.json", "a.b", "1"), ("c.toml", "s.v", "x"), ("c.yaml", "top", "5"), ("../c.json", "a", None), ("c.toml", "s.none", None)])
def test_config_values(spark, path, key, want):
    files = spark.createDataFrame([("c.json", '{"a": {"b": 1}}'), ("c.toml", 'n = 1\n[s]\nu = 2\nv = "x"\n[t]\nv = 3\n'), ("c.yaml", "top: 5\nmore: 6\n")], "path string, text string")
    row = dc.config_value(files, path, key).first()
    assert (row.value if row else None) == want


def test_memory(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    now = spark.createDataFrame([("a", "9"), ("c", "3")], "path string, hash string")
    assert sorted(tuple(r) for r in mm.merge_anchors(old, now.where("path = 'c'"), now).collect()) == [("a", "9"), ("c", "3")]
    s = spark.createDataFrame([(1, 1, "## 2024-01-02"), (1, 2, "## 2024-01-01"), (1, 3, "keep")], "id long, line int, text string")
    trimmed = mm.trim_history(mm.append_history(s, "## 2024-02-01"), 2)
    assert [r.text for r in trimmed.orderBy("line").collect()] == ["## 2024-02-01", "## 2024-01-02", "keep"]
    states = spark.createDataFrame([(1, "fresh"), (1, "deleted"), (2, "fresh"), (3, None)], "id long, state string")
    assert {r.id: r.state for r in mm.memory_staleness(states).collect()} == {1: "stale", 2: "fresh", 3: "untracked"}
    items = spark.createDataFrame([(1, "code", [("p",)], 5), (2, "code", [], 9)], "id long, bucket string, anchors array<struct<path:string>>, updated_at long")
    assert [r.id for r in mm.listed(items, "code").collect()] == [2, 1] and [r.id for r in mm.listed(items, anchor="p").collect()] == [1]
    c = spark.createDataFrame([("p", "x", 5), ("p", "y", 3)], "project string, hash string, position int")
    assert {r.hash: r.topo_order for r in mm.topo_order(c).collect()} == {"y": 0, "x": 1}


def test_embedding_hook_and_suite(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in mm.embed(rows, lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got[7] == [7.0, 1.0]
    with pytest.raises(Exception, match="one length"):
        mm.embed(rows, lambda texts: [[1] * len(t) for t in texts]).collect()
    cases = spark.createDataFrame([(3, float(i)) for i in range(1, 41)], "score long, ms double")
    assert tuple(rx.suite_score(cases).first()) == (120, 20.5, 38.0)


def test_symbol_rows(spark):
    s = spark.createDataFrame([(i, "f" if i < 9 else "g", f"b{i}") for i in range(8)], "n long, file string, body string")
    assert [r.body for r in sy.capped_bodies(s, "n").orderBy(F.col("body").asc_nulls_last()).collect()][5:] == [None] * 3
    assert sy.hoisted_file(s).first().file == "f" and sy.hoisted_file(s.unionByName(s.withColumn("file", F.lit("z")))).first().file is None
    names = [("Foo<T>", "m/Foo<T>"), ("Foobar", "Foobar"), ("run", "impl T for Foo/run"), ("`a b`", "x")]
    df = spark.createDataFrame(names, "name string, path string").coalesce(1)
    hit = lambda q: [r.h for r in df.select(sy.name_matches(q, F.col("name"), F.col("path")).alias("h")).collect()]
    assert hit("Foo") == [True, False, False, False] and hit("Foo/run") == [False, False, True, False] and hit("a b") == [False, False, False, True]
    likes = [("foo|bar", True), ("|x", False), ("a.*", True), ("^a", True), ("[A-Z]", True), ("[u8]", False), (r"\bx", True), ("f(x)", True), ("plain.rs", False)]
    got = spark.createDataFrame([(t,) for t, _ in likes], "t string").coalesce(1).select(sy.regex_like(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [w for _, w in likes]

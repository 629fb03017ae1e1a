"""JSON paths, schemas, templates, command pipes, code chunks."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftline.functions import structured as sd
from weftline.operators import code, symbols
from weftline.operators import documents as dc


@pytest.mark.parametrize(("path", "want"), [("$.a.b", "x"), ("a.c[0]", "1"), ("$.a.c[-1]", "3"), ("$.a.c[-2:]", "[2,3]"), ("$.d[-1].e", "z"), ("$.nope", None), ("$.d[5]", None), ("$.s[-1:]", '["q"]')])
def test_json_paths(spark, path, want):
    df = spark.createDataFrame([('{"a": {"b": "x", "c": [1, 2, 3]}, "d": [{"e": "y"}, {"e": "z"}], "s": ["p", "q"]}',)], "j string")
    assert df.select(sd.json_at(F.col("j"), path).alias("v")).first().v == want


def test_json_path_errors():
    for bad in ("$.a[x]", "$.a[1:2]", "$.a["):
        with pytest.raises(sd.JsonPathError):
            sd.segments(bad)


def test_json_shapes_and_outcomes(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ("[1]",), ('"x"',), ("3",), ("true",)], "j string").coalesce(1)
    got = [(r.s.type, r.s.count) for r in df.select(sd.json_shape(F.col("j")).alias("s")).collect()]
    assert [g[0] for g in got] == ["object", "array", "string", "number", "boolean"]
    rows = spark.createDataFrame([(True, "{}"), (False, '{"error": "x"}'), (False, '{"output_id": 1}'), (False, "text")], "e boolean, r string").coalesce(1)
    assert [tuple(r.o) for r in rows.select(sd.outcome(F.col("e"), F.col("r")).alias("o")).collect()] == [("error", False), ("recoverable_error", False), ("success", True), ("success", False)]
    call = spark.createDataFrame([('{"path": "p", "name": "", "symbol": "s"}',), ('{"query": "q"}',), ("{}",)], "c string").coalesce(1)
    assert [r.t for r in call.select(sd.friction_target(F.col("c")).alias("t")).collect()] == ["s", "q", None]


def test_uuid5_and_previews(spark):
    df = spark.createDataFrame([("p", "b", "t")], "p string, b string, t string")
    assert df.select(sd.uuid5(F.col("p"), F.col("b"), F.col("t")).alias("u")).first().u == str(uuid.uuid5(sd.MEMORY_NAMESPACE, "p\x1fb\x1ft"))
    lines = ["short \nmore", "x" * 51, "é" * 51, "a" + "é" * 51, "😀" * 51, "a" * 46 + "😀" * 10, "x" * 50]

    def plain(s):
        s = s.split("\n")[0].strip()
        return s if len(s) <= 50 else s.encode()[:47].decode(errors="ignore") + "..."

    got = spark.createDataFrame([(x,) for x in lines], "c string").coalesce(1).select(sd.first_line_preview(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [plain(x) for x in lines]


@pytest.mark.parametrize(("command", "at"), [("cat x | grep y", 6), ("a || grep", None), ("echo 'a | grep b'", None), ('echo "x \\" | head"', None), ("ls | sort | /usr/bin/wc -l", 10), ("ls | xargs rm", None), ("ls", None), ("a \\| grep", None)])
def test_terminal_filters(command, at):
    assert sd.terminal_filter(command) == at


def test_terminal_filter_column_schema_and_template(spark):
    df = spark.createDataFrame([("cat x | head", '{"n": 3}', {"name": "ada"}), ("ls", '{"n": "x"}', {}), (None, None, {"name": "", "k": "v"})], "c string, j string, m map<string,string>").coalesce(1)
    out = df.select(sd.terminal_filter_at("c").alias("t"), sd.schema_problem(F.col("j"), {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}).alias("p"), sd.render("Hi {{ name | upper }}/{{ k | default('-') }}!", F.col("m")).alias("r")).collect()
    assert [tuple(r) for r in out] == [(6, None, "Hi ADA/-!"), (None, "$.n: not of type integer", "Hi /-!"), (None, None, "Hi /v!")]
    assert sd.schema_errors([1, True], {"type": "array", "items": {"type": "integer", "minimum": 2}}) == ["$[0]: under the minimum", "$[1]: not of type integer"]


def test_thresholds(spark):
    rows = [(1.0, o, 1.0) for o in (">=", ">", "<=", "<", "==", "?")]
    df = spark.createDataFrame(rows, "v double, o string, t double").coalesce(1)
    assert [r.m for r in df.select(sd.meets(F.col("v"), F.col("o"), F.col("t")).alias("m")).collect()] == [True, False, True, False, True, None]


PYTHON = '''import os

# About f.
@cache
def f(x):
    return x


class C:
    """Docs."""

    def a(self):
        return 1

    # b's.
    def b(self):
        return 2

print(f(1))
'''


def test_code_chunks():
    got = code.split_code(PYTHON, "python", 400, "m.py")
    assert [(a, b, h) for a, b, _, h in got] == [(1, 1, "m.py"), (3, 6, "m.py :: @cache"), (9, 9, "m.py :: class C"), (10, 10, "m.py :: class C"), (12, 13, "m.py :: class C :: def a(self)"), (15, 17, "m.py :: class C :: def b(self)"), (18, 19, "m.py")]
    rust = "/// Doc.\nfn big() {\n" + "\n".join(f"    let x{i} = {i};" for i in range(60)) + "\n}\n"
    pieces = code.split_code(rust, "rust", 300)
    assert len(pieces) > 3 and all(c.startswith("/// Doc.\nfn big() {") for _, _, c, _ in pieces) and all("(continued)" in c for _, _, c, _ in pieces[1:])
    assert {i for a, b, _, _ in pieces for i in range(a, b + 1)} == set(range(3, 64))
    assert code.split_code("no code here\nat all", None, 100, "t") == [(1, 2, "no code here\nat all", "t")]
    assert all(len(c.encode()) <= 60 for *_, c, _ in code.enforce_size((1, 1, "é" * 100, ""), 60))


def test_token_budget_chunks():
    got = code.split_tokens("# A\nx\n" + "word\n" * 60 + "## B\nshort\n", 20)
    assert got[0].startswith("# A\nx\nword") and got[-1] == "## B\nshort" and all(len(x.encode()) <= 80 for x in got)
    assert "\n".join(got).split() == ["#", "A", "x", *["word"] * 60, "##", "B", "short"]
    words = code.split_tokens("w " * 100, 10)
    assert max(map(len, words)) <= 40 and " ".join(words).split() == ["w"] * 100


def test_outline_and_search(spark):
    files = spark.createDataFrame([("m.py", "python", PYTHON), ("e.py", "python", None)], "path string, language string, text string")
    rows = code.outline(files)
    assert sorted(r.name_path for r in rows.collect()) == ["C", "C/a", "C/b", "f"]
    s = rows.withColumn("kind", F.when(F.col("kind") == "def", "function").otherwise(F.col("kind")))
    assert [r.name_path for r in symbols.search(s, "a").collect()] == ["C/a"]
    assert code.chunk_code(files).count() == len(code.split_code(PYTHON, "python", 1200, "m.py"))


@pytest.mark.parametrize(("ref", "kind"), [("src/a.rs:12", "file_line"), ("src/a.rs:1-9", "file_line"), ("src/a.rs::run", "file_symbol"), ("a.py:main", "file_symbol"), ("src/x", "path"), ("a.md", "path"), ("os.path", "module"), ("https://x.y/z", "link"), ("word", None)])
def test_reference_kinds(spark, ref, kind):
    assert spark.createDataFrame([(ref,)], "r string").select(dc.reference_kind(F.col("r")).alias("k")).first().k == kind


def test_documents(spark):
    text = "---\nkind: spec\ntitle: 'A b'\n---\n# T\n\nFirst line\nof prose.\n\nmore\n"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, "---\nno: end\n"), (4, None)], "id long, text string")
    front, body = dc.frontmatter(F.col("text"))
    got = {r.id: (r.f, r.b) for r in df.select("id", front.alias("f"), body.alias("b")).collect()}
    assert got[1] == ({"kind": "spec", "title": "A b"}, "# T\n\nFirst line\nof prose.\n\nmore\n") and got[2] == (None, "plain") and got[3][0] is None and got[4] == (None, None)
    assert {r.id: r.summary for r in dc.first_paragraph(df.where("id = 2").unionByName(spark.createDataFrame([(9, "# H\n```\nx\n```\nFirst  line\nof prose.\n\nmore")], df.schema))).collect()} == {2: "plain", 9: "First line of prose."}
    toml = spark.createDataFrame([(1, "[a]\nx = 1\n\n[b.c]\ny = 2\n")], "id long, text string")
    assert sorted((r.key, r.line, r.end_line) for r in dc.config_keys(toml, "toml").collect()) == [("a", 1, 3), ("b.c", 4, 5)]
    log = "x\nfailures:\none\nfailures:\n  t\ntest result: FAILED\nend"
    assert dc.failure_block(spark.createDataFrame([(1, log)], "id long, text string")).first().block == "failures:\none\nfailures:\n  t"

"""Small cases by value, and plain models of the stateful operators."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.functions import text as tx
from weftline.operators import events as ev
from weftline.operators import filters as fx
from weftline.operators import graph as gr
from weftline.operators import joins as jn
from weftline.operators import ordering as od
from weftline.operators import reconcile as rc
from weftline.operators import retrieval as rx
from weftline.operators import text as to
from weftline.operators.telemetry import nearest_ranks
from weftline.sources import files


def col(df, name):
    return [r[name] for r in df.collect()]


FILTER_ROWS = [(1, "spec", "active", ["a", "b"], 5), (2, "Plan", None, ["c"], None), (3, None, "archived", None, 7), (4, "sp_c", "done", [], 5)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(FILTER_ROWS, "id long, kind string, status string, tags array<string>, n long")


@pytest.mark.parametrize(
    ("node", "sql", "eval_"),
    [
        ({"kind": {"eq": "spec"}}, [1], [1]),
        ({"status": {"ne": "active"}}, [3, 4], [2, 3, 4]),
        ({"not": {"status": {"eq": "active"}}}, [3, 4], [2, 3, 4]),
        ({"status": {"nin": ["active"]}}, [3, 4], [3, 4]),
        ({"tags": {"contains": "a"}}, [1], [1]),
        ({"kind": {"contains": "S_"}}, [1, 4], []),
        ({"kind": {"prefix": "SP"}}, [1, 4], []),
        ({"kind": {"prefix": "sp_"}}, [4], [4]),
        ({"n": {"gte": 6}}, [3], [3]),
        ({"n": {"eq": True}}, [], []),
        ({"or": [{"n": {"in": [7]}}, {"and": [{"kind": {"eq": "spec"}}, {"n": {"lt": 6}}]}]}, [1, 3], [1, 3]),
    ],
)
def test_filter_modes(table, node, sql, eval_):
    columns, kinds = {c: F.col(c) for c in table.columns}, dict(table.dtypes)
    for mode, want in (("sql", sql), ("eval", eval_)):
        assert sorted(col(table.where(fx.compile_filter(node, columns, kinds, mode)), "id")) == want, mode


@pytest.mark.parametrize("bad", [{}, {"and": []}, {"a": {"eq": 1}, "b": {"eq": 1}}, {"kind": {"eq": 1, "ne": 2}}, {"kind": {"like": "x"}}, {"kind": {"in": []}}, {"kind": {"eq": [1]}}, {"nope": {"eq": 1}}, {"kind": {"prefix": 3}}])
def test_filter_shapes_are_refused(bad):
    with pytest.raises(fx.FilterError):
        fx.compile_filter(bad, {"kind": F.lit("x")}, {"kind": "string"})


def test_missing_fields_and_rewrites():
    assert fx.find_filter({"status": {"eq": "x"}}) == {"status": {"eq": "x"}}
    hidden = fx.find_filter({"kind": {"eq": "a"}}, status=None)
    assert "status" in fx.fields(hidden) and fx.without_status(hidden) == {"kind": {"eq": "a"}}
    assert fx.find_filter(None, ["a"], ["b"]) == {"and": [{"kind": {"in": ["a"]}}, {"status": {"in": ["b"]}}]}


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in range(10, 101, 10)], "v long")
    df = df.withColumn("k", F.lit(1)).unionByName(spark.createDataFrame([(None, 2)], "v long, k int"))
    got = {r.k: r for r in nearest_ranks(df, "k", "v", {"a": 50, "b": 99, "c": 7, "d": 28, "e": 95}).collect()}
    assert tuple(got[1])[1:] == (50, 100, 10, 30, 100) and set(tuple(got[2])[1:]) == {None}


def test_fair_cap_matches_a_plain_round_robin(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(f"f{rng.randrange(5)}", i) for i in range(rng.randrange(5, 40))]
        budget = rng.randrange(1, 30)
        by = {}
        for f, i in rows:
            by.setdefault(f, []).append(i)
        order, picked = sorted(by.items(), key=lambda x: (-len(x[1]), x[0])), []
        turn = 0
        while len(picked) < min(budget, len(rows)):
            picked += [(f, x[turn]) for f, x in order if turn < len(x)]
            turn += 1
        got = od.fair_cap(spark.createDataFrame(rows, "f string, pos long"), "f", "pos", budget)
        assert sorted((r.f, r.pos) for r in got.collect()) == sorted(picked[: min(budget, len(rows))])


def test_islands_merge_touching_ranges(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("a", 2, 2), ("b", 1, 1)], "k string, s long, e long")
    assert sorted((r.k, r.s, r.e, r.ranges) for r in od.islands(df, ["k"], "s", "e").collect()) == [("a", 1, 6, 3), ("a", 8, 9, 1), ("b", 1, 1, 1)]


def test_bfs_caps_whole_levels(spark):
    calls = spark.createDataFrame([("root", f"a{i}") for i in range(5)] + [(f"a{i % 5}", f"b{i}") for i in range(50)], "caller string, callee string")
    edges, report = gr.call_bfs(calls, "root", depth=3, max_edges=20)
    assert edges.count() == 5 and report == {"truncated": True, "truncated_at_depth": 2, "max_depth": 1}
    edges, report = gr.call_bfs(calls, "root", depth=3, max_edges=200)
    assert edges.count() == 55 and not report["truncated"]


def test_link_chain_and_cycle(spark):
    links = spark.createDataFrame([("A", "B", "x"), ("B", "C", "x"), ("C", "D", "x"), ("B", "A", "y")], "src string, dst string, rel string")
    nodes, edges = gr.link_bfs(links, "A", 2)
    assert sorted(col(nodes, "id")) == ["A", "B", "C"] and edges.count() == 3
    assert gr.link_bfs(links, "A", 2, ["y"])[1].count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_knn_orders_and_scores(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.2]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r.id for r in rx.knn(v, q, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    many = spark.range(rx.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.col("id") % 2 * 1.0, F.lit(0.5)).alias("query"))
    got = rx.knn(v, many, 1).groupBy("id").count().collect()
    assert sum(r["count"] for r in got) == rx.MOST_QUERIES + 1 and {r.id for r in got} == {"b", "c"}


def test_bm25_with_more_words_than_are_collected(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(12))) for i in range(20)] + [(99, None)], "id long, text string")
    q = spark.createDataFrame([(1, "w1 w3 W5"), (2, "none")], "query_id long, text string")
    want = rx.bm25(docs, q, 5).collect()
    monkeypatch.setattr(rx, "MOST_TERMS", 1)
    assert sorted(want) == sorted(rx.bm25(docs, q, 5).collect()) and len(want) == 5


def test_numbers_follow_an_order_over_ranges(spark):
    from weftline.operators.ordering import numbered

    df = spark.createDataFrame([(x, x % 3) for x in random.Random(1).sample(range(5000), 5000)], "a long, b long").repartition(7)
    got = numbered(df, ["b", "a"]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.b, r.a) for r in got] == sorted((r.b, r.a) for r in got)


@pytest.mark.parametrize(("found", "expected", "score"), [("abcde", "a", 3), ("vwxyzab", "ab", 2), ("avwxyz", "ab", 2), ("vwxyza", "abc", 1), ("vwx", "ab", 0)])
def test_case_scores(spark, found, expected, score):
    df = spark.createDataFrame([(list(found), list(expected))], "f array<string>, e array<string>")
    assert df.select(rx.case_score(F.col("f"), F.col("e")).alias("s")).first().s == score


def test_line_chunks_match_a_plain_model():
    rng = random.Random(3)
    for _ in range(200):
        text = "\n".join("é" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 30)))
        size, overlap = rng.randrange(3, 40), rng.randrange(0, 20)
        chunks = to.split_lines(text, size, overlap)
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        assert {i for a, b, _ in chunks for i in range(a, b + 1)} == set(range(1, len(lines) + 1))
        for (a, b, c), nxt in zip(chunks, [*chunks[1:], None][: len(chunks)], strict=True):
            assert c == "\n".join(lines[a - 1 : b]) and (b == a or len(c.encode()) + 1 <= size)
            assert (nxt is None) == (b == len(lines)) and (nxt is None or a < nxt[0] <= b + 1)


def test_headings_and_fences(spark):
    text = "# A\n```\n# no\n```\n## B\nx\n# C\n"
    odd = "# A\n```\n## B"
    got = to.headings(spark.createDataFrame([(1, text), (2, odd), (3, None), (4, "")], "id long, text string"))
    assert sorted((r.id, r.line, r.level, r.end_line) for r in got.collect()) == [(1, 1, 1, 6), (1, 5, 2, 6), (1, 7, 1, 7), (2, 1, 1, 3), (2, 3, 2, 3)]
    hit = to.resolve_section(got, "b").where("id = 1").first()
    assert (hit.line, hit.tier, hit.same) == (5, 3, 1)


def test_grep_blocks(spark):
    text = "\n".join(["x"] * 3 + ["hit"] + ["x"] * 2 + ["hit"] + ["x"] * 9 + ["hit"])
    got = to.grep_blocks(spark.createDataFrame([(1, text)], "id long, text string"), "hit", 1).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.matches) for r in got] == [(3, 8, 2), (16, 17, 1)]


def test_timeline_applies_since_after_the_limit(spark):
    e = spark.createDataFrame([(i, 1, "note", "{}", i) for i in range(10)], "id long, artifact_id long, kind string, payload string, created_at long")
    assert col(ev.timeline(e, 1, limit=3, since=8), "id") == [9, 8]


def test_state_seeds_from_the_present(spark):
    art = spark.createDataFrame([(1, "now", 5), (2, "now", 5), (3, "now", 0)], "id long, status string, file_mtime long")
    log = [(1, 1, "status_change", '{"to": "x"}', 3), (2, 1, "status_change", '{"to": "late"}', 9), (3, 3, "reviewed", "{}", 2), (4, 2, "reviewed", "{}", 4), (5, 2, "superseded_by", '{"target_artifact_id": "9"}', 8)]
    e = spark.createDataFrame(log, "id long, artifact_id long, kind string, payload string, created_at long")
    got = {r.id: (r.status_as_of, r.freshness) for r in ev.state_at(art, e, F.lit(5)).collect()}
    assert got == {1: ("x", "unknown"), 2: ("now", "stale"), 3: ("now", "fresh")}
    assert {r.id: r.freshness for r in ev.state_at(art, e, F.lit(99)).collect()}[2] == "superseded"


def test_scalar_functions(spark):
    df = spark.createDataFrame([("symbol not found and AST parse failed", "prefer a struct")], "m string, t string")
    r = df.select(tx.error_family(F.col("m")).alias("f"), tx.classify_bucket(F.col("t")).alias("b"), tx.strip_ansi(F.lit("\u001b[31mred\u001b[0m")).alias("a"), tx.slugify(F.lit("Hello, World's 2_x!")).alias("s"), F.size(tx.lines(F.lit("a\r\nb\n"))).alias("n")).first()
    assert (r.f, r.b, r.a, r.s, r.n) == ("ast_extent_fail", "preferences", "red", "hello-worlds-2_x", 2)


def test_merge_and_diff(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id long, created long, v string")
    new = spark.createDataFrame([(2, 99, None), (3, 30, "c")], "id long, created long, v string")
    assert sorted(tuple(r) for r in jn.merge_keyed(old, new, ["id"], ["created"]).collect()) == [(1, 10, "a"), (2, 20, None), (3, 30, "c")]
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, hash string")
    b = spark.createDataFrame([("x", "9"), ("w", "2"), ("q", "7")], "path string, hash string")
    assert sorted((r.path, r.change) for r in jn.diff_snapshots(a, b).collect()) == [("q", "added"), ("w", "renamed"), ("x", "modified"), ("z", "deleted")]


def test_goal_children(spark):
    rows = [("task_list", '{"tasks": []}'), ("task_list", '{"tasks": [{"status": "done"}]}'), ("failure_table", '{"failures": [{"status": "flaky"}]}'), ("audit_issues", "{}"), ("deployment_state", '{"envs": {"p": {"enabled": true}}}'), ("reflective", '{"status": "deferred"}'), ("goal", '{"status": "scoping"}'), ("other", "{}")]
    df = spark.createDataFrame(rows, "a string, p string").coalesce(1)
    assert col(df.select(rc.child_status(F.col("a"), F.col("p")).alias("s")), "s") == ["pending", "done", "active", "unknown", "done", "blocked", "pending", "unknown"]


def test_workspace_files(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/a.rs").write_text("fn x() {}")
    (tmp_path / "src/deep/b.py").write_text("x = 1")
    (tmp_path / "src/note.xyz").write_text("-")
    (tmp_path / "README.md").write_text("# Hi")
    got = files.walk_sources(spark, str(tmp_path), ignore=("src/deep/**",))
    assert sorted((r.path, r.language) for r in got.collect()) == [("README.md", "markdown"), ("src/a.rs", "rust")]
    paths = spark.createDataFrame([("src/a.rs",), ("src/deep/b.py",), ("lib/c.py",)], "path string")
    assert col(files.glob_search(paths, "src/**/*.py"), "path") == ["src/deep/b.py"]
    assert col(files.listing(paths, 1), "path") == ["lib", "src"]
    near = files.nearest_manifest(paths, spark.createDataFrame([("Cargo.toml",), ("src/deep/pyproject.toml",)], "path string"))
    assert {r.path: r.ecosystem for r in near.collect()} == {"src/a.rs": "rust", "src/deep/b.py": "python", "lib/c.py": "rust"}
    lock = spark.createDataFrame([("Cargo.lock", 'name = "serde"\nversion = "1.0"\n'), ("package-lock.json", '{"packages": {"": {}, "node_modules/x": {"version": "2"}}}')], "path string, content string")
    assert sorted((r.package, r.version) for r in files.locked_versions(lock).collect()) == [("serde", "1.0"), ("x", "2")]


def test_loose_sections_and_soft_cap(spark):
    from weftline.operators import text as to

    body = "intro\n  # Top\n```\n# no\n```\n## Sub ##\nx\n####### seven\n#none\n# Next\nend"
    df = spark.createDataFrame([(1, body), (2, "\n".join(f"## h{i}" if i % 40 == 0 else "x" for i in range(600))), (3, "")], "id long, text string")
    assert [tuple(r)[1:] for r in to.loose_headings(df.where("id = 1")).orderBy("line").collect()] == [(2, 1, "Top"), (6, 2, "Sub ##"), (10, 1, "Next")]
    assert [tuple(r) for r in to.loose_section(df, " # TOP").collect()] == [(1, 2, "  # Top\n```\n# no\n```\n## Sub ##\nx\n####### seven\n#none")]
    capped = {r.id: r for r in to.soft_capped(df).collect()}
    assert capped[1].text == body and capped[1].shown is None and capped[3].text == ""
    assert (capped[2].shown, capped[2].total, capped[2].headings) == (500, 600, [f"h{i}" for i in range(0, 400, 40)]) and capped[2].text.count("\n") == 499


def test_section_details_and_filter(spark):
    from weftline.operators import text as to

    body = "# A\n## B\nb\n### C\nc\n### D\nd\n## E\ne"
    df = spark.createDataFrame([(1, body)], "id long, text string")
    r = to.section_details(df, "D").first()
    assert (r.line, r.content, r.breadcrumb, r.siblings) == (6, "### D\nd", ["# A", "## B", "### D"], ["### C"])
    df = spark.createDataFrame([(1, "pre\n### One \na\n### TWO\nb\n"), (2, ""), (3, "only\npre")], "id long, text string")
    got = {r.id: tuple(r)[1:] for r in to.filter_sections(df, ["two", "Gone"]).collect()}
    assert got == {1: ("pre\n### TWO\nb\n", True, ["Gone"], ["One", "TWO"]), 2: ("", False, ["two", "Gone"], []), 3: ("only\npre", False, ["two", "Gone"], [])}


def test_inline_marks_and_folders(spark):
    from weftline.functions import text as tx

    df = spark.createDataFrame([("***a*** `b` __c__ _d_  e*", ["a/b/c", "a/b"], "a\\b\\c"), ("x", ["a/b/c"], "ab/c"), (None, [], "a/b"), ("`", ["q", "r"], "a/b/")], "t string, p array<string>, x string")
    got = df.select(tx.strip_inline(F.col("t")), tx.common_folder(F.col("p")), tx.relative_path(F.col("x"), F.lit("a/b"))).collect()
    assert [tuple(r) for r in got] == [("a b c d e*", "a/", "c"), ("x", "a/b/", "ab/c"), (None, "", ""), ("`", "", "")]


def test_ignore_files_are_read(spark, tmp_path):
    from weftline.sources.files import walk_sources

    for name, text in {".gitignore": "# c\n*.log.py\n/build/\n!keep.log.py\n", "a.py": "1", "b.log.py": "2", "keep.log.py": "3", "build/c.py": "4", "sub/.gitignore": "d.py\nx/*.py\n", "sub/d.py": "5", "sub/e.py": "6", "sub/x/f.py": "7", "sub/x/y/g.py": "8", "d.py": "9", "sub/build/h.py": "10"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.path for r in walk_sources(spark, str(tmp_path)).select("path").collect()} == {"a.py", "keep.log.py", "d.py", "sub/e.py", "sub/x/y/g.py", "sub/build/h.py"}


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    from weftline.operators import text as to

    class Rows:  # what mapInArrow is given
        dtypes = [("id", "bigint")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"line {i}\n" * 2000 if i % 3 else None for i in range(300)])], names=["id", "text"])
            return list(run(iter([batch])))

    got = to.chunk(Rows(), 1200)
    assert max(b.nbytes for b in got) < 2 << 20
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(i, *c) for i in range(300) if i % 3 for c in to.split_lines(f"line {i}\n" * 2000, 1200, 0)]

"""Syntax trees, chunks by declarations, docstrings and call edges, against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import code, graph, syntax

RUST = '''//! Crate docs.
use crate::store::{Store, open as open_store};

/// A "quoted { brace".
#[derive(Debug)]
pub struct Point<'a> {
    name: &'a str,
}

impl<'a> Point<'a> {
    const ZERO: i32 = 0;

    /// Makes one.
    pub fn new(name: &'a str) -> Self {
        let raw = r#"} fn fake() { "#; // } not code {
        let c = '{'; /* { /* nested } */ */
        helper::<i32>(name.len());
        Point { name }
    }

    fn shown(&self) -> String {
        self.new2();
        format!("{}", "\\"}")
    }
}

fn helper<T>(n: usize) -> usize {
    fn inner() { open_store(); }
    inner();
    helper::<T>(n - 1)
}
'''
JAVA = '''import a.b.Helper;

/** Docs {. */
@Entity(name = "x")
public class Shop extends Base {
    private final Map<String, List<Integer>> m = new HashMap<>();

    /**
     * Makes a shop.
     */
    public Shop(int n) {
        super(n);
    }

    @Override
    public <T> List<T> items(String s) throws E {
        if (s.equals("}{")) { return Helper.make(s); }
        char c = '}';
        return lookup(s, () -> { run(); });
    }

    static class Deep { void low() { items("a"); } }
}
'''
SCRIPT = '''import { make as build, other } from "./lib/tools";
import plain from './plain';

// Says hello.
export function hello(name) {
  const t = `}{ ${build(`a ${name} {`)} `;
  return name.replace(/[{"]/g, "").trim();
}

export class Box {
  size = 3
  constructor(x) { this.x = x; }
  grow(by) {
    if (by) { this.grow(by - 1); }
    return plain(by) || hello(by);
  }
}
hello("x")
'''
GO = '''package main

// Area says how large.
func (s *Square) Area() int {
	x := `} raw {`
	return mul(s.n, s.n) + len(x)
}

type Square struct {
	n int
}

func mul(a, b int) int { return a * b }
'''
KOTLIN = '''package x

/** Holds. */
data class Holder(val n: Int) {
    fun twice(): Int = times(2)
    private fun times(k: Int): Int {
        return n * k
    }
    companion object { fun make() = Holder(1) }
}

fun top() = Holder.make()
'''
PYTHON = '''"""Module."""
from pkg.tools import make as build
import pkg.tools


@cache
def outer(x):
    """Outer docs."""
    def inner():
        return build(x)
    return inner()


class A:
    """A docs."""

    def go(self):
        self.stop()
        pkg.tools.make("def fake(): {")

    async def stop(self):
        await outer(1)


outer(A())
'''


def shape(source, language):
    tree = syntax.parse(source, language)
    names = syntax.name_paths(tree.nodes)
    return [(n.kind, p, n.first + 1, n.last + 1) for n, p in zip(tree.nodes, names, strict=True)]


def called(source, language):
    tree = syntax.parse(source, language)
    names = syntax.name_paths(tree.nodes)
    return [(names[f] if (f := syntax.enclosing(tree.nodes, p)) >= 0 else "", on, name, line + 1) for p, name, on, line, _ in tree.calls]


def test_rust():
    got = shape(RUST, "rust")
    assert [(k, p) for k, p, _, _ in got] == [("struct", "Point"), ("impl", "Point"), ("const", "Point/ZERO"), ("fn", "Point/new"), ("fn", "Point/shown"), ("fn", "helper"), ("fn", "helper/inner")]
    assert [(a, b) for _, _, a, b in got] == [(6, 8), (10, 25), (11, 11), (14, 19), (21, 24), (27, 31), (28, 28)]
    assert called(RUST, "rust") == [("Point/new", None, "helper", 17), ("Point/new", "name", "len", 17), ("Point/shown", "self", "new2", 22), ("helper/inner", None, "open_store", 28), ("helper", None, "inner", 29), ("helper", None, "helper", 30)]
    tree = syntax.parse(RUST, "rust")
    assert [n.doc for n in tree.nodes] == ['A "quoted { brace".', None, None, "Makes one.", None, None, None]
    assert sorted(tree.imports) == [("Store", "store", "Store"), ("open_store", "store", "open")]


def test_java():
    assert [(a, b) for _, _, a, b in shape(JAVA, "java")] == [(4, 23), (11, 13), (15, 20), (22, 22), (22, 22)]
    assert [(k, p) for k, p, _, _ in shape(JAVA, "java")] == [("class", "Shop"), ("constructor", "Shop/Shop"), ("method", "Shop/items"), ("class", "Shop/Deep"), ("method", "Shop/Deep/low")]
    assert {(s, n) for s, _, n, _ in called(JAVA, "java")} >= {("Shop/items", "equals"), ("Shop/items", "make"), ("Shop/items", "lookup"), ("Shop/items", "run"), ("Shop/Deep/low", "items")}
    assert not {n for _, _, n, _ in called(JAVA, "java")} & {"Entity", "Shop", "if"}
    assert syntax.parse(JAVA, "java").nodes[1].doc == "Makes a shop." and syntax.parse(JAVA, "java").imports == [("Helper", "a.b", "Helper")]


def test_script():
    assert shape(SCRIPT, "javascript") == [("function", "hello", 5, 8), ("class", "Box", 10, 17), ("constructor", "Box/constructor", 12, 12), ("method", "Box/grow", 13, 16)]
    assert called(SCRIPT, "javascript") == [("hello", "name", "replace", 7), ("hello", "", "trim", 7), ("Box/grow", "this", "grow", 14), ("Box/grow", None, "plain", 15), ("Box/grow", None, "hello", 15), ("", None, "hello", 18)]
    assert syntax.parse(SCRIPT, "javascript").imports == [("build", "lib/tools", "make"), ("other", "lib/tools", "other"), ("plain", "plain", None)]


def test_go_and_kotlin():
    assert shape(GO, "go") == [("func", "Area", 4, 7), ("type", "Square", 9, 11), ("func", "mul", 13, 13)]
    assert called(GO, "go") == [("Area", None, "mul", 6), ("Area", None, "len", 6)]
    assert syntax.parse(GO, "go").nodes[0].doc == "Area says how large."
    assert shape(KOTLIN, "kotlin") == [("class", "Holder", 4, 10), ("fun", "Holder/twice", 5, 5), ("fun", "Holder/times", 6, 8), ("object", "Holder/", 9, 9), ("fun", "Holder//make", 9, 9), ("fun", "top", 12, 12)]
    assert ("top", "Holder", "make", 12) in called(KOTLIN, "kotlin")


def test_python():
    assert shape(PYTHON, "python") == [("def", "outer", 6, 11), ("def", "outer/inner", 9, 10), ("class", "A", 14, 22), ("def", "A/go", 17, 19), ("async def", "A/stop", 21, 22)]
    assert called(PYTHON, "python") == [("outer/inner", None, "build", 10), ("outer", None, "inner", 11), ("A/go", "self", "stop", 18), ("A/go", "", "make", 19), ("A/stop", None, "outer", 22), ("", None, "outer", 25), ("", None, "A", 25)]


@pytest.mark.parametrize("source", ["fn f() {", "fn f() }", 'let s = "open', "/* open", "r#\"open", "(]"])
def test_what_does_not_parse(source):
    assert syntax.parse(source, "rust") is None and code.split_code(source, "rust", 100, "p") == [(1, 1, source, "p")]


def test_not_a_known_language_and_deep_brackets():
    assert syntax.parse("x", None) is None and syntax.parse("x", "cobol") is None
    assert syntax.parse("{" * 100_000 + "}" * 100_000, "rust") is None and syntax.parse("(" * 5000 + ")" * 5000, "python") is None
    assert syntax.parse("", "rust").nodes == [] and syntax.parse("def f(:", "python") is None


def test_chunks_of_a_container():
    got = [(a, b, h) for a, b, _, h in code.split_code(RUST, "rust", 400, "s.rs")]
    assert got == [
        (1, 2, "s.rs"), (4, 8, "s.rs :: pub struct Point<'a>"), (10, 10, "s.rs :: impl<'a> Point<'a>"), (11, 11, "s.rs :: impl<'a> Point<'a> :: const ZERO: i32 = 0;"),
        (13, 19, "s.rs :: impl<'a> Point<'a> :: pub fn new(name: &'a str) -> Self"), (21, 24, "s.rs :: impl<'a> Point<'a> :: fn shown(&self) -> String"),
        (27, 27, "s.rs :: fn helper<T>(n: usize) -> usize"), (28, 28, "s.rs :: fn helper<T>(n: usize) -> usize :: fn inner()"), (29, 31, "s.rs :: fn helper<T>(n: usize) -> usize"),
    ]
    held = {i for a, b, _ in got for i in range(a, b + 1)}
    lines = RUST.split("\n")
    assert all(i in held for i in range(1, len(lines)) if any(c.isalnum() for c in lines[i - 1]))


FILES = [("src/a.py", "python", PYTHON), ("pkg/tools.py", "python", "def make(x):\n    return only_here(x)\n"), ("pkg/other.py", "python", "def only_here(x):\n    return make2(x)\n\ndef outer(x):\n    pass\n"), ("s.rs", "rust", RUST), ("bad.rs", "rust", "fn x( {"), ("n.py", "python", None), ("t.txt", "text", "free text")]


@pytest.fixture(scope="module")
def trees(spark):
    files = spark.createDataFrame(FILES, "path string, language string, text string").withColumns({c: F.lit(1) for c in ("nodes", "calls", "file", "name")})
    return syntax.parsed(files.repartition(3)).cache()


def test_project(spark, trees):
    assert tuple(syntax.status(trees).first()) == (7, 4, 3, 15)
    assert {(r.file, r.name_path, r.doc) for r in syntax.docstrings(trees).collect()} == {("src/a.py", "outer", "Outer docs."), ("src/a.py", "A", "A docs."), ("s.rs", "Point", 'A "quoted { brace".'), ("s.rs", "Point/new", "Makes one.")}
    assert syntax.symbols(syntax.parsed(spark.createDataFrame([], "path string, language string, text string"))).count() == 0


def test_call_edges(trees):
    got = {(r.file, r.caller, r.callee, r.line, r.callee_file, r.callee_path, r.how) for r in syntax.call_edges(trees).collect()}
    assert got == {
        ("src/a.py", "inner", "make", 10, "pkg/tools.py", "make", "import"),
        ("src/a.py", "outer", "inner", 11, "src/a.py", "outer/inner", "file"),
        ("src/a.py", "go", "stop", 18, "src/a.py", "A/stop", "file"),
        ("src/a.py", "go", "make", 19, "pkg/tools.py", "make", "unique"),
        ("src/a.py", "stop", "outer", 22, "src/a.py", "outer", "file"),
        ("src/a.py", "<anonymous>", "outer", 25, "src/a.py", "outer", "file"),
        ("src/a.py", "<anonymous>", "A", 25, "src/a.py", "A", "file"),
        ("pkg/tools.py", "make", "only_here", 2, "pkg/other.py", "only_here", "unique"),
        ("pkg/other.py", "only_here", "make2", 2, None, None, None),
        ("s.rs", "new", "helper", 17, "s.rs", "helper", "file"), ("s.rs", "new", "len", 17, None, None, None), ("s.rs", "shown", "new2", 22, None, None, None),
        ("s.rs", "inner", "open_store", 28, None, None, None), ("s.rs", "helper", "inner", 29, "s.rs", "helper/inner", "file"),
    }
    edges, _ = graph.call_bfs(syntax.call_edges(trees, keep_unresolved=False).select("caller", "callee"), "go", depth=3)
    assert {(r.caller, r.callee, r.depth) for r in edges.collect()} == {("go", "stop", 1), ("go", "make", 1), ("stop", "outer", 2), ("make", "only_here", 2), ("outer", "inner", 3)}


def test_call_edges_parse_each_file_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([(f"a/f{i}.rs", "rust", f"fn g{i}() {{ g{i + 1}(); }}\n") for i in range(40)], "path string, language string, text string")
    edges = syntax.call_edges(syntax.parsed(files.mapInArrow(counted, files.schema))).collect()
    assert {(r.caller, r.callee, r.how) for r in edges} == {(f"g{i}", f"g{i + 1}", "unique" if i < 39 else None) for i in range(40)}
    assert read.value == 40

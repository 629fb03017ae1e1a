"""Declarations, calls and imports of source files as tables.

Python is read with its own grammar. Languages with braces are cut into tokens, so that what strings, comments and
raw strings hold counts for nothing, and brackets make a tree; a declaration is a statement that begins
with a keyword of its language, or has a method's shape in a class. A file whose text
or brackets don't parse gives no rows but a status. Each file is parsed by itself; names are resolved between files by joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import stage

# Keywords of declarations, and words that may come before them.
KEYWORDS = {
    "rust": ("fn", "struct", "enum", "trait", "impl", "mod", "type", "const", "static", "macro_rules"),
    "go": ("func", "type", "var", "const"),
    "java": ("class", "interface", "enum", "record"),
    "kotlin": ("fun", "class", "interface", "object"),
    "typescript": ("function", "class", "interface", "type", "enum", "namespace"),
    "javascript": ("function", "class"),
}
SAME = {"tsx": "typescript", "jsx": "javascript"}
MODIFIERS = frozenset("pub async unsafe extern default export declare abstract public private protected internal static final open override sealed data inline suspend synchronized native readonly get set companion operator const".split())
CONTROL = frozenset("if for while switch match catch return new throw typeof await yield else do try when with super sizeof in of instanceof function fn func fun class let var const loop".split())
CONTAINERS = frozenset(("class", "impl", "trait", "interface", "struct", "enum", "mod", "namespace", "object", "record"))
FUNCTIONS = frozenset(("def", "async def", "fn", "func", "fun", "function", "method", "constructor"))
DOCS = {"python": ("#", "@"), "rust": ("///", "//!", "#[", "//"), "": ("//", "/*", "*", "@")}

# Space and line comments are passed with the token after them; words and brackets, most of all tokens, are tried first.
TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*+)*+(?:(?P<word>[^\W\d][\w$]*+(?!["'\#])|\$[\w$]*+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>[;,.](?!\d))|(?P<end>\Z)|(?P<block>/\*)|(?P<raw>\bb?r(?P<hash>\#*)")|(?P<triple>\"{3})|(?P<text>b?"[^"\\]*+(?:\\.[^"\\]*+)*+")|(?P<tick>`)
    |(?P<char>b?'(?:\\(?:u\{[^}']*\}|.)[^'\n]{0,8}|[^'\\\n])')|(?P<life>'\w+(?!'))|(?P<single>'(?:\\.|[^'\\\n])*')|(?P<name>[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<two>=>|::|->|\?\.|&&|\|\|)|(?P<one>.))""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/\w*")
OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Item:
    """A token, or a bracket with what is in it; lines and columns from 0."""

    text: str
    kind: str
    line: int
    column: int
    last: int = 0
    inner: list[Item] | tuple[()] = ()


@dataclass(slots=True)
class Node:
    parent: int  # place in the file's list, -1: none
    kind: str
    name: str
    first: int
    last: int
    doc: str | None = None


@dataclass(slots=True)
class Tree:
    nodes: list[Node] = field(default_factory=list)
    calls: list[tuple[int, str, str | None, int, int]] = field(default_factory=list)  # enclosing node, name, what it is called on, line, column
    imports: list[tuple[str, str, str | None]] = field(default_factory=list)  # name here, module, name there


def _closed(source: str, at: int, opening: str, closing: str) -> int:
    """Where a comment that may hold others ends."""
    depth = 0
    for m in re.compile(f"{re.escape(opening)}|{re.escape(closing)}").finditer(source, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.end()
    raise ValueError("open comment")


def _template(source: str, at: int) -> int:
    """Where a text between backticks ends, with texts in its ``${}``."""
    at += 1
    while source[at] != "`":
        if source[at] == "\\":
            at += 2
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            while depth:
                if source[at] == "`":
                    at = _template(source, at)
                    continue
                depth += (source[at] == "{") - (source[at] == "}")
                at += 1
        else:
            at += 1
    return at + 1


def bracket_tree(source: str, language: str) -> list[Item]:
    """Tokens without space and comments, those in brackets within them. ValueError if brackets or texts stay open."""
    top: list[Item] = []
    now, stack = top, []
    at, line, begins, size = 0, 0, 0, len(source)
    script = language in ("javascript", "typescript")
    match, breaks, last_break = TOKEN.match, source.count, source.rindex
    before: Item | None = None
    while at < size:
        m = match(source, at)
        kind = m.lastgroup
        start, end = m.span(kind)
        if start != at:
            skipped = breaks("\n", at, start)
            if skipped:
                line, begins = line + skipped, last_break("\n", at, start) + 1
            at = start
        if kind == "word":
            before = Item(source[at:end] if end - at <= 80 else source[at : at + 80], "word", line, at - begins, line)
            now.append(before)
            at = end
            continue
        if kind == "open":
            before = Item(source[at], "one", line, at - begins, line, [])
            now.append(before)
            stack.append((now, before))
            now, at = before.inner, end
            continue
        if kind == "close":
            text = source[at]
            if not stack or stack[-1][1].text != CLOSE[text]:
                raise ValueError("brackets don't match")
            now, holder = stack.pop()
            holder.last, before = line, Item(text, "one", line, at - begins, line)
            at = end
            continue
        if kind == "mark":
            before = Item(source[at], "one", line, at - begins, line)
            now.append(before)
            at = end
            continue
        if kind == "end":
            break
        kind = "raw" if kind == "hash" else "word" if kind == "name" else kind
        if kind == "one" and source[at] == "/" and script and (before is None or before.kind == "two" or before.text in CONTROL or (before.kind == "one" and before.text not in ")]}")):
            r = REGEX.match(source, at)
            kind, end = ("text", r.end()) if r else (kind, end)
        elif kind == "block":
            end = _closed(source, at, "/*", "*/") if language in ("rust", "kotlin") else source.index("*/", at + 2) + 2
        elif kind == "raw":
            if language == "rust":
                end = source.index('"' + m["hash"], end) + 1 + len(m["hash"])
            else:
                kind, end = "word", m.start("hash")
        elif kind == "triple" and language in ("kotlin", "java"):
            end = source.index('"""', end) + 3
        elif kind == "triple":
            kind, end = "text", at + 2
        elif kind == "tick":
            end = source.index("`", at + 1) + 1 if language == "go" else _template(source, at) if language != "kotlin" else end
        elif kind == "life" and language != "rust":
            raise ValueError("open text")
        elif kind == "one" and source[at] == '"':
            raise ValueError("open text")
        skipped = breaks("\n", at, end)
        if kind != "block":
            before = Item(source[at : min(end, at + 80)], "text" if kind in ("raw", "triple", "text", "tick", "char", "single", "life") else kind, line, at - begins, line + skipped)
            now.append(before)
        if skipped:
            line, begins = line + skipped, last_break("\n", at, end) + 1
        at = end
    if stack:
        raise ValueError("brackets stay open")
    return top


def _statements(items: list[Item], lines_end: bool) -> Iterator[list[Item]]:
    """Items up to a semicolon, a block in braces, or the end of a line that can't go on."""
    now: list[Item] = []
    for i, item in enumerate(items):
        if now and lines_end and item.line > now[-1].last and now[-1].kind != "two" and (now[-1].kind != "one" or now[-1].text in "([{") and item.kind != "two" and (item.kind != "one" or item.text in "{@#"):
            modifiers = all(x.text in MODIFIERS or x.text == "@" or (k and now[k - 1].text == "@") or x.text == "(" for k, x in enumerate(now))
            if not modifiers and item.text != "{":
                yield now
                now = []
        if item.text == ";" and item.kind == "one":
            if now:
                yield now
            now = []
            continue
        now.append(item)
        if item.text == "{" and item.kind == "one":
            after = items[i + 1] if i + 1 < len(items) else None
            if after is None or not (after.text in (".", ",", "else", "catch", "finally", "from", "=", "?.") or (after.text in ("(", "[") and after.line == item.last)):
                yield now
                now = []
    if now:
        yield now


def _declared(statement: list[Item], language: str, within: str, owner: str) -> tuple[int, str, str] | None:
    """(place of the first item that counts, kind, name) of a statement that declares something."""
    i, first, keywords = 0, None, KEYWORDS[language]
    while i < len(statement):
        item = statement[i]
        nxt = statement[i + 1] if i + 1 < len(statement) else None
        if item.text == "#" and nxt is not None:  # an attribute, read as a doc line
            i += 3 if nxt.text == "!" else 2
            continue
        if item.text == "@" and item.kind == "one":
            first = i if first is None else first
            i += 2
            while i < len(statement) and statement[i].text in (".", "("):
                i += 1 if statement[i].text == "(" else 2
            continue
        if item.text in keywords and item.kind == "word" and nxt is not None and not (item.text == "const" and nxt.text in ("fn", "unsafe", "async", "extern")):
            name = _name(statement[i + 1 :], item.text, language)
            if item.text == "class" and i and statement[i - 1].text == "enum":
                return (first if first is not None else i), "enum", name
            if name or item.text == "object":
                return (first if first is not None else i), ("macro" if item.text == "macro_rules" else item.text), name
        if item.text in MODIFIERS or item.kind == "text" or (item.text == "(" and i and statement[i - 1].text == "pub"):
            first = i if first is None else first
            i += 1
            continue
        break
    if within in ("class", "interface", "enum", "record") and language in ("java", "typescript", "javascript"):
        for k, item in enumerate(statement[:-1]):
            if item.text in ("=", "{") or (item.kind == "word" and item.text in CONTROL - {"new", "of", "in", "with", "match"} and language == "java"):
                break
            if item.kind == "word" and statement[k + 1].text == "(" and item.text not in CONTROL and (statement[-1].text == "{" or language == "java" or within == "interface"):
                if "=" in (x.text for x in statement[:k]):
                    break
                return (first if first is not None else i), ("constructor" if item.text in (owner, "constructor") else "method"), item.text
    return None


def _name(rest: list[Item], keyword: str, language: str) -> str:
    if keyword == "func" and rest and rest[0].text == "(":
        rest = rest[1:]
    if keyword == "macro_rules":
        rest = rest[1:]
    if keyword != "impl":
        at = 1 if rest and rest[0].text == "*" else 0
        if keyword == "fun" and rest and rest[0].text == "<":
            while at < len(rest) and rest[at].text != ">":
                at += 1
            at += 1
        name = rest[at].text if at < len(rest) and rest[at].kind == "word" else ""
        while keyword == "fun" and at + 2 < len(rest) and rest[at + 1].text == ".":  # of another type
            at, name = at + 2, rest[at + 2].text
        return name
    names, depth = [], 0
    for item in rest:
        if item.text == "{" or item.text == "where":
            break
        depth += (item.text == "<") - (item.text == ">")
        if item.kind == "word" and not depth:
            names = [] if item.text == "for" else [*names, item.text]
    return names[-1] if names else ""


def _walk(items: list[Item], language: str, tree: Tree, parent: int, within: str, owner: str) -> None:
    for statement in _statements(items, language != "rust" and language != "java"):
        found = _declared(statement, language, within, owner)
        if found:
            at, kind, name = found
            tree.nodes.append(Node(parent, kind, name, statement[at].line, max(x.last for x in statement)))
            me = len(tree.nodes) - 1
            head = {id(x) for x in statement if x.text == name}
            if kind in ("struct", "type") or (language in ("rust", "go") and kind == "enum"):
                continue
            body = statement.pop() if statement[-1].text == "{" else None
            _calls(statement, language, tree, me, head)
            if body is not None:
                _walk(body.inner, language, tree, me, kind if kind in CONTAINERS else "", name)
        else:
            if language == "rust" and statement[0].text == "use":
                _use(statement[1:], [], tree)
            elif language in ("java", "kotlin") and statement[0].text == "import":
                parts = [x.text for x in statement[1:] if x.kind == "word" and x.text != "static"]
                if parts:
                    tree.imports.append((parts[-1], ".".join(parts[:-1]), parts[-1]))
            elif statement[0].text in ("import", "export") and language in ("typescript", "javascript"):
                _script_import(statement, tree)
            _calls(statement, language, tree, parent, frozenset())


def _use(items: list[Item], above: list[str], tree: Tree) -> None:
    """``use`` of a path, or of several below a common one, with other names after ``as``."""
    part: list[Item] = []
    for item in [*items, Item(",", "one", 0, 0)]:
        if item.text != ",":
            part.append(item)
            continue
        words = [x.text for x in part if x.kind == "word"]
        alias = words[words.index("as") + 1 :] if "as" in words else []
        path = [*above, *(words[: words.index("as")] if "as" in words else words)]
        if part and part[-1].text == "{":
            _use(part[-1].inner, path, tree)
        elif len(path) > len(above):
            tree.imports.append((alias[0] if alias else path[-1], "/".join(x for x in path[:-1] if x not in ("crate", "self", "super")), path[-1]))
        part = []


def _script_import(statement: list[Item], tree: Tree) -> None:
    module = next((x.text[1:-1] for x in reversed(statement) if x.kind == "text"), None)
    if module is None:
        return
    module = re.sub(r"\.[jt]sx?$", "", re.sub(r"^(\.{1,2}/)+", "", module))
    for k, item in enumerate(statement[1:], 1):
        if item.text == "{":
            words: list[str] = []
            for x in [*item.inner, Item(",", "one", 0, 0)]:
                if x.text == ",":
                    if words:
                        tree.imports.append((words[-1], module, words[0]))
                    words = []
                elif x.text != "as":
                    words.append(x.text)
        elif item.kind == "word" and item.text not in ("from", "type", "as", "default", "function", "class", "const", "let") and statement[k - 1].text not in (".", "("):
            if statement[0].text == "import":
                tree.imports.append((item.text, module, None))


def _calls(items: list[Item], language: str, tree: Tree, parent: int, skip: set[int] | frozenset[int]) -> None:
    """Calls in items, and in the brackets within them; blocks may hold declarations of their own."""
    for k, item in enumerate(items):
        before = items[k - 1] if k else None
        if before is not None and (before.text == "#" or (before.text == "!" and k > 1 and items[k - 2].text == "#")):
            continue
        if item.kind == "word" and id(item) not in skip and item.text not in CONTROL and not (before is not None and before.text == "@"):
            j = k + 1
            if j + 1 < len(items) and items[j].text == "::" and items[j + 1].text == "<":  # f::<T>(x)
                while j < len(items) and items[j].text != ">":
                    j += 1
                j += 1
            if j < len(items) and items[j].text == "(" and not (before is not None and before.text in KEYWORDS[language]):
                on = items[k - 2].text if k > 1 and before.text in (".", "::", "?.") and items[k - 2].kind == "word" else "" if before is not None and before.text in (".", "::", "?.") else None
                tree.calls.append((parent, item.text, on, item.line, item.column))
        if item.inner:
            if item.text == "{":
                _walk(item.inner, language, tree, parent, "", "")
            else:
                _calls(item.inner, language, tree, parent, skip)


def _python(source: str) -> Tree:
    tree = Tree()
    stack: list[tuple[ast.AST, int]] = [(ast.parse(source), -1)]
    while stack:
        at, parent = stack.pop()
        for child in ast.iter_child_nodes(at):
            here = parent
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "def" if isinstance(child, ast.FunctionDef) else "async def"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                tree.nodes.append(Node(parent, kind, child.name, first - 1, child.end_lineno - 1, ast.get_docstring(child)))
                here = len(tree.nodes) - 1
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                name, on = (child.func.id, None) if isinstance(child.func, ast.Name) else (child.func.attr, child.func.value.id if isinstance(child.func.value, ast.Name) else "")
                spot = (child.func.lineno, child.func.col_offset) if on is None else (child.func.end_lineno, child.func.end_col_offset - len(name.encode()))
                tree.calls.append((parent, name, on, spot[0] - 1, spot[1]))
            elif isinstance(child, ast.Import):
                tree.imports += [(a.asname or a.name.split(".")[0], a.name.replace(".", "/"), None) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                tree.imports += [(a.asname or a.name, (child.module or "").replace(".", "/"), a.name) for a in child.names]
            stack.append((child, here))
    return tree


def language_of(language: str | None) -> str | None:
    language = SAME.get(language, language)
    return language if language == "python" or language in KEYWORDS else None


def parse(source: str, language: str | None) -> Tree | None:
    """Declarations by first line, calls by place and imports of a source; None if its language isn't known or it doesn't parse."""
    known = language_of(language)
    if known is None:
        return None
    try:
        if known == "python":
            tree = _python(source)
        else:
            tree = Tree()
            _walk(bracket_tree(source, known), known, tree, -1, "", "")
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError):
        return None
    order = sorted(range(len(tree.nodes)), key=lambda i: (tree.nodes[i].first, -tree.nodes[i].last, i))
    place = {old: new for new, old in enumerate(order)} | {-1: -1}
    tree.nodes = [tree.nodes[i] for i in order]
    for node in tree.nodes:
        node.parent = place[node.parent]
    tree.calls = sorted({(place[p], *rest) for p, *rest in tree.calls}, key=lambda c: c[3:])
    if known != "python":
        lines = source.split("\n")
        for node in tree.nodes:
            node.doc = doc_text(lines[doc_lines(lines, node.first, known, 0) : node.first])
    return tree


def doc_lines(lines: list[str], at: int, language: str | None, lowest: int) -> int:
    """First line of the doc lines right above a declaration, over at most two blank lines."""
    first, i, blanks, marks = at, at - 1, 0, DOCS.get(language_of(language) or "", DOCS[""])
    while i >= lowest:
        text = lines[i].strip()
        if text.startswith(marks):
            first, blanks = i, 0
        elif text or blanks == 2:
            break
        else:
            blanks += 1
        i -= 1
    return first


def doc_text(lines: list[str]) -> str | None:
    """What the comments among doc lines say, without their marks."""
    said = [re.sub(r"\s*\*+/\s*$", "", re.sub(r"^\s*(?:///?!?|/\*+|\*(?!/))\s?", "", x)) for x in lines if x.strip() and not x.strip().startswith(("#[", "@"))]
    text = "\n".join(x.rstrip() for x in said).strip("\n")
    return text or None


PARSED = "parsed boolean, nodes array<struct<node: int, parent: int, kind: string, name: string, name_path: string, start_line: int, end_line: int, doc: string>>, calls array<struct<caller: string, scope: string, name: string, target: string, line: int, col: int>>, imports array<struct<name: string, module: string, original: string>>"
_NODE = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("name_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("doc", pa.string())])
_CALL = pa.struct([("caller", pa.string()), ("scope", pa.string()), ("name", pa.string()), ("target", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
_IMPORT = pa.struct([("name", pa.string()), ("module", pa.string()), ("original", pa.string())])


def name_paths(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    for n in nodes:
        out.append(f"{out[n.parent]}/{n.name}" if n.parent >= 0 else n.name)
    return out


def enclosing(nodes: list[Node], at: int) -> int:
    """The innermost function that a node is or is in; -1: none."""
    while at >= 0 and nodes[at].kind not in FUNCTIONS:
        at = nodes[at].parent
    return at


def parsed(files: DataFrame) -> DataFrame:
    """Each file (path, language, text) with its tree: ``parsed``, ``nodes``, ``calls`` and ``imports``; lines count from 1.

    A null text, an unknown language or a text that doesn't parse has ``parsed`` false and empty lists. Repeated
    paths are parsed each; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                done, ends = [], ([0], [0], [0])
                nodes, calls, imports = ([[] for _ in kind] for kind in (_NODE, _CALL, _IMPORT))
                for language, text in zip(part.column("language").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tree = parse(text, language) if text is not None else None
                    done.append(tree is not None)
                    tree = tree or Tree()
                    names = name_paths(tree.nodes)
                    around = [enclosing(tree.nodes, i) for i in range(len(tree.nodes))] + [-1]
                    callers = [("<anonymous>", "") if f < 0 else (tree.nodes[f].name, names[f]) for f in around]
                    said = [callers[p] for p, *_ in tree.calls]
                    rows = [(i, n.parent, n.kind, n.name, names[i], n.first + 1, n.last + 1, n.doc) for i, n in enumerate(tree.nodes)]
                    sites = [(a, b, n, on, line + 1, col) for (a, b), (_, n, on, line, col) in zip(said, tree.calls, strict=True)]
                    for held, end, new in zip((nodes, calls, imports), ends, (rows, sites, tree.imports), strict=True):
                        for column, values in zip(held, zip(*new, strict=True), strict=False):
                            column.extend(values)
                        end.append(end[-1] + len(new))
                lists = [
                    pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(held, kind, strict=True)], fields=list(kind)))
                    for held, end, kind in zip((nodes, calls, imports), ends, (_NODE, _CALL, _IMPORT), strict=True)
                ]
                columns = [part.column("path"), pa.array(done), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "parsed", "nodes", "calls", "imports"])

    return files.select(F.col("path").cast("string").alias("path"), "language", "text").mapInArrow(run, "path string, " + PARSED)


def symbols(trees: DataFrame) -> DataFrame:
    """``(file, node, parent, name, name_path, kind, start_line, end_line, doc)`` of parsed files, one row a declaration."""
    n = trees.select(F.col("path").alias("file"), F.explode("nodes").alias("n"))
    return n.select("file", *[F.col(f"n.{c}").alias(c) for c in ("node", "parent", "name", "name_path", "kind", "start_line", "end_line", "doc")])


def status(trees: DataFrame) -> DataFrame:
    """One row: files, those that parsed and those that were skipped, declarations."""
    return trees.agg(F.count("*").alias("files"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("skipped"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("declarations"))


def docstrings(trees: DataFrame) -> DataFrame:
    """``(file, name_path, doc)`` of declarations that have one."""
    return symbols(trees).where("doc is not null").select("file", "name_path", "doc")


def _module(path: Column) -> Column:
    """The path without its suffix; a package's file stands for its folder."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"/(__init__|mod|index|lib)$", "")


def _tails(module: Column) -> Column:
    """All trailing parts of a path, as imports name files from any root."""
    parts = F.split(module, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def call_edges(trees: DataFrame, keep_unresolved: bool = True) -> DataFrame:
    """``(caller, callee, file, line, col, caller_path, callee_file, callee_path, how)``: one hop from every call site.

    A name is looked up, by equi-joins, among declarations of its own file in the enclosing scopes (the innermost
    first; on ``self`` and ``this`` in the caller's container), then of the file that an import names, then among
    all files where just one declaration has it. ``how`` says which: file, import, unique, or
    null if none has it (kept as a name alone unless ``keep_unresolved`` is false). The caller is the innermost
    function around the call, ``<anonymous>`` outside of any. A call of a function by itself is dropped.
    """
    # Files are parsed once: the plan below reads their trees in several places.
    trees = stage(trees.select("path", F.transform("nodes", lambda n: n.dropFields("node", "start_line", "end_line", "doc")).alias("nodes"), "calls", "imports"), "trees")
    named = trees.select(F.col("path").alias("file"), F.explode("nodes").alias("n")).select("file", *[F.col(f"n.{c}").alias(c) for c in ("parent", "name", "name_path", "kind")])
    able = named.where(F.col("kind").isin(*FUNCTIONS, *CONTAINERS, "type", "macro"))
    sites = trees.select("path", F.explode("calls").alias("c")).select("path", *[F.col(f"c.{x}").alias(x) for x in ("name", "target", "line", "col", "caller", "scope")])
    own = able.select(F.col("file").alias("of"), F.col("name").alias("as"), F.col("name_path").alias("found"), F.expr("substring(name_path, 1, length(name_path) - length(name))").alias("inside"))
    met = sites.join(own, (F.col("path") == F.col("of")) & (F.col("name") == F.col("as")), "left")
    reach = F.col("inside") == ""
    scope, container = F.concat("scope", F.lit("/")), F.regexp_replace("scope", r"[^/]*$", "")
    on_self = F.col("target").isin("self", "this", "Self", "cls")
    fits = F.when(on_self, F.col("inside") == container).when(F.col("target").isNull(), reach | scope.startswith(F.col("inside"))).otherwise(F.concat(F.lit("/"), "inside").endswith(F.concat(F.lit("/"), "target", F.lit("/"))))
    site = ["path", "name", "target", "line", "col", "caller", "scope"]
    best = met.groupBy(*site).agg(F.max(F.when(fits, F.struct(F.length("inside"), "found")))["found"].alias("here"))
    # Imported names, with the file that the module's path ends like.
    imports = trees.select("path", F.explode("imports").alias("i")).select(F.col("path").alias("ip"), F.col("i.name").alias("alias"), F.col("i.module").alias("module"), F.coalesce("i.original", F.lit("")).alias("original")).distinct()
    tails = trees.select("path", F.explode(_tails(_module(F.col("path")))).alias("tail"))
    once = lambda df, key: df.withColumn("k", F.count("*").over(W.partitionBy(*key))).where("k = 1").drop("k")
    homes = tails.groupBy("tail").agg(F.count("*").alias("k"), F.min("path").alias("home")).where("k = 1").drop("k")
    # ``import a.b`` names a module, ``from a import b`` a declaration of it or a module within it.
    wanted = imports.select("ip", "alias", "module", "original", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("module").alias("m")), F.struct(F.lit(1).alias("w"), F.when(F.col("original") != "", F.concat_ws("/", F.when(F.col("module") != "", F.col("module")), "original")).alias("m")))).alias("x"))
    placed = wanted.select("ip", "alias", "original", "x.w", "x.m").join(homes, F.col("m") == F.col("tail")).select("ip", "alias", "original", "w", "home")
    direct = placed.where("w = 0 and original != ''").select("ip", "alias", F.col("home").alias("home_d"), "original")
    modules = placed.where("w = 1 or original = ''").select(F.col("ip").alias("jp"), F.col("alias").alias("jalias"), F.col("home").alias("home_m"))
    direct, modules = once(direct, ["ip", "alias"]), once(modules, ["jp", "jalias"])
    found = best.join(direct, (F.col("path") == F.col("ip")) & F.col("target").isNull() & (F.col("name") == F.col("alias")), "left")
    found = found.join(modules, (F.col("path") == F.col("jp")) & (F.col("target") == F.col("jalias")), "left")
    found = found.select(*site, "here", F.coalesce("home_d", "home_m").alias("there"), F.coalesce("original", "name").alias("called"))
    tops = able.where("parent < 0").groupBy(F.col("file").alias("tf"), F.col("name").alias("tn")).agg(F.min("name_path").alias("there_path"))
    found = found.join(tops, (F.col("there") == F.col("tf")) & (F.col("called") == F.col("tn")), "left")
    lone = able.groupBy(F.col("name").alias("un")).agg(F.count("*").alias("k"), F.min("file").alias("lone_file"), F.min("name_path").alias("lone_path")).where("k = 1").drop("k")
    found = found.join(lone, F.col("name") == F.col("un"), "left")
    how = F.when(F.col("here").isNotNull(), "file").when(F.col("there_path").isNotNull(), "import").when(F.col("lone_path").isNotNull(), "unique")
    by = lambda a, b, c: F.when(F.col("here").isNotNull(), a).when(F.col("there_path").isNotNull(), b).when(F.col("lone_path").isNotNull(), c)
    callee_path = by(F.col("here"), F.col("there_path"), F.col("lone_path"))
    callee_file = by(F.col("path"), F.col("there"), F.col("lone_file"))
    out = found.select("caller", F.coalesce(F.element_at(F.split(callee_path, "/"), -1), "name").alias("callee"), F.col("path").alias("file"), "line", "col", F.col("scope").alias("caller_path"), callee_file.alias("callee_file"), callee_path.alias("callee_path"), how.alias("how"))
    mine = (F.col("callee_file") == F.col("file")) & (F.col("callee_path") == F.col("caller_path"))
    out = out.where(~F.coalesce(mine, F.lit(False)))
    return out if keep_unresolved else out.where("how is not null")


"""Source code in chunks by its declarations, with docs kept to them and headers that say where they are.

Declarations come from the syntax tree of a file; one without any, or that doesn't parse, is split by lines.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import syntax
from weftline.operators.text import split_lines

SIGNATURE_LINES = 3
SIGNATURE_CHARS = 100
INNER = syntax.FUNCTIONS | {"const", "type", "impl"}


def signature(line: str) -> str:
    """The first line of a declaration up to its body, at most 100 characters."""
    line = line.strip()
    ends = [i for i in (line.find("{"), line.find("=>")) if i >= 0]
    if line.endswith(":"):
        ends.append(len(line) - 1)
    return line[: min(ends, default=len(line))].rstrip()[:SIGNATURE_CHARS]


def members(nodes: list[syntax.Node], at: int, language: str | None) -> list[syntax.Node]:
    """The outermost functions, constants and types within a declaration that is split into its members."""
    if nodes[at].kind not in syntax.CONTAINERS and language not in ("python", "rust"):
        return []
    inside, found = {at}, []
    for i in range(at + 1, len(nodes)):
        if nodes[i].parent in inside:
            if nodes[i].kind in INNER:
                found.append(nodes[i])
            else:
                inside.add(i)
    return found


def split_code(source: str, language: str | None, size: int, path: str = "") -> list[tuple[int, int, str, str]]:
    """(first line, last line, content, header) of chunks; lines count from 1.

    A declaration that fits is one chunk with its docs. One with members gives a chunk of its docs and signature, and
    one chunk for each member, one level down. One too large repeats docs and signature on each piece, and
    pieces after the first say that they go on. What lies between declarations, or between members, is chunked too.
    """
    lines = [x.removesuffix("\r") for x in source.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    tree = syntax.parse(source, language)
    nodes = tree.nodes if tree else []
    if not nodes:
        return [(a, b, c, path) for a, b, c in split_lines(source, size, 0)]
    out: list[tuple[int, int, str, str]] = []
    text = lambda a, b: "\n".join(lines[a : b + 1])
    docs = lambda at, low: syntax.doc_lines(lines, at, language, low)

    def gap(a: int, b: int, header: str, said: re.Pattern = re.compile(r"\S")) -> None:
        if a <= b and said.search(text(a, b)):
            out.extend((a + s, a + e, c, header) for s, e, c in split_lines(text(a, b), size, 0))

    def leaf(d: syntax.Node, first: int, header: str) -> None:
        whole = text(first, d.last)
        if len(whole.encode()) <= size:
            out.append((first + 1, d.last + 1, whole, header))
            return
        prefix = text(first, d.first)
        room = max(size - len(prefix.encode()) - 24, size // 4)
        for n, (s, e, c) in enumerate(split_lines(text(d.first + 1, d.last), room, 0)):
            goes_on = "" if n == 0 else "\n// ... (continued)"
            out.append((d.first + 1 + s, d.first + 1 + e, f"{prefix}{goes_on}\n{c}", header))

    at = 0
    for i, d in enumerate(nodes):
        if d.parent >= 0 or d.first < at:
            continue
        first = docs(d.first, at)
        gap(at, first - 1, path)
        label = signature(lines[d.first])
        header = " :: ".join(x for x in (path, label) if x)
        inner = members(nodes, i, syntax.language_of(language))
        if inner:
            head = d.first
            while head < d.last and head - d.first < SIGNATURE_LINES - 1 and not re.search(r"\{|=>|:\s*$", lines[head]):
                head += 1
            head = min(head, inner[0].first - 1) if inner[0].first > d.first else d.first
            out.append((first + 1, head + 1, text(first, head), header))
            low = head + 1
            for e in inner:
                if e.first < low:
                    continue
                begin = docs(e.first, low)
                gap(low, begin - 1, header, _WORDS)
                leaf(e, begin, " :: ".join(x for x in (header, signature(lines[e.first])) if x))
                low = e.last + 1
            gap(low, d.last, header, _WORDS)
        else:
            leaf(d, first, header)
        at = d.last + 1
    gap(at, len(lines) - 1, path)
    return [piece for c in out for piece in enforce_size(c, size)]


_WORDS = re.compile(r"\w")  # between members a bracket alone says nothing


def enforce_size(chunk: tuple[int, int, str, str], size: int) -> list[tuple[int, int, str, str]]:
    """A chunk as pieces of at most ``size`` bytes, by lines, and by whole characters where one line is longer."""
    first, _, content, header = chunk
    if len(content.encode()) <= 2 * size:
        return [chunk]
    out = []
    for s, e, c in split_lines(content, size, 0):
        raw = c.encode()
        while raw:
            cut = min(size, len(raw))
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((first + s - 1, first + e - 1, raw[:cut].decode(), header))
            raw = raw[cut:]
    return out


def split_tokens(text: str, max_tokens: int) -> list[str]:
    """Markdown in pieces of at most four bytes a token: by headings of all levels, then lines, then words of a long line."""
    most = 4 * max_tokens
    sections: list[list[str]] = [[]]
    for line in text.splitlines():
        if re.match(r"#{1,6} ", line) and sections[-1]:
            sections.append([])
        sections[-1].append(line)
    out = []
    for section in ("\n".join(s) for s in sections):
        if not section.strip():
            continue
        pieces = [c for _, _, c in split_lines(section, most, 0)] if len(section.encode()) > most else [section]
        if len(pieces) > 1 or len(section.encode()) <= most:
            out += pieces
            continue
        rest = section
        while len(rest.encode()) > most:
            head = rest.encode()[:most].decode(errors="ignore")
            cut = head.rfind(" ") + 1 or len(head)
            out.append(rest[:cut].rstrip())
            rest = rest[cut:].lstrip()
        if rest:
            out.append(rest)
    return out


def chunk_code(files: DataFrame, size: int = 1200) -> DataFrame:
    """(path, start_line, end_line, content, header) chunks of files (path, language, text)."""
    schema = pa.schema([("path", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("content", pa.string()), ("header", pa.string())])

    def run(batches):
        for batch in (b.slice(at, 50) for b in batches for at in range(0, b.num_rows, 50)):
            rows = [(p, *c) for p, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for c in split_code(t, lang, size, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "language", "text").mapInArrow(run, "path string, start_line long, end_line long, content string, header string")


def outline(files: DataFrame) -> DataFrame:
    """(file, name, name_path, kind, start_line, end_line) of the declarations of files (path, language, text) at any depth."""
    return syntax.symbols(syntax.parsed(files)).select("file", "name", "name_path", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))

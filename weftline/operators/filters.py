"""The filter language: JSON predicates compiled to Columns, with either of two null semantics.

A filter is ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}`` or ``{field: {op: value}}``. The
``sql`` mode is three-valued: what a null makes unknown is excluded, also under ``not``. The ``eval``
mode is two-valued: a leaf over a missing field is false, so its negation is true.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "ne", "gt", "lt", "gte", "lte", "in", "nin", "contains", "prefix")
HIDDEN = ("archived", "superseded", "retired")


class FilterError(ValueError):
    """A filter of the wrong shape, or over an unknown field."""


def scalar(value: object) -> object:
    """A literal of the language: null, number or text; truth values count as 1 and 0."""
    if isinstance(value, bool):
        return int(value)
    if value is None or isinstance(value, (int, float, str)):
        return value
    raise FilterError(f"values are scalars, not {type(value).__name__}")


def leaf(node: dict) -> tuple[str, str, object]:
    """(field, op, value) of a leaf."""
    if len(node) != 1:
        raise FilterError("a leaf names one field")
    ((field, test),) = node.items()
    if not isinstance(test, dict) or len(test) != 1:
        raise FilterError(f"{field}: one operator is wanted")
    ((op, value),) = test.items()
    if op not in OPS:
        raise FilterError(f"{field}: unknown operator {op}; known are {', '.join(OPS)}")
    if op in ("in", "nin"):
        if not isinstance(value, list) or not value:
            raise FilterError(f"{field}: {op} wants a list with something in it")
        return field, op, [scalar(v) for v in value]
    if op in ("contains", "prefix") and not isinstance(value, str):
        raise FilterError(f"{field}: {op} wants text")
    return field, op, scalar(value)


def _children(node: dict, kind: str) -> list[dict]:
    if not isinstance(node[kind], list) or not node[kind]:
        raise FilterError(f"{kind} wants a list with something in it")
    return node[kind]


def walk(node: object, on_leaf: Callable[[dict], object], on_all: Callable, on_any: Callable, on_not: Callable):
    """Fold a filter from its leaves."""
    if not isinstance(node, dict) or not node:
        raise FilterError("a filter is an object with a key")
    again = lambda n: walk(n, on_leaf, on_all, on_any, on_not)
    if "and" in node or "or" in node or "not" in node:
        if len(node) != 1:
            raise FilterError("and, or and not stand alone")
        if "not" in node:
            return on_not(again(node["not"]))
        kind = "and" if "and" in node else "or"
        return (on_all if kind == "and" else on_any)([again(n) for n in _children(node, kind)])
    return on_leaf(node)


def fields(node: dict) -> set[str]:
    """Fields that a filter tests."""
    union = lambda parts: set().union(*parts)
    return walk(node, lambda n: {leaf(n)[0]}, union, union, lambda x: x)


def _compare(column: Column, op: str, value: object) -> Column:
    v = F.lit(value)
    return {"eq": column == v, "ne": column != v, "gt": column > v, "lt": column < v, "gte": column >= v, "lte": column <= v}[op]


def _sql_leaf(column: Column, is_list: bool, op: str, value: object) -> Column:
    if op == "in":
        return column.isin(value)
    if op == "nin":
        return ~column.isin(value)
    if op == "contains" and is_list:
        return F.array_contains(column, F.lit(value))
    if op == "contains":  # wildcards in the value stay alive
        return column.ilike("%" + value.replace("\\", "\\\\") + "%")
    if op == "prefix":
        escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return column.ilike(escaped + "%")
    return _compare(column, op, value)


def _eval_leaf(column: Column, kind: str, op: str, value: object) -> Column:
    is_list, is_text = kind.startswith("array"), kind == "string"
    fits = lambda v: v is None or isinstance(v, str) == is_text  # noqa: E731  other types never compare
    if op in ("in", "nin"):
        good = [v for v in value if v is not None and fits(v)]
        found = column.isin(good) if good else F.lit(False)
        return F.coalesce(found, F.lit(False)) if op == "in" else F.coalesce(~found, F.lit(False))
    if op == "contains":
        return F.array_contains(column, F.lit(value)) if is_list else F.contains(F.lower(column), F.lit(value.lower())) if is_text else F.lit(False)
    if op == "prefix":
        return column.startswith(value) if is_text else F.lit(False)
    if value is None:
        return {"eq": column.isNull(), "ne": column.isNotNull()}.get(op, F.lit(False))
    if not fits(value) or is_list:
        return F.lit(op == "ne")
    return F.coalesce(_compare(column, op, value), F.lit(op == "ne"))


def compile_filter(node: dict, columns: dict[str, Column], kinds: dict[str, str], mode: str = "sql", missing: Column | None = None) -> Column:
    """A filter as a Column.

    ``columns`` are the fields that may be tested (aliases are further keys), ``kinds`` their Spark type
    names. In eval mode ``missing``, an array of field names, says which fields a row lacks; a leaf over
    such a field, or over one that is in no row, is false.
    """

    def on_leaf(n: dict) -> Column:
        field, op, value = leaf(n)
        if field not in columns:
            if mode == "eval":
                return F.lit(False)
            raise FilterError(f"unknown field {field}; known are {', '.join(sorted(columns))}")
        kind = kinds.get(field, "string")
        if mode == "sql":
            return _sql_leaf(columns[field], kind.startswith("array"), op, value)
        test = F.coalesce(_eval_leaf(columns[field], kind, op, value), F.lit(False))
        return test if missing is None else ~F.array_contains(missing, field) & test

    return walk(node, on_leaf, lambda p: reduce(lambda a, b: a & b, p), lambda p: reduce(lambda a, b: a | b, p), lambda x: ~x)


def conjoin(*nodes: dict | None) -> dict | None:
    """The filters that there are, all of them."""
    there = [n for n in nodes if n]
    return there[0] if len(there) == 1 else {"and": there} if there else None


def find_filter(filter_: dict | None = None, kind: Iterable[str] | None = None, status: Iterable[str] | None = None, include_archived: bool = False) -> dict | None:
    """A filter with the shortcuts for kind and status, and without hidden statuses unless status is asked for."""
    out = conjoin(filter_, {"kind": {"in": list(kind)}} if kind else None, {"status": {"in": list(status)}} if status else None)
    if include_archived or (out and "status" in fields(out)):
        return out
    return conjoin(out, {"status": {"nin": list(HIDDEN)}})


def without_status(node: dict | None) -> dict | None:
    """The filter without its conjuncts that exclude statuses."""
    if not node:
        return node
    if "and" in node:
        return conjoin(*[without_status(n) for n in node["and"]])
    return None if "nin" in node.get("status", {}) else node


def scope_filter(scope: str, path: Column, project: str | None = None, repo: str | None = None, umbrella: Iterable[str] = ()) -> Column:
    """Rows within a scope: project, repo, umbrella or all; a root itself or what lies below it."""
    under = lambda root: (path == root) | path.startswith(root.rstrip("/") + "/")
    if scope == "all":
        return F.lit(True)
    if scope == "umbrella" and umbrella:
        return reduce(lambda a, b: a | b, [under(r) for r in umbrella])
    root = {"project": project, "repo": repo}.get(scope)
    if root is None:
        raise FilterError(f"scope {scope} has no root")
    return under(root)

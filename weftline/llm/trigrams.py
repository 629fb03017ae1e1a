"""Boolean trigram queries that every match of a regular expression satisfies.

A query is True (anything may match), a trigram, or ("and" | "or", parts). Trigrams are of lower-cased
ASCII text, so a query holds for matches in either case.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as parser

MOST = 64  # strings kept apart for one stretch of a pattern


def _join(kind: str, parts) -> object:
    """Parts joined with the plain cases folded away."""
    absorbing = kind == "or"
    flat: list = []
    for p in parts:
        if p is True:
            if absorbing:
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat.extend(x for x in p[1] if x not in flat)
        elif p not in flat:
            flat.append(p)
    if not flat:
        return True
    if absorbing:  # a side that asks for more than another one adds nothing
        asks = [frozenset(vocabulary(p)) if isinstance(p, str) or all(isinstance(x, str) for x in p[1]) else None for p in flat]
        flat = [p for p, a in zip(flat, asks, strict=True) if a is None or not any(b is not None and b < a for b in asks)]
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> object:
    """One of the strings occurs."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _letters(char: int) -> set[str] | None:
    return {chr(char).lower()} if char < 128 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the nodes can match, or None if too many; what each match satisfies)."""
    run: set[str] | None = {""}
    parts: list = []
    exact = True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        parts += [_of_strings(run), query if strings is None else True]
        run, exact = (strings if strings is not None else {""}), False
    if exact:
        return run, _of_strings(run)
    return None, _join("and", [*parts, _of_strings(run)])


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return _letters(arg), True
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL and value < 128:
                found.add(chr(value).lower())
            elif kind is C.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        sides = [_walk(side) for side in arg[1]]
        if all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= MOST:
            return set().union(*(s for s, _ in sides)), True
        return None, _join("or", [q for _, q in sides])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        least, most, inner = arg
        strings, query = _walk(inner)
        if least == 0:
            return (strings | {""}, True) if strings is not None and most == 1 else (None, True)
        if strings is not None and least == most and len(strings) ** least <= MOST:
            return {"".join(x) for x in product(strings, repeat=least)}, True
        return None, query
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """The query of a pattern; True if no trigram is mandatory."""
    return _walk(parser.parse(pattern))[1]


def vocabulary(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(vocabulary, query[1]))


def holds(query: object, trigrams: set[str]) -> bool:
    """Whether a set of trigrams satisfies a query."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in trigrams
    return (all if query[0] == "and" else any)(holds(q, trigrams) for q in query[1])


def as_sql(query: object, column: str) -> str:
    """The query as a SQL predicate over an array column of trigrams."""
    if query is True:
        return "true"
    if isinstance(query, str):
        return f"array_contains({column}, {quoted(query)})"
    return "(" + f" {query[0]} ".join(as_sql(q, column) for q in query[1]) + ")"


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + re.sub(r"(['\\])", r"\\\1", text) + "'"

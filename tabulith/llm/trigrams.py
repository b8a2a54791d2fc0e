"""Which trigrams a regular expression cannot do without."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

#: alternatives of exact text that are followed side by side, and characters of a class that count as exact
MOST = 16
CLASS = 8

#: a query is a list of demands; a demand is met if all trigrams of one of its sets are there
Query = list[frozenset[frozenset[str]]]


def _demand(exact: set[str]) -> Query:
    """What texts that hold one of these strings must have; nothing if one string is too short to say."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in exact}
    if not exact or frozenset() in sets:
        return []
    return [frozenset(s for s in sets if not any(o < s for o in sets))]


def _characters(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(found) > CLASS:
            return None
    return found


def _item(kind, value) -> tuple[set[str] | None, Query]:
    """The exact strings of one node, or None and what it demands."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, []
    if kind is op.IN:
        return _characters(value), []
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        sides = [_sequence(b) for b in value[1]]
        if all(e is not None for e, _ in sides):
            exact = set().union(*(e for e, _ in sides))
            return (exact, []) if len(exact) <= MOST else (None, _demand(exact))
        demands = [q + (_demand(e) if e is not None else []) for e, q in sides]
        if any(not d for d in demands):
            return None, []
        return None, [frozenset().union(*(frozenset(frozenset().union(*p) for p in product(*d)) for d in demands))]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = value
        exact, query = _sequence(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, []
        if low == 0:
            return None, []
        if exact is not None and low == high and len(exact) ** low <= MOST:
            return {"".join(p) for p in product(exact, repeat=low)}, []
        return None, query + (_demand(exact) if exact is not None else [])
    if kind is op.AT:
        return {""}, []
    return None, []


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    query: Query = []
    exact, whole = {""}, True
    for kind, value in nodes:
        got, demands = _item(kind, value)
        query += demands
        if got is not None and len(exact) * len(got) <= MOST:
            exact = {a + b for a, b in product(exact, got)}
            continue
        query += _demand(exact)
        exact, whole = (got if got is not None else {""}), False
    if whole:
        return exact, query
    return None, query + _demand(exact)


def required(pattern: str) -> Query:
    """The Boolean trigram query of a pattern over lower-cased text; empty if it has no mandatory trigram."""
    exact, query = _sequence(parser.parse(pattern))
    return query + (_demand(exact) if exact is not None else [])

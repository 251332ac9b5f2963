"""Boolean trigram queries that every match of a regular expression implies.

A query is ``True`` (any text), a trigram, or ("and" | "or", queries). Texts and trigrams are compared
in lower case, so patterns that accept either case need no more trigrams than others.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from re import _constants as sre  # the standard library's own parser of patterns
from re import _parser

MOST = 40  # strings that are followed side by side

Query = bool | str | tuple


@dataclass(frozen=True)
class Known:
    """What is known of a subpattern's matches: all of them (exact), or how they begin and end, and a query."""

    exact: frozenset[str] | None
    heads: frozenset[str] = frozenset({""})
    tails: frozenset[str] = frozenset({""})
    query: Query = True

    def open(self) -> Known:
        """The same with exact given up."""
        if self.exact is None:
            return self
        return Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), any_of(self.exact))


def both(*queries: Query) -> Query:
    parts = {p for q in queries if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def either(*queries: Query) -> Query:
    if True in queries or not queries:
        return True
    parts = {p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    needs = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    parts = {p for p in parts if not any(n < needs[p] for n in needs.values())}  # a stricter alternative adds nothing
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def any_of(strings: frozenset[str]) -> Query:
    return either(*(both(*(s[k : k + 3] for k in range(len(s) - 2))) for s in strings))


def _join(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return Known(frozenset(a + b for a in x.exact for b in y.exact))
    a, b = x.open(), y.open()
    middle = any_of(frozenset(s + t for s, t in product(a.tails, b.heads)))
    heads = frozenset((s + t)[:2] for s in x.exact for t in b.heads) if x.exact is not None else a.heads
    tails = frozenset((s + t)[-2:] for s in a.tails for t in y.exact) if y.exact is not None else b.tails
    return Known(None, heads, tails, both(a.query, b.query, middle))


def _or(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST:
        return Known(x.exact | y.exact)
    a, b = x.open(), y.open()
    return Known(None, a.heads | b.heads, a.tails | b.tails, either(a.query, b.query))


ANY = Known(None)
EMPTY = Known(frozenset({""}))


def _chars(items: list) -> frozenset[str] | None:
    """The lower-cased characters of a class, or None where they are too many to follow."""
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _walk(nodes) -> Known:
    out = EMPTY
    for kind, value in nodes:
        if kind is sre.LITERAL:
            step = Known(frozenset({chr(value).lower()}))
        elif kind is sre.IN:
            chars = _chars(value)
            step = ANY if chars is None else Known(chars)
        elif kind is sre.SUBPATTERN:
            step = _walk(value[3])
        elif kind is sre.BRANCH:
            step = _walk(value[1][0])
            for branch in value[1][1:]:
                step = _or(step, _walk(branch))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            unit = _walk(inner)
            if (least, most) == (0, 1):
                step = _or(EMPTY, unit)
            elif least == 0:
                step = ANY
            else:
                step = unit
                for _ in range(min(least, 3) - 1):
                    step = _join(step, unit)
                if most != least or least > 3:
                    last = unit.open()
                    step = step.open()
                    step = Known(None, step.heads, last.tails if least > 3 else step.tails | last.tails, step.query)
        elif kind is sre.AT:
            step = EMPTY
        else:
            step = ANY
        out = _join(out, step)
    return out


def trigram_query(pattern: str) -> Query:
    """A query that holds for every text with a match of ``pattern``; True where no trigram is mandatory."""
    return _walk(_parser.parse(pattern)).open().query


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))

_COMMON = "etaoinshrdlucmfwypvbgkjqxz "


def narrowed(query: Query, most: int = 2) -> Query:
    """A weaker query of fewer trigrams: of what must all hold, the ``most`` parts of the rarest letters stay.

    What satisfies the query satisfies this one too, and the index holds fewer postings.
    """
    if not isinstance(query, tuple):
        return query
    parts = [narrowed(q, most) for q in query[1]]
    if query[0] == "or":
        return either(*parts)

    def rarity(q: Query) -> tuple[int, str]:
        found = sorted(trigrams_of(q))
        return -min((sum(_COMMON.find(c) if c in _COMMON else 30 for c in t) for t in found), default=0), str(found)

    return both(*sorted(parts, key=rarity)[:most])

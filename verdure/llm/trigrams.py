"""Boolean trigram queries derived from regexes.

A query is a list of clauses, each a set of lower-case trigrams; a text can match only if all trigrams of one clause
occur in its lower-cased form. An empty list means that nothing is mandatory and every text must be scanned.
"""

from __future__ import annotations

from itertools import product

from re import _constants as sre
from re import _parser

#: Alternatives kept for one literal run, and clauses for a query; a run beyond that is cut or left out, never wrong.
MAX_STRINGS, MAX_CLAUSES = 24, 48


def _strings(parsed) -> list[list[str] | None]:
    """The parsed sequence as runs: a list of all strings that an element can match, or None where it is open."""
    out: list[list[str] | None] = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            out.append([chr(arg).lower()])
        elif op is sre.IN:
            chars = [chr(v).lower() for k, v in arg if k is sre.LITERAL] if all(k is sre.LITERAL for k, _ in arg) else []
            out.append(sorted(set(chars)) if 0 < len(chars) <= 4 else None)
        elif op is sre.SUBPATTERN:
            out += _strings(arg[-1])
        elif op is sre.BRANCH:
            every: list[str] | None = []
            for branch in arg[1]:
                one = _joined(_strings(branch))
                every = None if one is None or every is None else every + one
            out.append(every)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _joined(_strings(inner))
            if high == 1 and low == 0:
                out.append(None if one is None else ["", *one])
            elif low == high and one is not None and low <= 8:
                out += [one] * low
            else:
                out += ([one] if low and one is not None else []) + [None]
        elif op is not sre.AT:
            out.append(None)
    return out


def _joined(parts: list[list[str] | None]) -> list[str] | None:
    """All strings of a closed sequence."""
    if any(p is None for p in parts):
        return None
    found = ["".join(x) for x in product(*parts)] if parts else [""]
    return found if len(found) <= MAX_STRINGS else None


def _runs(parts: list[list[str] | None]) -> list[list[str]]:
    """Literal runs between open elements."""
    runs, now = [], [""]
    for p in [*parts, None]:
        longer = None if p is None else sorted({a + b for a in now for b in p})
        if longer is None or len(longer) > MAX_STRINGS:
            runs.append(now)
            now = [""] if p is None or len(p) > MAX_STRINGS else p
        else:
            now = longer
    return runs


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of mandatory trigrams for ``regex``, in Python's syntax as far as it is shared with Java's."""
    clauses = [frozenset()]
    for run in _runs(_strings(_parser.parse(regex))):
        if min(map(len, run)) < 3:
            continue
        longer = {a | _grams(s) for a in clauses for s in run}
        if len(longer) <= MAX_CLAUSES:
            clauses = sorted(longer, key=sorted)
    least = [c for c in clauses if not any(o < c for o in clauses)]
    return [] if any(not c for c in least) else least


def can_match(text: str, query: list[frozenset[str]]) -> bool:
    """What the index decides, for tests."""
    return not query or any(all(g in text.lower() for g in c) for c in query)

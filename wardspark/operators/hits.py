"""The row type all detectors share before findings get their final columns.

Hit arrays are written as SQL text: the expressions are large and nested, and
one parse is far cheaper to plan than thousands of single column calls.
"""

from __future__ import annotations

from ..rules.fixed import CONTEXT_LINES

_FIELDS = {
    "rule_ord": "int", "pattern_ord": "int", "line_number": "int", "match_ord": "int",
    "line": "string", "folded": "string", "context": "array<string>", "note": "string", "snippet": "string",
}
HIT = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">"
NO_HITS = f"CAST(array() AS array<{HIT}>)"


def hit(rule_ord, pattern_ord, line_number: str, match_ord: str, **rest: str) -> str:
    """One hit as SQL; fields left out are null."""
    values = dict(rule_ord=rule_ord, pattern_ord=pattern_ord, line_number=line_number, match_ord=match_ord, **rest)
    parts = [f"'{n}', CAST({values.get(n, 'NULL')} AS {t})" for n, t in _FIELDS.items()]
    return "named_struct(" + ", ".join(parts) + ")"


def context(n: str) -> str:
    """The lines around line ``n`` of the file, as SQL."""
    first = f"greatest({n} - {CONTEXT_LINES}, 1)"
    return f"slice(_lines, {first}, {n} + {CONTEXT_LINES} - {first} + 1)"

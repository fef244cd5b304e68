"""SQL building blocks for the DuckDB side.

Regexes are the rule set's own text (a fixed value on both sides); everything
around them is written independently in SQL.  RE2 has no lookahead, so "a call
with no keyword after it" is asked of the last call on the line, whose tail is
the shortest.
"""

from __future__ import annotations

from wardspark.rules import ALL_RULES, FILE, RuleSpec
from wardspark.rules.fixed import (
    CONFIG_NAMES, DEFAULT_GLOBS, DESCRIPTION_PLACES, INJECTION_PHRASES, MODEL_CALLS, SKIPPED_DIRS, SYSTEM_WORDS, USER_WORDS,
)

from .corpora import CODE_FILES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(regex: str, flags: str = "i") -> str:
    return q(f"(?{flags})" + regex)


def glob_sql(globs, name: str = "name") -> str:
    return "(" + " OR ".join(f"ends_with({name}, {q(g[1:])})" if g[0] == "*" else f"{name} = {q(g)}" for g in globs) + ")"


_SYS = SYSTEM_WORDS.replace("(", "(?:", 1)
# call, group-free; words that must not follow
_TAILS = {
    ("PI-003", 0): (_SYS + r"\s*=\s*[\"']", r"忽略|拒绝|ignore|refuse|不要|勿|forbidden|prohibited|must not"),
    ("TA-003", 0): (r"(?:\.run\(|\.invoke\(|\.process\(|\.execute\(|create_task\()",
                    r"user_id|auth|permission|scope|context|caller"),
    ("TA-003", 1): (r"Task\s*\([^)]*agent\s*=\s*\w+", r"context\s*=|user_id\s*="),
    ("TA-003", 2): (r"initiate_chat\s*\([^)]*", r"carryover\s*="),
    ("TA-003", 3): (r"StateGraph\s*\([^)]*\)", r"\bauth\b"),
    ("TA-003", 4): (r"(?:createChildAgent|spawnAgent|createAgent)\s*\([^)]*", r"userId|auth|permission|scope|context"),
}


def line_test(rule: RuleSpec, k: int, line: str = "line") -> str:
    tail = _TAILS.get((rule.rule_id, k))
    if tail is None:
        return f"regexp_matches({line}, {rx(rule.patterns[k].regex)})"
    call, words = tail
    return (
        f"(regexp_matches({line}, {rx(call)}) AND NOT regexp_matches("
        f"regexp_extract({line}, {rx('^.*' + call + '(.*)$', 'is')}, 1), {rx('(?:' + words + ')')}))"
    )


def source_ctes(base: str, where: str = "true") -> str:
    """``src`` (name and lines per file) and ``lines`` of a corpus CTE with target, path, content."""
    return (
        f"src AS MATERIALIZED (SELECT target, path, content, regexp_extract(path, '[^/]*$') AS name, "
        f"string_split(content, chr(10)) AS ls FROM {base} WHERE {where}), "
        "lines AS MATERIALIZED (SELECT target, path, name, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM src)"
    )


def line_hits(rules, match_globs: bool = True) -> str:
    tests = [
        f"CASE WHEN {glob_sql(r.globs) if match_globs else 'true'} AND {line_test(r, k)} THEN {r.ordinal * 100 + k} END"
        for r in rules if r.kind == "regex" for k, p in enumerate(r.patterns) if p.mode != FILE
    ]
    if not tests:
        return ""
    return (
        "SELECT target, path, ls, line_number, line_number AS match_ord, "
        f"unnest(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)) AS code, CAST(NULL AS VARCHAR) AS text FROM lines"
    )


def _where(globs) -> str:
    """The files a rule applies to; all of them where names do not count."""
    return "true" if globs is None else glob_sql(globs)


def _marked(regex: str, flags: str, code: int, keep: str = "true", globs=(), text: str = "CAST(NULL AS VARCHAR)") -> str:
    """File-wide matches of an RE2-safe regex, cut apart at a mark before each match."""
    return f"""
        SELECT target, path, ls, line_number, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS match_ord, {code} AS code, text FROM (
            SELECT target, path, ls, i,
                   1 + length(array_to_string(pieces[1:i], '')) - length(replace(array_to_string(pieces[1:i], ''), chr(10), '')) AS line_number,
                   {text} AS text
            FROM (SELECT target, path, ls, pieces, unnest(range(1, len(pieces))) AS i FROM (
                SELECT target, path, ls, string_split(regexp_replace(content, {rx('(' + regex + ')', flags)}, chr(57344) || '\\1', 'g'), chr(57344)) AS pieces
                FROM src WHERE {_where(globs)})))
        WHERE {keep}"""


_BOUND = rx(r"^\s*(?:def\s|class\s|@)")


def _block_end(n: str) -> str:
    return f"coalesce(list_min(list_filter(range({n} + 2, len(ls) + 1), lambda j: regexp_matches(ls[j], {_BOUND}))), len(ls) + 1)"


def _block_hits(header: str, inside: str, code: int, globs) -> str:
    """A header line, then at most 500 characters of its block up to the words looked for."""
    return f"""
        SELECT target, path, ls, n AS line_number, row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS match_ord, {code} AS code, CAST(NULL AS VARCHAR) AS text
        FROM (SELECT target, path, ls, n, array_to_string(ls[n + 1:{_block_end('n')} - 1], chr(10)) AS body
              FROM (SELECT target, path, ls, unnest(range(1, len(ls))) AS n FROM src WHERE {_where(globs)})
              WHERE regexp_matches(ls[n], {rx(header)}))
        WHERE regexp_matches(body, {rx('^.{0,500}?(?:' + inside + ')', 'is')})"""


_PERMISSION = "(?:permission|auth|workspace_id|current_user)"


def _route_hits(code: int, globs) -> str:
    return f"""
        SELECT target, path, ls, n AS line_number, row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS match_ord, {code} AS code, CAST(NULL AS VARCHAR) AS text
        FROM (SELECT target, path, ls, n, array_to_string(ls[n + 2:], chr(10)) AS rest,
                     array_to_string(ls[n + 2:{_block_end('n + 1')} - 1], chr(10)) AS body
              FROM (SELECT target, path, ls, unnest(range(1, len(ls) - 1)) AS n FROM src WHERE {_where(globs)})
              WHERE regexp_matches(ls[n], {rx('@app[.]route')}) AND regexp_matches(ls[n + 1], {rx('def[[:space:]]+[a-z0-9_]+')}))
        WHERE NOT regexp_matches(rest, {rx(_PERMISSION)})
           OR length(regexp_extract(rest, {rx('^(.*)' + _PERMISSION, 'is')}, 1)) + 1 <= least(500, length(body))"""


def file_hits(rules, match_globs: bool = True) -> list[str]:
    out = []
    for r in rules:
        code, globs = r.ordinal * 100, r.globs if match_globs else None
        if r.rule_id == "PI-002":
            out.append(_marked(USER_WORDS.replace("(", "(?:", 1) + r"\s*\)?\s*\n\s*" + MODEL_CALLS.replace("(", "(?:", 1), "is", code + 1, globs=globs))
        elif r.rule_id == "FW-001":
            head = r"def\s+\w+"
            out.append(_block_hits(head, r"subprocess\.|os\.system|os\.popen", code + 1, globs))
            out.append(_block_hits(head, r"os\.remove|shutil\.rmtree|Path\(.*\)\.unlink", code + 2, globs))
            out.append(_block_hits(head, r"requests\.(?:post|put|delete|patch)", code + 3, globs))
        elif r.rule_id == "FW-003":
            out.append(_block_hits(r"class\s+\w*Tool\w*", r"os\.system|subprocess\.", code + 1, globs))
        elif r.rule_id == "FW-004":
            out.append(_route_hits(code, globs))
        elif r.rule_id == "MCP-004":
            piece = f"regexp_extract(pieces[i + 1], {rx('^(?:' + DESCRIPTION_PLACES + ')')})"
            out.append(_marked(DESCRIPTION_PLACES, "i", code, keep=f"regexp_matches(text, {rx(INJECTION_PHRASES)})", globs=globs, text=piece))
    return out


def hits_cte(rules=ALL_RULES, match_globs: bool = True, whole_files: bool = True) -> str:
    parts = [p for p in [line_hits(rules, match_globs), *(file_hits(rules, match_globs) if whole_files else ())] if p]
    return (
        "hits AS MATERIALIZED (SELECT target, path, ls, CAST(line_number AS BIGINT) AS line_number, CAST(match_ord AS BIGINT) AS match_ord, "
        "CAST(code // 100 AS BIGINT) AS rule_ord, CAST(code % 100 AS BIGINT) AS pattern_ord, text FROM ("
        + " UNION ALL ".join(f"({p})" for p in parts) + "))"
    )


SNIPPET = (
    "coalesce(left(text, 500), array_to_string(list_transform(range(greatest(line_number - 3, 1), least(line_number + 3, len(ls)) + 1), "
    "lambda j: j || ': ' || ls[j]), chr(10)))"
)


def rules_cte(rules=ALL_RULES) -> str:
    rows = ", ".join(
        f"({r.ordinal}, {q(r.rule_id)}, {q(r.severity)}, [{', '.join(q(o) for o in r.owasp_ids)}], {q(r.title)}, {q(r.fix)}, {q(r.description)})"
        for r in rules
    )
    return f"rules(rule_ord, rule_id, severity, owasp_ids, title, fix, rule_text) AS (VALUES {rows})"


def patterns_cte(rules=ALL_RULES) -> str:
    rows = ", ".join(f"({r.ordinal}, {k}, {q(p.text)})" for r in rules for k, p in enumerate(r.patterns))
    return f"patterns(rule_ord, pattern_ord, pattern_text) AS (VALUES {rows})"


_PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
SKIPPED_SQL = "list_has_any(string_split(path, '/')[2:-2], [" + ", ".join(q(d) for d in SKIPPED_DIRS) + "])"
NAME_SQL = "regexp_extract(path, '[^/]*$')"
COLLECTED_SQL = f"(NOT {SKIPPED_SQL} AND {glob_sql(DEFAULT_GLOBS, NAME_SQL)})"


def minified_sql(content: str = "content") -> str:
    n = f"len(string_split({content}, chr(10)))"
    return (
        f"(contains(lower({NAME_SQL}), '.min.') OR contains({_PARENT}, 'Min') OR regexp_extract({_PARENT}, '[^/]*$') = 'min' "
        f"OR ({n} < 3 AND length(replace({content}, chr(10), '')) > 500) OR length({content}) / {n} > 400)"
    )


CONFIG_TEST_SQL = (
    "(" + " OR ".join(f"contains(lower(replace(path, '\\', '/')), {q(n)})" for n in CONFIG_NAMES)
    + """ OR contains(content, '"mcpServers"') OR (contains(content, '"mcp"') AND contains(content, '"servers"')))"""
)


def findings_ctes() -> str:
    """Numbered full findings of the scannable code files."""
    return numbered_ctes(CODE_FILES_SQL, "code_files", f"{COLLECTED_SQL} AND NOT {minified_sql()}", hits_cte())


def numbered_ctes(corpus: str, base: str, where: str, hits: str) -> str:
    return ", ".join([
        corpus,
        source_ctes(base, where),
        hits, rules_cte(), patterns_cte(),
        "findings AS MATERIALIZED (SELECT h.target, h.path, h.line_number, h.rule_ord, h.pattern_ord, h.match_ord, r.rule_id, r.severity, r.owasp_ids, r.title, r.fix, "
        f"CASE WHEN h.text IS NULL THEN p.pattern_text ELSE 'tool description holds the phrase: ' || left(regexp_extract(h.text, {rx(INJECTION_PHRASES)}), 120) END AS description, "
        f"{SNIPPET} AS code_snippet, "
        "row_number() OVER (PARTITION BY h.target ORDER BY h.path, h.rule_ord, h.pattern_ord, h.match_ord, h.line_number) - 1 AS finding_index, "
        "row_number() OVER (PARTITION BY h.target, h.path ORDER BY h.rule_ord, h.pattern_ord, h.match_ord, h.line_number) - 1 AS file_pos "
        "FROM hits h JOIN rules r USING (rule_ord) LEFT JOIN patterns p USING (rule_ord, pattern_ord))",
    ])

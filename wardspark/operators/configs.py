"""Tool-server configuration rules: JSON configs parsed once, looked at by three rules.

Written as SQL text, like all hit arrays (see ``hits``).
"""

from __future__ import annotations

from ..functions.sqltext import sql_text
from ..rules.fixed import (
    AUTH_ENV_WORDS, AUTH_FLAGS, AUTH_HEADERS, CONFIG_NAMES, REDACTED, SECRET_VALUE, SERVER_SNIPPET_CHARS,
    SHELL_COMMANDS, SNIPPET_CUT_MARK, WRITABLE_PATHS,
)
from .hits import NO_HITS, hit

_CONFIG = "array<struct<mcpServers:map<string,string>,mcp:struct<servers:map<string,string>>>>"
_SERVER = "struct<command:variant,args:variant,env:map<string,variant>,headers:map<string,variant>>"
_STRICT = "map('allowSingleQuotes', 'false')"
_NO_TEXTS = "CAST(array() AS array<string>)"


def _any_contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


def _forward_slashes(text: str) -> str:
    return f"replace({text}, {sql_text(chr(92))}, '/')"


def is_tool_config(path: str = "path", content: str = "content") -> str:
    """A known file name, or the keys of a tool-server config anywhere in the text."""
    by_name = _any_contains(f"lower({_forward_slashes(path)})", CONFIG_NAMES)
    return (
        f"""({by_name} OR contains({content}, '"mcpServers"') """
        f"""OR (contains({content}, '"mcp"') AND contains({content}, '"servers"')))"""
    )


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _last_wins(entries: str) -> str:
    """Map entries with one entry per key: first position, last value, as a reader with dicts gives.

    Sorted places tell the first and the last of equal keys, so the time is that of a sort however many entries there are.
    """
    plain = "transform(en, e -> named_struct('key', e.key, 'value', e.value))"
    firsts = "filter(s, (x, j) -> j = 0 OR s[greatest(j - 1, 0)].k <> x.k)"
    lasts = "filter(s, (x, j) -> j = size(s) - 1 OR s[least(j + 1, size(s) - 1)].k <> x.k)"
    ends = _bind(lasts, "z", f"sort_array(transform({firsts}, (f, m) -> named_struct('i', f.i, 'last', z[m].i)))")
    single = f"transform({ends}, o -> named_struct('key', en[o.i].key, 'value', en[o.last].value))"
    once = _bind("sort_array(transform(en, (e, i) -> named_struct('k', e.key, 'i', i)))", "s", single)
    return _bind(entries, "en", f"CASE WHEN size(array_distinct(transform(en, e -> e.key))) = size(en) THEN {plain} ELSE {once} END")


def tool_servers(content: str = "content") -> str:
    """``array<struct<name, text, def>>`` of the object-valued servers; null where there is no config.

    The text must be exactly one JSON value (inside brackets any rest is an
    error).  ``text`` is the server definition as compact JSON.
    """
    parsed = f"from_json(concat('[', {content}, ']'), '{_CONFIG}', {_STRICT})"
    entries = (
        f"transform(array({parsed}), "
        "c -> CASE WHEN size(c) = 1 THEN map_entries(coalesce(c[0].mcpServers, c[0].mcp.servers)) END)"
    )
    return f"""
        flatten(transform({entries}, entries ->
            transform(filter({_last_wins('entries')}, e -> startswith(e.value, '{{')),
                      e -> named_struct('name', e.key, 'text', e.value, 'def', from_json(e.value, '{_SERVER}', {_STRICT})))))"""


def _text_or_blank(value: str) -> str:
    """The string a variant holds; blank for any other type."""
    return f"coalesce(CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({value}, '$', 'string') END, '')"


def command_text(server: str) -> str:
    return _text_or_blank(f"{server}.command")


def has_auth(server: str) -> str:
    """Auth in a header name, in an environment name, or as a command-line flag (also in a command given as a list)."""
    headers = f"transform(coalesce(map_keys({server}.headers), {_NO_TEXTS}), h -> lower(h))"
    env = f"coalesce(map_keys({server}.env), {_NO_TEXTS})"
    args = f"coalesce(try_variant_get({server}.args, '$', 'array<variant>'), CAST(array() AS array<variant>))"
    line = f"lower(concat_ws(' ', coalesce(nullif({command_text(server)}, ''), to_json({server}.command)), array_join(transform({args}, a -> {_text_or_blank('a')}), ' ')))"
    names = ", ".join(sql_text(h) for h in AUTH_HEADERS)
    return (
        f"(arrays_overlap({headers}, array({names})) OR exists({env}, k -> {_any_contains('lower(k)', AUTH_ENV_WORDS)}) "
        f"OR {_any_contains(line, AUTH_FLAGS)})"
    )


def _secret_entries(entries: str) -> str:
    text = "try_variant_get(e.value, '$', 'string')"
    return (
        f"filter({entries}, e -> schema_of_variant(e.value) = 'STRING' AND NOT startswith({text}, '$') "
        f"AND rlike({text}, {sql_text('(?dU)' + SECRET_VALUE)}))"
    )


def literal_secrets(server: str) -> str:
    """Names of environment entries whose value is a literal secret."""
    return f"coalesce(transform({_secret_entries(_last_wins(f'map_entries({server}.env)'))}, e -> e.key), {_NO_TEXTS})"


def without_secrets(text: str, server: str) -> str:
    """JSON text of a server with the literal secrets of its environment taken out, those of repeated names too."""
    written = "to_json(array(try_variant_get(e.value, '$', 'string')))"
    values = f"transform({_secret_entries(f'map_entries({server}.env)')}, e -> substring({written}, 3, length({written}) - 4))"
    return f"aggregate(coalesce({values}, {_NO_TEXTS}), {text}, (t, v) -> replace(t, v, {sql_text(REDACTED)}))"


def command_problem(command: str) -> str:
    """Why a command is suspicious, or null.  Paths are tried in their listed order; a bare shell wins."""
    lowered = f"lower({_forward_slashes(command)})"
    shells = ", ".join(sql_text(c) for c in SHELL_COMMANDS)
    tests = [f"WHEN {command} IN ({shells}) THEN concat('is the shell interpreter ', {command}, ', so arguments run as code')"]
    tests += [
        f"WHEN contains({lowered}, {sql_text(p.lower())}) THEN {sql_text(f'references {p}, which others may be able to write')}"
        for p in WRITABLE_PATHS
    ]
    return "CASE " + " ".join(tests) + " END"


#: What JSON text consists of: texts (also one that is cut off), signs, and numbers or words.
_TOKENS = r'"(?:[^"\\]|\\.)*"?|[{}\[\],:]|[^{}\[\],:"]+'


def _indented(text: str) -> str:
    """Compact JSON with every entry on a line of its own, two blanks a level; empty brackets stay together."""
    step = "repeat('  ', a.depth)"
    opens, closes = "t IN ('{', '[')", "t IN ('}', ']')"
    before = f"CASE WHEN NOT {closes} AND a.last IN ('open', ',') THEN concat('\n', {step}) WHEN {closes} AND a.last <> 'open' THEN concat('\n', repeat('  ', a.depth - 1)) ELSE '' END"
    shown = "CASE WHEN t = ':' THEN ': ' ELSE t END"
    last = f"CASE WHEN {opens} THEN 'open' WHEN t = ',' THEN ',' ELSE '' END"
    depth = f"a.depth + CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END"
    place = "CASE WHEN t IN (',', ':') THEN '' ELSE " + before + " END"
    return (
        f"aggregate(regexp_extract_all({text}, {sql_text(_TOKENS)}, 0), named_struct('out', '', 'depth', 0, 'last', ''), "
        f"(a, t) -> named_struct('out', concat(a.out, {place}, {shown}), 'depth', {depth}, 'last', {last}), a -> a.out)"
    )


def _quoted(name: str) -> str:
    """A text as it stands in JSON, with its quotes."""
    return f"substring(to_json(array({name})), 2, length(to_json(array({name}))) - 2)"


def pretty_server(name: str, text: str) -> str:
    """``{name: definition}`` as indented JSON, keys in the order of the file.

    Only as much is written as a snippet can show (the indented text is never shorter than the compact one).
    """
    return _indented(f"left(concat('{{', {_quoted(name)}, ':', {text}, '}}'), {SERVER_SNIPPET_CHARS + 1})")


def cut_snippet(text: str, mark: str = "") -> str:
    limit = SERVER_SNIPPET_CHARS
    return _bind(text, "full", f"CASE WHEN length(full) > {limit} THEN concat(left(full, {limit}), {sql_text(mark)}) ELSE full END")


def key_line(key: str) -> str:
    """First line of the file that holds the key in double or single quotes, else 1."""
    quoted = [f"contains(l, concat({sql_text(q)}, {key}, {sql_text(q)}))" for q in ('"', "'")]
    lines = f"transform(_lines, (l, i) -> CASE WHEN {quoted[0]} OR {quoted[1]} THEN i + 1 END)"
    return f"coalesce(try_element_at(array_compact({lines}), 1), 1)"


def key_index() -> str:
    """Everything between two neighbouring quotes of a line with the first line it stands on, sorted: made once for a file.

    A text without that quote stands in quotes on a line exactly if it lies between two neighbouring ones.
    """
    between = [_bind(f"split(l, {sql_text(q)})", "p", "slice(p, 2, greatest(size(p) - 2, 0))") for q in ('"', "'")]
    found = f"flatten(transform(_lines, (l, i) -> transform(concat({', '.join(between)}), k -> named_struct('k', k, 't', 0, 'i', i + 1))))"
    return _bind(f"sort_array({found})", "s", "filter(s, (x, j) -> j = 0 OR s[greatest(j - 1, 0)].k <> x.k)")


def key_lines(keys: str, index: str) -> str:
    """``key_line`` of every key of an array, by merging the sorted keys with the index of the file.

    Behind its entry of the index (``t`` 0) stand the places that ask for a key (``t`` 1); the first of them takes the
    line over and the others repeat it.
    """
    asked = "transform(ks, (k, i) -> named_struct('k', k, 't', 1, 'i', i))"
    before = "w[greatest(j - 1, 0)]"
    marked = (
        f"filter(transform(w, (x, j) -> named_struct('t', x.t, 'i', x.i, 'new', j = 0 OR {before}.k <> x.k OR {before}.t = 0, "
        f"'line', CASE WHEN j > 0 AND {before}.k = x.k AND {before}.t = 0 THEN {before}.i END)), x -> x.t = 1)"
    )
    starts = "filter(transform(e, (x, j) -> named_struct('j', j, 'new', x.new, 'line', coalesce(x.line, 1))), x -> x.new)"
    each = "flatten(transform(b, (f, m) -> array_repeat(f.line, CASE WHEN m + 1 < size(b) THEN b[m + 1].j ELSE size(e) END - f.j)))"
    placed = _bind(each, "g", "transform(sort_array(transform(e, (x, j) -> named_struct('i', x.i, 'line', g[j]))), y -> y.line)")
    merged = _bind(f"sort_array(concat({index}, {asked}))", "w", _bind(marked, "e", _bind(starts, "b", placed)))
    # a key that holds a quote itself is looked for line by line
    odd = f"CASE WHEN contains(k, {sql_text(chr(34))}) OR contains(k, {sql_text(chr(39))}) THEN {key_line('k')} ELSE ls[n] END"
    return _bind(keys, "ks", _bind(merged, "ls", f"transform(ks, (k, n) -> {odd})"))


def config_hits(rules, flag: str, snippets: bool) -> str:
    """Hits of the config rules of one file, from the columns ``path``, ``content`` and ``_lines``."""
    parts = [_RULE_HITS[r.kind](r, "servers", snippets) for r in rules]
    found = _bind(key_index(), "keyed", f"concat({', '.join(parts)})")
    joined = _bind(tool_servers(), "servers", f"CASE WHEN size(servers) > 0 THEN {found} END")
    return f"coalesce(CASE WHEN {flag} AND {is_tool_config()} THEN {joined} END, {NO_HITS})"


def _snippet(text: str, snippets: bool) -> dict:
    return {"snippet": text} if snippets else {}


def _with_lines(found: str, key: str, hit_: str) -> str:
    """Hits ``hit_`` of the elements ``s`` of an array, with the line ``n`` of each element's key."""
    rows = f"transform(arrays_zip(f, {key_lines(f'transform(f, s -> s.{key})', 'keyed')}), (z, i) -> {_bind('z', 'q', hit_)})"
    return _bind(found, "f", f"CASE WHEN size(f) > 0 THEN {rows} ELSE {NO_HITS} END")


def _auth_hits(rule, servers: str, snippets: bool) -> str:
    text = cut_snippet(pretty_server("q.f.name", without_secrets("q.f.text", "q.f.def")), SNIPPET_CUT_MARK)
    found = hit(rule.ordinal, 0, "q.`1`", "i", note="concat('server ', q.f.name, ' has no authentication')", **_snippet(text, snippets))
    return _with_lines(f"filter({servers}, s -> NOT {has_auth('s.def')})", "name", found)


def _env_hits(rule, servers: str, snippets: bool) -> str:
    keys = (
        f"flatten(transform({servers}, s -> transform({literal_secrets('s.def')}, "
        "k -> named_struct('name', s.name, 'key', k))))"
    )
    redacted = pretty_server("q.f.name", f"concat('{{\"env\":{{', {_quoted('q.f.key')}, ':', {_quoted(sql_text(REDACTED))}, '}}}}')")
    found = hit(rule.ordinal, 0, "q.`1`", "i",
                note="concat('server ', q.f.name, ' stores a literal secret in env ', q.f.key)", **_snippet(redacted, snippets))
    return _with_lines(keys, "key", found)


def _command_hits(rule, servers: str, snippets: bool) -> str:
    command = command_text("q.f.def")
    found = hit(rule.ordinal, 0, "q.`1`", "i",
                note=f"concat('server ', q.f.name, ' command ', {command}, ' ', {command_problem(command)})",
                **_snippet(cut_snippet(pretty_server("q.f.name", without_secrets("q.f.text", "q.f.def"))), snippets))
    return _with_lines(f"filter({servers}, s -> {command_problem(command_text('s.def'))} IS NOT NULL)", "name", found)


_RULE_HITS = {"config_auth": _auth_hits, "config_env": _env_hits, "config_command": _command_hits}

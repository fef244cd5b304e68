"""Detection queries: one per rule, the generic scans, configs, sources and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.functions.text import decode_content
from wardspark.operators.detect import describe, scan, scan_files
from wardspark.operators.filters import in_skipped_dir, is_minified, missing_targets, select_targets, tool_config
from wardspark.functions.paths import file_name
from wardspark.rules import ALL_RULES, FILE, LINE, rule
from wardspark.rules.fixed import DEFAULT_GLOBS, INJECTION_PHRASES, MIN_RULES
from wardspark.rules.spec import any_glob, rules_table

from .corpora import ANY_TEXTS_SQL, CODE_FILES_SQL, CONFIGS_SQL, TEXT_ROWS_SQL, any_texts, code_files, configs, spread, table, text_rows
from .duck import (
    COLLECTED_SQL, CONFIG_TEST_SQL, NAME_SQL, SKIPPED_SQL, SNIPPET, glob_sql, hits_cte, minified_sql, q, rules_cte, source_ctes,
)

QUERIES, ORACLE = {}, {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as the SQL side has them."""
    return df.select(*[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


# --- one query per rule ------------------------------------------------------
def _rule_query(r):
    def run(spark, sf_dir):
        found = scan_files(code_files(spark, sf_dir).select("target", "path", "content"), (r,))
        return flat(found.select("path", "pattern_ord", "line_number", "code_snippet"))
    return run


for _r in ALL_RULES:
    if _r.kind in ("regex", "tool_description"):
        QUERIES[_r.name] = _rule_query(_r)
        ORACLE[_r.name] = (
            f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')}, {hits_cte((_r,))} "
            f"SELECT path, pattern_ord, line_number, {SNIPPET} AS code_snippet FROM hits"
        )


# --- config rules: parsed with JSON functions on the SQL side -----------------
# DuckDB's reader lets a comma stand before a closing bracket; strict JSON does not.
def _servers_sql(ctes: str, base: str, where: str) -> str:
    return f"""{ctes},
parsed AS (SELECT target, path, content, string_split(content, chr(10)) AS ls,
                  coalesce(json_extract(content, '$.mcpServers'), json_extract(content, '$.mcp.servers')) AS servers
           FROM {base} WHERE {where} AND {CONFIG_TEST_SQL} AND json_valid(content)
             AND NOT regexp_matches(content, ',\\s*[}}\\]]')),
named AS (SELECT *, unnest(json_keys(servers)) AS server FROM parsed),
server AS (SELECT *, json_extract(servers, '$."' || server || '"') AS def FROM named),
defs AS (SELECT *, CASE WHEN json_type(def, '$.command') = 'VARCHAR' THEN json_extract_string(def, '$.command') ELSE '' END AS command,
                coalesce(list_transform(json_keys(def, '$.headers'), lambda h: lower(h)), []) AS headers,
                coalesce(json_keys(def, '$.env'), []) AS envs,
                coalesce(array_to_string(CAST(json_extract(def, '$.args') AS VARCHAR[]), ' '), '') AS args
         FROM server WHERE json_type(def) = 'OBJECT')"""


_SERVERS_SQL = _servers_sql(CONFIGS_SQL, "configs", f"ends_with({NAME_SQL}, '.json')")
_SECRET_TEST = (
    "json_type({v}) = 'VARCHAR' AND NOT starts_with(json_extract_string({v}, '$'), '$') AND regexp_matches(json_extract_string({v}, '$'), "
    "'sk-[A-Za-z0-9_-]{{10,}}|AKIA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}|xox[bpsar]-[0-9]+-[0-9]+-[A-Za-z0-9]{{20,}}|[A-Za-z0-9+/=]{{32,}}')"
)


def _entries_sql(obj: str, depth: int, value) -> str:
    """Entries of an object on lines of their own; ``value`` gives the SQL of an entry's value."""
    k, blanks = f"k{depth}", " " * depth
    v = f"json_extract({obj}, '$.\"' || {k} || '\"')"
    rows = f"list_transform(json_keys({obj}), lambda {k}: '{blanks}\"' || {k} || '\": ' || {value(k, v)})"
    return f"CASE WHEN len(json_keys({obj})) = 0 THEN '{{}}' ELSE '{{' || chr(10) || array_to_string({rows}, ',' || chr(10)) || chr(10) || '{' ' * (depth - 2)}}}' END"


def _value_sql(key: str, v: str, hide: bool) -> str:
    """A value inside a server definition, with objects and lists opened up and, if asked, secrets of the environment hidden."""
    def inner(k2, v2):
        return f"CASE WHEN {key} = 'env' AND {_SECRET_TEST.format(v=v2)} THEN '\"***REDACTED***\"' ELSE CAST({v2} AS VARCHAR) END" if hide else f"CAST({v2} AS VARCHAR)"
    items = f"array_to_string(list_transform(CAST({v} AS JSON[]), lambda e: '      ' || CAST(e AS VARCHAR)), ',' || chr(10))"
    listed = f"CASE WHEN json_array_length({v}) = 0 THEN '[]' ELSE '[' || chr(10) || {items} || chr(10) || '    ]' END"
    return f"CASE json_type({v}) WHEN 'OBJECT' THEN {_entries_sql(v, 6, inner)} WHEN 'ARRAY' THEN {listed} ELSE CAST({v} AS VARCHAR) END"


def _pretty_sql(hide: bool = True) -> str:
    """``{server: def}`` indented by two blanks a level, keys in their order."""
    body = _entries_sql("def", 4, lambda k, v: _value_sql(k, v, hide))
    return f"'{{' || chr(10) || '  \"' || server || '\": ' || {body} || chr(10) || '}}'"


def _cut_sql(text: str, mark: str) -> str:
    return f"CASE WHEN length({text}) > 600 THEN left({text}, 600) || {mark} ELSE {text} END"


def _key_line_sql(key: str) -> str:
    return (
        f"coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda j: contains(ls[j], '\"' || {key} || '\"') "
        f"OR contains(ls[j], '''' || {key} || ''''))), 1)"
    )


def _config_query(rule_id):
    def run(spark, sf_dir):
        found = scan(configs(spark, sf_dir), (rule(rule_id),))
        return flat(found.select("path", "line_number", "description", "code_snippet"))
    return run


QUERIES["mcp_no_auth"] = _config_query("MCP-001")
_AUTH_SQL = (
    "(list_has_any(headers, ['authorization', 'auth', 'api_key', 'apikey', 'token', 'oauth', 'credentials', 'access_token', 'x-api-key']) "
    "OR len(list_filter(envs, lambda e: regexp_matches(lower(e), 'token|key|secret|auth|password|oauth'))) > 0 "
    "OR regexp_matches(lower(command || ' ' || args), '--token|--key|--auth|--api-key|--bearer'))"
)
ORACLE["mcp_no_auth"] = (
    f"WITH {_SERVERS_SQL} SELECT path, CAST({_key_line_sql('server')} AS BIGINT) AS line_number, "
    f"'server ' || server || ' has no authentication' AS description, {_cut_sql(_pretty_sql(), "chr(10) || '... [truncated]'")} AS code_snippet FROM defs WHERE NOT {_AUTH_SQL}"
)
QUERIES["mcp_env_secret"] = _config_query("MCP-002")
ORACLE["mcp_env_secret"] = (
    f"WITH {_SERVERS_SQL}, entries AS (SELECT path, ls, server, unnest(envs) AS k, def FROM defs), "
    "vals AS (SELECT *, json_extract(def, '$.env.\"' || k || '\"') AS v FROM entries) "
    f"SELECT path, CAST({_key_line_sql('k')} AS BIGINT) AS line_number, 'server ' || server || ' stores a literal secret in env ' || k AS description, "
    "'{' || chr(10) || '  \"' || server || '\": {' || chr(10) || '    \"env\": {' || chr(10) || '      \"' || k || '\": \"***REDACTED***\"' || chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}' AS code_snippet "
    "FROM vals WHERE json_type(v) = 'VARCHAR' AND NOT starts_with(json_extract_string(v, '$'), '$') AND regexp_matches(json_extract_string(v, '$'), "
    "'sk-[A-Za-z0-9_-]{10,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[bpsar]-[0-9]+-[0-9]+-[A-Za-z0-9]{20,}|[A-Za-z0-9+/=]{32,}')"
)
QUERIES["mcp_command_path"] = _config_query("MCP-003")
_PATHS = ["node_modules/.bin", ".venv", "venv", "env/bin", "./", "../", "~/", "%USERPROFILE%", "${HOME}"]
_PROBLEM_SQL = (
    "CASE WHEN command IN ('sh', 'bash', 'cmd', 'cmd.exe', 'powershell', 'pwsh') "
    "THEN 'is the shell interpreter ' || command || ', so arguments run as code' "
    + " ".join(f"WHEN contains(replace(lower(command), '\\', '/'), {q(p.lower())}) THEN {q(f'references {p}, which others may be able to write')}" for p in _PATHS)
    + " END"
)
ORACLE["mcp_command_path"] = (
    f"WITH {_SERVERS_SQL} SELECT path, CAST({_key_line_sql('server')} AS BIGINT) AS line_number, "
    f"'server ' || server || ' command ' || command || ' ' || ({_PROBLEM_SQL}) AS description, {_cut_sql(_pretty_sql(), "''")} AS code_snippet FROM defs WHERE ({_PROBLEM_SQL}) IS NOT NULL"
)


def structural_rule_scan(spark, sf_dir):
    rules = tuple(r for r in ALL_RULES if r.kind.startswith("config_"))
    found = describe(scan_files(configs(spark, sf_dir), rules, snippets=False), rules)
    return flat(found.groupBy("target", "rule_id", "severity").agg(F.count("*").alias("n_findings"), F.sum("line_number").alias("sum_line")))


QUERIES["structural_rule_scan"] = structural_rule_scan
ORACLE["structural_rule_scan"] = f"""WITH {_SERVERS_SQL},
entries AS (SELECT target, ls, unnest(envs) AS k, def FROM defs),
vals AS (SELECT *, json_extract(def, '$.env."' || k || '"') AS v FROM entries),
found AS (
  SELECT target, 'MCP-001' AS rule_id, 'high' AS severity, {_key_line_sql('server')} AS n FROM defs WHERE NOT {_AUTH_SQL}
  UNION ALL SELECT target, 'MCP-003', 'medium', {_key_line_sql('server')} FROM defs WHERE ({_PROBLEM_SQL}) IS NOT NULL
  UNION ALL SELECT target, 'MCP-002', 'critical', {_key_line_sql('k')} FROM vals
    WHERE json_type(v) = 'VARCHAR' AND NOT starts_with(json_extract_string(v, '$'), '$')
      AND regexp_matches(json_extract_string(v, '$'), 'sk-[A-Za-z0-9_-]{{10,}}|AKIA[A-Z0-9]{{16}}|[A-Za-z0-9+/=]{{32,}}'))
SELECT target, rule_id, severity, count(*) AS n_findings, CAST(sum(n) AS BIGINT) AS sum_line FROM found GROUP BY ALL"""


def extract_mcp_servers(spark, sf_dir):
    from wardspark.operators.configs import tool_servers

    found = configs(spark, sf_dir).where(tool_config() & file_name(F.col("path")).endswith(".json"))
    rows = found.select("path", F.explode_outer(F.expr(tool_servers())).alias("s")).where("s is not null")
    return rows.select("path", F.col("s.name").alias("server"), F.expr("try_variant_get(s.def.command, '$', 'string')").alias("command"))


QUERIES["extract_mcp_servers"] = extract_mcp_servers
ORACLE["extract_mcp_servers"] = (
    f"WITH {_SERVERS_SQL} SELECT path, server, json_extract_string(def, '$.command') AS command FROM defs"
)


def pretty_json_truncate(spark, sf_dir):
    """Every server definition as a snippet shows it, secrets included: this is the layout alone."""
    from wardspark.operators.configs import cut_snippet, pretty_server, tool_servers

    found = configs(spark, sf_dir).where(tool_config() & file_name(F.col("path")).endswith(".json"))
    rows = found.select("path", F.explode_outer(F.expr(tool_servers())).alias("s")).where("s is not null")
    return rows.select("path", F.col("s.name").alias("server"), F.expr(cut_snippet(pretty_server("s.name", "s.text"), "\n... [truncated]")).alias("pretty_json"))


QUERIES["pretty_json_truncate"] = pretty_json_truncate
ORACLE["pretty_json_truncate"] = (
    f"WITH {_SERVERS_SQL}, one AS (SELECT path, server, {_pretty_sql(hide=False)} AS t FROM defs) "
    "SELECT path, server, CASE WHEN length(t) > 600 THEN left(t, 600) || chr(10) || '... [truncated]' ELSE t END AS pretty_json FROM one"
)


def json_key_line(spark, sf_dir):
    from wardspark.functions.text import split_lines
    from wardspark.operators.configs import key_line

    c = configs(spark, sf_dir).select("path", split_lines(F.col("content")).alias("_lines"))
    keys = ("command", "env", "API_KEY", "second", "absent")
    return flat(c.select("path", *[F.expr(key_line(f"'{k}'")).alias(f"line_{k.lower()}") for k in keys]))


QUERIES["json_key_line"] = json_key_line
ORACLE["json_key_line"] = (
    f"WITH {CONFIGS_SQL}, parsed AS (SELECT path, string_split(content, chr(10)) AS ls FROM configs) SELECT path, "
    + ", ".join(f"CAST({_key_line_sql(q(k))} AS BIGINT) AS line_{k.lower()}" for k in ("command", "env", "API_KEY", "second", "absent"))
    + " FROM parsed"
)


def redact_secret(spark, sf_dir):
    from wardspark.functions.text import redact
    from wardspark.rules.fixed import SECRET_VALUE

    return configs(spark, sf_dir).select("path", redact(F.col("content"), SECRET_VALUE).alias("safe_content"))


QUERIES["redact_secret"] = redact_secret
ORACLE["redact_secret"] = (
    f"WITH {CONFIGS_SQL} SELECT path, regexp_replace(content, 'sk-[A-Za-z0-9_-]{{10,}}|AKIA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}"
    "|xox[bpsar]-\\d+-\\d+-[A-Za-z0-9]{20,}|[A-Za-z0-9+/=]{32,}', '***REDACTED***', 'g') AS safe_content FROM configs"
)


# --- generic scans ----------------------------------------------------------------
_LINE_RULES = tuple(r for r in ALL_RULES if r.kind == "regex")


def line_rule_scan(spark, sf_dir):
    rules = tuple(r for r in _LINE_RULES if any(p.mode == LINE for p in r.patterns))
    found = scan_files(code_files(spark, sf_dir), rules, snippets=False, modes=(LINE,))
    line_codes = [r.ordinal * 100 + k for r in rules for k, p in enumerate(r.patterns) if p.mode == LINE]
    counted = found.groupBy("target", "rule_ord", "pattern_ord").agg(F.count("*").alias("n_findings"), F.sum("line_number").alias("sum_line"))
    return flat(counted.where((F.col("rule_ord") * 100 + F.col("pattern_ord")).isin(line_codes)))


QUERIES["line_rule_scan"] = line_rule_scan
_LINE_CODES = ", ".join(str(r.ordinal * 100 + k) for r in _LINE_RULES for k, p in enumerate(r.patterns) if p.mode == LINE)
_FILE_CODES = ", ".join(str(r.ordinal * 100 + k) for r in _LINE_RULES for k, p in enumerate(r.patterns) if p.mode == FILE)
_COUNTED = "SELECT target, rule_ord, pattern_ord, count(*) AS n_findings, CAST(sum(line_number) AS BIGINT) AS sum_line FROM hits"
ORACLE["line_rule_scan"] = (
    f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')}, {hits_cte(_LINE_RULES)} {_COUNTED} "
    f"WHERE rule_ord * 100 + pattern_ord IN ({_LINE_CODES}) GROUP BY ALL"
)


def file_rule_scan(spark, sf_dir):
    rules = tuple(r for r in _LINE_RULES if any(p.mode == FILE for p in r.patterns))
    found = scan_files(code_files(spark, sf_dir), rules, snippets=False, modes=(FILE,))
    codes = [r.ordinal * 100 + k for r in rules for k, p in enumerate(r.patterns) if p.mode == FILE]
    counted = found.groupBy("target", "rule_ord", "pattern_ord").agg(F.count("*").alias("n_findings"), F.sum("line_number").alias("sum_line"))
    return flat(counted.where((F.col("rule_ord") * 100 + F.col("pattern_ord")).isin(codes)))


QUERIES["file_rule_scan"] = file_rule_scan
ORACLE["file_rule_scan"] = (
    f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')}, {hits_cte(_LINE_RULES)} {_COUNTED} "
    f"WHERE rule_ord * 100 + pattern_ord IN ({_FILE_CODES}) GROUP BY ALL"
)


def table_corpus_scan(spark, sf_dir):
    """All rules over all texts, whatever they are called: what applies is decided by the content."""
    rows = any_texts(spark, sf_dir).withColumnRenamed("source", "target")
    found = scan(rows, ALL_RULES, match_globs=False, snippets=False)
    return flat(found.groupBy("target", "path", "rule_id", "pattern_ord", "line_number").agg(F.count("*").alias("n_findings")))


QUERIES["table_corpus_scan"] = table_corpus_scan
_TEXT_SRC = "texts AS (SELECT source AS target, path, content FROM any_texts)"
_PATTERN_RULES = tuple(r for r in ALL_RULES if not r.kind.startswith("config_"))
ORACLE["table_corpus_scan"] = (
    f"WITH {_servers_sql(f'{ANY_TEXTS_SQL}, {_TEXT_SRC}', 'texts', 'true')}, {source_ctes('texts')}, {hits_cte(_PATTERN_RULES, match_globs=False)}, {rules_cte()}, "
    "entries AS (SELECT target, path, ls, unnest(envs) AS k, def FROM defs), "
    "vals AS (SELECT *, json_extract(def, '$.env.\"' || k || '\"') AS v FROM entries), "
    "found AS (SELECT target, path, rule_id, pattern_ord, line_number FROM hits JOIN rules USING (rule_ord) "
    f"UNION ALL SELECT target, path, 'MCP-001', 0, {_key_line_sql('server')} FROM defs WHERE NOT {_AUTH_SQL} "
    f"UNION ALL SELECT target, path, 'MCP-003', 0, {_key_line_sql('server')} FROM defs WHERE ({_PROBLEM_SQL}) IS NOT NULL "
    f"UNION ALL SELECT target, path, 'MCP-002', 0, {_key_line_sql('k')} FROM vals WHERE {_SECRET_TEST.format(v='v')}) "
    "SELECT target, path, rule_id, CAST(pattern_ord AS BIGINT) AS pattern_ord, CAST(line_number AS BIGINT) AS line_number, count(*) AS n_findings FROM found GROUP BY ALL"
)


def files_x_rules(spark, sf_dir):
    """How many files each rule applies to, by extension test, without pairing files with rules."""
    rules = ALL_RULES
    name = file_name(F.col("path"))
    files = code_files(spark, sf_dir).select("target", "path")
    counts = files.groupBy("target").agg(*[F.count_if(any_glob(name, r.globs)).alias(r.rule_id) for r in rules])
    return counts.unpivot("target", [f"`{r.rule_id}`" for r in rules], "rule_id", "n_files")


QUERIES["files_x_rules"] = files_x_rules
_NAMED = f"{CODE_FILES_SQL}, named AS (SELECT target, path, {NAME_SQL} AS name FROM code_files)"
ORACLE["files_x_rules"] = f"WITH {_NAMED} " + " UNION ALL ".join(
    f"SELECT target, {q(r.rule_id)} AS rule_id, CAST(count(*) FILTER (WHERE {glob_sql(r.globs)}) AS BIGINT) AS n_files FROM named GROUP BY target" for r in ALL_RULES
)


def rule_registry(spark, sf_dir):
    """The rule set in evaluation order with the findings each rule has on the corpus."""
    rules = rules_table(spark, ALL_RULES)
    counts = scan_files(code_files(spark, sf_dir), ALL_RULES, snippets=False).groupBy("rule_ord").agg(F.count("*").alias("n"))
    out = rules.join(counts, "rule_ord", "left")
    return flat(out.select("rule_ord", "rule_id", "severity", F.array_join("owasp_ids", ",").alias("owasp"), "n_patterns",
                           F.coalesce("n", F.lit(0)).alias("n_findings"), F.lit(len(ALL_RULES) >= MIN_RULES).alias("enough_rules")))


QUERIES["rule_registry"] = rule_registry
_N_PATTERNS = ", ".join(f"({r.ordinal}, {len(r.patterns)})" for r in ALL_RULES)
ORACLE["rule_registry"] = (
    f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')}, {hits_cte()}, {rules_cte()}, np(rule_ord, n_patterns) AS (VALUES {_N_PATTERNS}), "
    "c AS (SELECT rule_ord, count(*) AS n FROM hits GROUP BY 1) "
    "SELECT CAST(r.rule_ord AS BIGINT) AS rule_ord, rule_id, severity, array_to_string(owasp_ids, ',') AS owasp, CAST(n_patterns AS BIGINT) AS n_patterns, "
    "coalesce(n, 0) AS n_findings, (SELECT count(*) FROM rules) >= 4 AS enough_rules FROM rules r JOIN np USING (rule_ord) LEFT JOIN c USING (rule_ord)"
)


# --- sources ------------------------------------------------------------------------
def _requests(spark, sf_dir):
    """A directory per nation (some do not exist) and the first and last file of every directory by name."""
    dirs = table(spark, sf_dir, "nation").select(F.concat(F.lit("repo"), F.col("n_nationkey").cast("string")).alias("request"))
    ends = code_files(spark, sf_dir).groupBy("target").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    return dirs.unionByName(ends.select(F.explode(F.array("a", "b")).alias("request")))


_REQUESTS_SQL = (
    "requests AS (SELECT 'repo' || n_nationkey AS request FROM nation UNION ALL SELECT min(path) FROM code_files GROUP BY target "
    "UNION ALL SELECT max(path) FROM code_files GROUP BY target)"
)


def source_file_scan(spark, sf_dir):
    files = code_files(spark, sf_dir).select("target", "path")
    picked = select_targets(files, _requests(spark, sf_dir))
    return picked.groupBy("request").agg(F.count("*").alias("n_files"))


QUERIES["source_file_scan"] = source_file_scan
ORACLE["source_file_scan"] = (
    f"WITH {CODE_FILES_SQL}, {_REQUESTS_SQL} SELECT request, count(*) AS n_files FROM requests JOIN code_files ON path = request "
    f"OR (target = request AND {COLLECTED_SQL}) GROUP BY 1"
)


def missing_target_finding(spark, sf_dir):
    files = code_files(spark, sf_dir).select("target", "path")
    return flat(missing_targets(files, _requests(spark, sf_dir)))


QUERIES["missing_target_finding"] = missing_target_finding
ORACLE["missing_target_finding"] = (
    f"WITH {CODE_FILES_SQL}, {_REQUESTS_SQL} SELECT DISTINCT request AS target, 'engine' AS rule_id, 'Target not found' AS title, 'info' AS severity, "
    "request AS path, CAST(0 AS BIGINT) AS line_number, 'Path does not exist: ' || request AS description, CAST(0 AS BIGINT) AS total_checks "
    "FROM requests WHERE request NOT IN (SELECT target FROM code_files) AND request NOT IN (SELECT path FROM code_files)"
)


def file_content_decode(spark, sf_dir):
    """Texts as bytes with mixed newlines and a bad byte at the end of some, decoded back."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    newline = F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    raw = F.replace("text", F.lit("\n"), newline).cast("binary")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    text = decode_content(raw)
    return flat(docs.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).alias("n_chars")))


QUERIES["file_content_decode"] = file_content_decode
ORACLE["file_content_decode"] = (
    "WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END AS text FROM documents) "
    "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM t"
)

# --- filters ----------------------------------------------------------------------
QUERIES["skip_dirs_filter"] = lambda spark, sf_dir: code_files(spark, sf_dir).where(
    ~in_skipped_dir(F.col("path"), F.col("target"))).select("path")
ORACLE["skip_dirs_filter"] = f"WITH {CODE_FILES_SQL} SELECT path FROM code_files WHERE NOT {SKIPPED_SQL}"

QUERIES["file_glob_filter"] = lambda spark, sf_dir: code_files(spark, sf_dir).where(
    any_glob(file_name(F.col("path")), DEFAULT_GLOBS)).select("path")
ORACLE["file_glob_filter"] = f"WITH {_NAMED} SELECT path FROM named WHERE {glob_sql(DEFAULT_GLOBS)}"


def rule_applicability_filter(spark, sf_dir):
    name = file_name(F.col("path"))
    applied = F.array_compact(F.array(*[F.when(any_glob(name, r.globs), F.lit(r.rule_id)) for r in ALL_RULES]))
    return code_files(spark, sf_dir).select("path", F.array_join(applied, ",").alias("rules"))


QUERIES["rule_applicability_filter"] = rule_applicability_filter
ORACLE["rule_applicability_filter"] = (
    f"WITH {_NAMED} SELECT path, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {glob_sql(r.globs)} THEN {q(r.rule_id)} END" for r in ALL_RULES)
    + "], lambda x: x IS NOT NULL), ',') AS rules FROM named"
)


def minified_filter(spark, sf_dir):
    code = code_files(spark, sf_dir).select("path", "content")
    docs = text_rows(spark, sf_dir).select(F.concat_ws("/", "source", "path").alias("path"), "content")
    both = code.unionByName(docs)
    return both.select("path", is_minified(F.col("path"), F.col("content")).alias("minified"))


QUERIES["minified_filter"] = minified_filter
ORACLE["minified_filter"] = (
    f"WITH {CODE_FILES_SQL}, {TEXT_ROWS_SQL}, u AS (SELECT path, content FROM code_files UNION ALL SELECT source || '/' || path, content FROM text_rows) "
    f"SELECT path, {minified_sql()} AS minified FROM u"
)

QUERIES["config_doc_filter"] = lambda spark, sf_dir: configs(spark, sf_dir).select("path", tool_config().alias("is_config"))
ORACLE["config_doc_filter"] = f"WITH {CONFIGS_SQL} SELECT path, {CONFIG_TEST_SQL} AS is_config FROM configs"


def literal_secret_value_filter(spark, sf_dir):
    from wardspark.operators.configs import literal_secrets, tool_servers

    found = configs(spark, sf_dir).where(tool_config() & file_name(F.col("path")).endswith(".json"))
    servers = found.select("path", F.explode_outer(F.expr(tool_servers())).alias("s")).where("s is not null")
    return servers.select("path", F.col("s.name").alias("server"), F.explode_outer(F.expr(literal_secrets("s.def"))).alias("env_key")).where("env_key is not null")


QUERIES["literal_secret_value_filter"] = literal_secret_value_filter
ORACLE["literal_secret_value_filter"] = (
    f"WITH {_SERVERS_SQL}, entries AS (SELECT path, server, unnest(envs) AS env_key, def FROM defs), "
    "vals AS (SELECT *, json_extract(def, '$.env.\"' || env_key || '\"') AS v FROM entries) SELECT path, server, env_key FROM vals "
    "WHERE json_type(v) = 'VARCHAR' AND NOT starts_with(json_extract_string(v, '$'), '$') AND "
    "regexp_matches(json_extract_string(v, '$'), 'sk-[A-Za-z0-9_-]{10,}|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/=]{32,}')"
)


def auth_keys_intersect(spark, sf_dir):
    from wardspark.operators.configs import has_auth, tool_servers

    found = configs(spark, sf_dir).where(tool_config() & file_name(F.col("path")).endswith(".json"))
    servers = found.select("path", F.explode_outer(F.expr(tool_servers())).alias("s")).where("s is not null")
    return servers.select("path", F.col("s.name").alias("server"), F.expr(has_auth("s.def")).alias("has_auth"))


QUERIES["auth_keys_intersect"] = auth_keys_intersect
ORACLE["auth_keys_intersect"] = f"WITH {_SERVERS_SQL} SELECT path, server, {_AUTH_SQL} AS has_auth FROM defs"


def tool_description_extract_filter(spark, sf_dir):
    found = scan(code_files(spark, sf_dir), (rule("MCP-004"),))
    return flat(found.select("path", "match_ord", "description", "code_snippet"))


QUERIES["tool_description_extract_filter"] = tool_description_extract_filter
_PHRASES = INJECTION_PHRASES
ORACLE["tool_description_extract_filter"] = (
    f"WITH {CODE_FILES_SQL}, {source_ctes('code_files')}, {hits_cte((rule('MCP-004'),))} SELECT path, match_ord, "
    f"'tool description holds the phrase: ' || left(regexp_extract(text, {q('(?i)' + _PHRASES)}), 120) AS description, left(text, 500) AS code_snippet FROM hits"
)

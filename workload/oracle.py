"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark plans.

Rules without an RE2 spelling (look-around) carry an equivalent one here.
"""

from __future__ import annotations

from codegauge.functions import features as X, replies as R, rewrite as W, score as S
from codegauge.functions.lang import EDITOR_LANG, LANG_BY_SUFFIX, SUFFIX_BY_LANG
from codegauge.functions.rulebook import PENALTY, RULES, by_lang
from codegauge.operators import structure as ST, usage as U
from codegauge.sources.dims import MODEL_LIMITS
from workload.templates import TEMPLATES, rows

NL = "chr(10)"
BLANKS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

RE2 = {
    "py18": r"open\s*\([^)]+\)\s*(?:\z|[^\sa]|a(?:\z|[^s]))",
    "c05": r"\bmalloc\s*\([^)]+\)\s*;\s*(?:\z|[^\si]|i(?:\z|[^f]))",
}
FREE = r"\bfree\s*\(\s*\w+\s*\)\s*;"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def lines_of(x: str) -> str:
    return (f"(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN right({x}, 1) = {NL} "
            f"THEN string_split(left({x}, length({x}) - 1), {NL}) ELSE string_split({x}, {NL}) END)")


def rule_test(rule, x: str, whole: bool) -> str:
    if rule.rule_id == "c06":
        one = (f"(regexp_matches({{0}}, {q(FREE)}) AND NOT regexp_matches("
               f"regexp_extract({{0}}, {q('.*' + FREE + '(.*)')}, 1), {q(chr(92) + 'w+' + chr(92) + 's*=' + chr(92) + 's*NULL')}))")
        if whole:
            return f"len(list_filter(string_split({x}, {NL}), lambda l: {one.format('l')})) > 0"
        return one.format(x)
    return f"regexp_matches({x}, {q(RE2.get(rule.rule_id, rule.pattern))})"


PACKS = by_lang(RULES)

CTES: dict[str, str] = {}
CTES["templates"] = (
    "templates(tid, lang, has_bug, bug_type, body, corrected, description) AS (VALUES "
    + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows()) + ")")
CTES["snippets"] = f"""snippets AS (
  SELECT event_id AS doc_id, user_id, ts, t.lang, t.has_bug::INTEGER AS has_bug, t.bug_type,
         replace(t.corrected, '{{k}}', k) AS corrected_code, replace(t.body, '{{k}}', k) AS code, t.description
  FROM (SELECT *, regexp_extract(props, '"k": (\\d+)', 1) AS k FROM events) e
  JOIN templates t ON e.event_id % {len(TEMPLATES)} = t.tid)"""
CTES["page_scripts"] = """page_scripts AS (
  SELECT page_id::VARCHAR || '-' || (unnest(range(greatest(len(s), 1))))::VARCHAR AS doc_id, 'javascript' AS lang,
         unnest(CASE WHEN len(s) > 0 THEN s ELSE [''] END) AS code
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages))"""
CTES["labelled"] = f"""labelled AS (
  SELECT c_custkey::BIGINT AS row_no, replace(t.body, '{{k}}', c_nationkey::VARCHAR) AS code, t.lang AS language,
         t.bug_type, t.has_bug::INTEGER AS has_bug,
         CASE WHEN t.corrected = '' THEN ''
              ELSE replace(t.corrected, '{{k}}', c_nationkey::VARCHAR) || ' # ' || c_custkey::VARCHAR END AS corrected_code,
         t.description
  FROM customer JOIN templates t ON c_custkey % {len(TEMPLATES)} = t.tid)"""
CTES["corr"] = f"corr AS (SELECT * FROM labelled WHERE has_bug <> 0 AND {strip('corrected_code')} <> '')"
CTES["lint_log"] = """lint_log AS (
  SELECT doc_id, seq, CASE WHEN (doc_id + seq) % 3 = 0 THEN '************* Module a' || seq::VARCHAR
    ELSE 'tmp/a.py:' || seq::VARCHAR || ':0: W0' || ((doc_id + seq) % 900 + 100)::VARCHAR || ': text ' || doc_id::VARCHAR END AS line
  FROM (SELECT doc_id, unnest(range(1, 15))::INTEGER AS seq FROM snippets))"""
CTES["lint"] = r"""lint AS (
  SELECT * FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq))::INTEGER AS pos,
    regexp_replace(line, '.+\.py:(\d+):\d+: [A-Z]\d+: ', 'Line \1: ', 'g') AS text
    FROM lint_log WHERE regexp_matches(line, ':\d+:\d+:')) WHERE pos <= 10)"""
CTES["lines"] = f"""lines AS (
  SELECT doc_id, lang, unnest(ls) AS line, unnest(range(1, len(ls) + 1))::INTEGER AS line_no
  FROM (SELECT doc_id, lang, {lines_of('code')} AS ls FROM snippets))"""


def _owner(pack) -> str:
    return "CASE " + " ".join(f"WHEN {rule_test(r, 'line', False)} THEN {r.ord}" for r in pack) + " END"


CTES["rules"] = ("rules(lang, ord, rule_id, severity, message) AS (VALUES " + ", ".join(
    f"({q(r.lang)}, {r.ord}, {q(r.rule_id)}, {r.severity}, {q(r.message)})" for r in RULES) + ")")
_FINDINGS = """{name} AS (
  SELECT l.doc_id, l.lang, l.line_no, r.ord, r.rule_id, r.severity::INTEGER AS severity, r.message, {strip} AS line
  FROM (SELECT *, CASE lang {owners} END AS owner FROM {source}) l JOIN rules r ON r.lang = l.lang AND r.ord = l.owner)"""
_OWNERS = " ".join(f"WHEN {q(lang)} THEN {_owner(pack)}" for lang, pack in PACKS.items())
CTES["findings"] = _FINDINGS.format(name="findings", strip=strip("l.line"), owners=_OWNERS, source="lines")
CTES["page_lines"] = CTES["lines"].replace("lines AS (", "page_lines AS (", 1).replace("FROM snippets", "FROM page_scripts")
CTES["page_findings"] = _FINDINGS.format(name="page_findings", strip=strip("l.line"), owners=_OWNERS, source="page_lines")
_HITS = ", ".join(
    f"CASE WHEN lang = {q(r.lang)} AND {rule_test(r, 'code', True)} THEN {q(r.rule_id)} END" for r in RULES)
CTES["hits"] = f"""hits AS (
  SELECT doc_id, lang, rule_id FROM (SELECT doc_id, lang, unnest([{_HITS}]) AS rule_id FROM snippets) WHERE rule_id IS NOT NULL)"""
CTES["page_hits"] = CTES["hits"].replace("hits AS (", "page_hits AS (", 1).replace("FROM snippets", "FROM page_scripts")

_SKEL = (r'(?s)""".*?(?:"""|\z)' r"|'''.*?(?:'''|\z)" r'|"(?:[^"\\\n]|\\.)*"' r"|'(?:[^'\\\n]|\\.)*'" r"|(#[^\n]*)")
_NUMBER = r"(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?\w*"
_TOKEN = rf"\n[^\S\n]*|\*\*|:=|->|//=?|/=|[=!<>]=|{_NUMBER}|\w+|''|[^\s\w]"
_ZERO = (r"(?:0[xX][0_]+|0[oO][0_]+|0[bB][0_]+|(?:0[0_]*(?:\.[0_]*)?|\.0[0_]*)(?:[eE][+-]?[0-9_]+)?[jJ]?|False)")
CTES["skel"] = rf"""skel AS (
  SELECT doc_id, replace(regexp_replace(regexp_replace(code, {q(_SKEL)}, '\1''''', 'g'), '#[^\n]*', '', 'g'), chr(92) || chr(10), ' ') AS s
  FROM snippets WHERE lang = 'python')"""
# Tokens with the bracket depth in front of each; a newline token carries the next line's indentation.
CTES["tokens"] = f"""tokens AS (
  SELECT *, coalesce(sum(step) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM (
    SELECT *, CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END AS step FROM (
      SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (
        SELECT doc_id, regexp_extract_all(chr(10) || s, {q(_TOKEN)}) AS toks FROM skel))))"""
CTES["headers"] = """headers AS (
  SELECT t.doc_id, t.i AS h, t.lead_tok, t.name, min(e.i) AS stop
  FROM (SELECT *, lag(tok) OVER w AS lead_tok, lead(tok) OVER w AS name FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)) t
  JOIN tokens e ON e.doc_id = t.doc_id AND e.i > t.i AND e.tok = ')' AND e.depth = 1
  WHERE t.tok = 'def' AND t.lead_tok LIKE chr(10) || '%' GROUP BY ALL)"""
CTES["params"] = """params AS (
  SELECT doc_id, h, name, lead_tok, no, list(tok ORDER BY i) AS toks, list(depth ORDER BY i) AS depths FROM (
    SELECT h.*, t.tok, t.i, t.depth, sum((t.tok = ',' AND t.depth = 1)::INTEGER) OVER (PARTITION BY h.doc_id, h.h ORDER BY t.i) AS no
    FROM headers h JOIN tokens t ON t.doc_id = h.doc_id AND t.i > h.h + 2 AND t.i < h.stop)
  WHERE NOT (tok = ',' AND depth = 1) AND tok NOT LIKE chr(10) || '%' GROUP BY doc_id, h, name, lead_tok, no)"""
CTES["mutable"] = """mutable AS (
  SELECT doc_id, name AS function_name, k1, k2 FROM (
    SELECT *, list_filter(range(1, len(d) + 1), lambda j: d[j] <> '(')[1] AS o FROM (
      SELECT doc_id, name, length(lead_tok) - 1 AS k1, h AS k2, toks[eq + 1:] AS d, depths[eq + 1:] AS b FROM (
        SELECT *, list_filter(range(1, len(toks) + 1), lambda j: toks[j] = '=' AND depths[j] = 1)[1] AS eq,
               coalesce(bool_or(toks[1] = '*') OVER (PARTITION BY doc_id, h ORDER BY no), false) AS by_name FROM params)
      WHERE eq IS NOT NULL AND NOT by_name))
  WHERE d[o] IN ('[', '{') AND len(list_filter(range(1, len(d) + 1), lambda j:
      j > o AND ((b[j] = b[o] + 1 AND d[j] = 'for') OR (b[j] <= b[o] AND d[j] <> ')')))) = 0)"""
_LEAD = f"'^((?:[(] )*){_ZERO}((?: [)])*)'"
CTES["zero"] = f"""zero AS (
  SELECT doc_id, unnest(range(1, n + 1))::INTEGER AS occurrence FROM (
    SELECT doc_id, len(list_filter(string_split(' ' || joined || ' ', ' / ')[2:], lambda p:
        regexp_matches(p, {q(f'^(?:[(] )*{_ZERO}(?: |$)')})
        AND (len(regexp_extract(p, {_LEAD}, 1)) < len(regexp_extract(p, {_LEAD}, 2))
          OR (len(regexp_extract(p, {_LEAD}, 1)) = len(regexp_extract(p, {_LEAD}, 2))
            AND regexp_extract(p, {q(f'^(?:[(] )*{_ZERO}(?: [)])* ([^ ]+)')}, 1) NOT IN ('**', '.', '[', '('))))) AS n
    FROM (SELECT doc_id, string_agg(CASE WHEN tok LIKE chr(10) || '%' THEN chr(10) ELSE tok END, ' ' ORDER BY i) AS joined
          FROM tokens WHERE NOT (depth > 0 AND tok LIKE chr(10) || '%') GROUP BY doc_id)))"""
CTES["statements"] = r"""statements AS (
  SELECT doc_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM (
    SELECT *, sum((depth <= 0 AND trim(line) <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS no FROM (
      SELECT *, coalesce(sum(len(regexp_replace(line, '[^(\[{]', '', 'g')) - len(regexp_replace(line, '[^)\]}]', '', 'g'))) OVER (
                  PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
      FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS line,
                   unnest(range(1, len(string_split(s, chr(10))) + 1)) AS line_no FROM skel)))
  WHERE no > 0 GROUP BY doc_id, no)"""
CTES["skel_lines"] = r"""skel_lines AS (
  SELECT doc_id, line_no, length(regexp_extract(line, '^\s*')) AS indent,
         regexp_extract(line, '^\s*def\s+(\w+)\s*\(', 1) AS name,
         regexp_matches(line, '^\s*(?:el)?if\b') AS is_if,
         list_transform(string_split(regexp_replace(line, '^\s*(?:def|class)\s+\w+\s*\(', '('), '(')[:-2],
                        lambda p: regexp_extract(p, '(?:^|[^\w.])(\w+)\s*$', 1)) AS calls
  FROM statements)"""
CTES["recursion"] = """recursion AS (
  SELECT doc_id, name AS function_name, indent AS k1, line_no AS k2 FROM (
    SELECT d.doc_id, d.line_no, d.indent, d.name, bool_or(list_contains(b.calls, d.name)) AS rec,
           coalesce(bool_or(b.is_if AND b.line_no > d.line_no), false) AS guarded
    FROM (SELECT d.*, (SELECT min(e.line_no) FROM skel_lines e WHERE e.doc_id = d.doc_id AND e.line_no > d.line_no
                       AND e.indent <= d.indent) AS stop
          FROM skel_lines d WHERE d.name <> '') d
    JOIN skel_lines b ON b.doc_id = d.doc_id AND b.line_no >= d.line_no AND b.line_no < coalesce(d.stop, 1000000000)
    GROUP BY ALL) WHERE rec AND NOT guarded)"""
CTES["tree"] = f"""tree AS (
  SELECT doc_id, 1 AS grp, k1, k2, '''' || function_name || ''': {ST.MUTABLE_TEXT}' AS message FROM mutable UNION ALL
  SELECT doc_id, 2, k1, k2, '''' || function_name || ''': {ST.RECURSION_TEXT}' FROM recursion UNION ALL
  SELECT doc_id, 3, 0, 0, '{ST.ZERO_TEXT}' FROM zero)"""
_PEN = "CASE rule_id " + " ".join(f"WHEN {q(r.rule_id)} THEN {PENALTY[r.severity]}" for r in RULES) + " END"


def _base(name: str, lint: bool) -> str:
    lint_join = ("LEFT JOIN (SELECT doc_id, count(*) AS n FROM lint GROUP BY doc_id) l "
                 "ON l.doc_id = s.doc_id AND s.lang = 'python'") if lint else ""
    lint_pen = "- 3 * coalesce(l.n, 0)" if lint else ""
    return f"""{name} AS (
  SELECT s.doc_id, s.lang, greatest(0, least(100, 100 - coalesce(p.pen, 0) - 10 * coalesce(t.n, 0) {lint_pen}))::INTEGER AS base_score
  FROM snippets s LEFT JOIN (SELECT doc_id, sum({_PEN}) AS pen FROM hits GROUP BY doc_id) p ON p.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM tree GROUP BY doc_id) t ON t.doc_id = s.doc_id {lint_join})"""


CTES["base"] = _base("base", False)
CTES["base_lint"] = _base("base_lint", True)


def icon(sev: str) -> str:
    return f"CASE {sev} WHEN 3 THEN '{S.RED}' WHEN 2 THEN '{S.YELLOW}' ELSE '{S.BLUE}' END"


def _report(name: str, docs: str, findings: str, tree: bool, lint: bool) -> str:
    parts = [f"""SELECT doc_id, 0 AS src, ord * 1000000 + line_no AS pos, {icon('severity')} || ' Line '
             || lpad(line_no::VARCHAR, greatest(3, length(line_no::VARCHAR))::INTEGER, ' ') || ':  ' || line || {NL}
             || '           =>  ' || message AS part FROM {findings}"""]
    if tree:
        parts.append(f"SELECT doc_id, grp, k1 * 1000000 + k2, '{S.RED} AST:  ' || message FROM tree")
    if lint:
        parts.append(f"""SELECT l.doc_id, 9, pos, '{S.YELLOW} PYLINT:  ' || text FROM lint l
                         JOIN {docs} d ON d.doc_id = l.doc_id AND d.lang = 'python'""")
    return f"""{name} AS (
  SELECT d.doc_id, coalesce(p.report, '{S.CLEAN_REPORT}') AS report FROM {docs} d LEFT JOIN (
    SELECT doc_id, string_agg(part, {NL} ORDER BY src, pos) AS report FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id) p
  ON p.doc_id = d.doc_id)"""


CTES["rule_report"] = _report("rule_report", "snippets", "findings", False, False)
CTES["full_report"] = _report("full_report", "snippets", "findings", True, True)
CTES["tree_report"] = _report("tree_report", "snippets", "findings", True, False)
CTES["page_report"] = _report("page_report", "page_scripts", "page_findings", False, False)

# ---- fixes, line by line -------------------------------------------------------------------
_HEAD = r"^(\s*def\s+\w+\s*\()(.*)(\)\s*:)"
_METHOD = r"^(\s{4,}def\s+)(\w+)\s*\(([^)]*)\)\s*:"
_STEPS: list[tuple[str, str]] = [
    ("none_eq", r"regexp_replace({0}, '==\s*None', 'is None', 'g')"),
    ("none_ne", r"regexp_replace({0}, '!=\s*None', 'is not None', 'g')"),
    ("bare_except", r"regexp_replace({0}, 'except\s*:', 'except Exception as e:', 'g')"),
    ("md5", r"regexp_replace({0}, 'hashlib\.md5\s*\(', 'hashlib.sha256(', 'g')"),
    ("sha1", r"regexp_replace({0}, 'hashlib\.sha1\s*\(', 'hashlib.sha256(', 'g')"),
    ("os_system", r"regexp_replace({0}, 'os\.system\s*\(', 'subprocess.run(', 'g')"),
    ("password", r"""regexp_replace({0}, '(?i)(password\s*=\s*)[''"].+[''"]', '\1os.environ.get(''PASSWORD'', '''')', 'g')"""),
    ("api_key", r"""regexp_replace({0}, '(?i)(api_key\s*=\s*)[''"].+[''"]', '\1os.environ.get(''API_KEY'', '''')', 'g')"""),
    ("add_self", rf"""CASE WHEN regexp_matches({{0}}, '{_METHOD}') AND NOT starts_with(regexp_extract({{0}}, '{_METHOD}', 2), '__')
        AND NOT regexp_matches(regexp_extract({{0}}, '{_METHOD}', 3), '^self\b')
      THEN regexp_extract({{0}}, '{_METHOD}', 1) || regexp_extract({{0}}, '{_METHOD}', 2) || '(self'
        || CASE WHEN trim(regexp_extract({{0}}, '{_METHOD}', 3)) = '' THEN '' ELSE ', ' || trim(regexp_extract({{0}}, '{_METHOD}', 3)) END
        || '):' ELSE {{0}} END""".replace("{4,}", "{{4,}}")),
]
_JS_STEPS = [("var", r"regexp_replace({0}, '\bvar\s+', 'let ', 'g')"),
             ("inner_html", r"regexp_replace({0}, '\.innerHTML\s*=', '.textContent =', 'g')")]
_JAVA_STEPS = [("length_zero", r"regexp_replace({0}, '\.length\s*\(\s*\)\s*==\s*0', '.isEmpty()', 'g')")]
_GUARD = ("list_transform(regexp_extract_all(regexp_extract(x, '{head}', 2), '(\\w+)\\s*=\\s*{pat}', 1), "
          "lambda v: regexp_extract(x, '^\\s*') || '    if ' || v || ' is None: ' || v || ' = {empty}')")
_EXPAND = (
    f"CASE WHEN regexp_matches(x, '{_HEAD}') THEN list_concat([regexp_extract(x, '{_HEAD}', 1) || "
    rf"regexp_replace(regexp_replace(regexp_extract(x, '{_HEAD}', 2), '(\w+)\s*=\s*\[\]', '\1=None', 'g'), '(\w+)\s*=\s*\{{\}}', '\1=None', 'g')"
    f" || regexp_extract(x, '{_HEAD}', 3)], "
    + _GUARD.replace("{head}", _HEAD).replace("{pat}", r"\[\]").replace("{empty}", "[]") + ", "
    + _GUARD.replace("{head}", _HEAD).replace("{pat}", r"\{\}").replace("{empty}", "{}") + ") ELSE [x] END")


def _chain(steps) -> str:
    """s0 .. sn as lateral aliases."""
    return ", ".join(f"{text.format(f's{i}')} AS s{i + 1}" for i, (_, text) in enumerate(steps))


def _fixed_ctes(prefix: str, docs: str) -> dict[str, str]:
    out = {}
    base = f"SELECT doc_id, unnest({lines_of('code')}) AS s0, unnest(range(len({lines_of('code')}))) AS i FROM {docs}"
    for lang, steps in (("python", _STEPS), ("javascript", _JS_STEPS), ("java", _JAVA_STEPS)):
        out[f"{prefix}{lang}_steps"] = (
            f"{prefix}{lang}_steps AS (SELECT *, {_chain(steps)} FROM ({base} WHERE lang = '{lang}'))")
    other = f"SELECT doc_id, i, [s0] AS o FROM ({base} WHERE lang NOT IN ('python', 'javascript', 'java'))"
    out[f"{prefix}body"] = f"""{prefix}body AS (
  SELECT d.doc_id, d.lang, coalesce(f.body, '') AS body FROM {docs} d LEFT JOIN (
    SELECT doc_id, string_agg(array_to_string(o, {NL}), {NL} ORDER BY i) AS body FROM (
      SELECT doc_id, i, {_EXPAND.replace('(x,', '(s9,')} AS o FROM (SELECT doc_id, i, s9 FROM {prefix}python_steps)
      UNION ALL SELECT doc_id, i, [s2] FROM {prefix}javascript_steps
      UNION ALL SELECT doc_id, i, [s1] FROM {prefix}java_steps UNION ALL {other}) GROUP BY doc_id) f ON f.doc_id = d.doc_id)""".replace(
        "ELSE [x] END", "ELSE [s9] END")
    need = [f"CASE WHEN contains(body, {q(use)}) AND NOT contains(body, {q(line)}) THEN {q(line)} END"
            for use, line in W.IMPORT_NEEDS]
    out[f"{prefix}fixed"] = f"""{prefix}fixed AS (
  SELECT doc_id, lang, CASE WHEN lang = 'python' THEN imports ELSE [] END AS imports,
         CASE WHEN lang = 'python' AND len(imports) > 0 THEN array_to_string(imports, {NL}) || {NL} || {NL} ELSE '' END || body AS fixed_code
  FROM (SELECT *, list_filter([{', '.join(need)}], lambda v: v IS NOT NULL) AS imports FROM {prefix}body))"""
    return out


CTES.update(_fixed_ctes("", "snippets"))
CTES.update(_fixed_ctes("page_", "page_scripts"))

# ---- replies -------------------------------------------------------------------------------
CTES["limits"] = "limits(rank, model, lim) AS (VALUES " + ", ".join(
    f"({i}, {q(m)}, {n})" for i, (m, n) in enumerate(MODEL_LIMITS)) + ")"
CTES["responses"] = """responses AS (
  SELECT conv_id AS request_id, (turn // 2 * 2 + place)::INTEGER AS rank, coalesce(l.model, 'other-model') AS model,
         CASE WHEN (conv_id + turn) % 3 = 0 AND place = 1 THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END AS result,
         (length(text) // 4 * 3)::INTEGER AS prompt_tokens, (length(text) // 4)::INTEGER AS output_tokens,
         (length(text) // 4 * 4)::INTEGER AS total_tokens
  FROM (SELECT conv_id, turn, text, role, 1 AS place FROM conversations UNION ALL
        SELECT conv_id, turn, ' no: ' || (conv_id + turn)::VARCHAR, role, 0 FROM conversations WHERE (conv_id + turn) % 5 = 0)
  LEFT JOIN limits l ON l.rank = turn // 2 WHERE role = 'assistant')"""
CTES["accepted"] = f"accepted AS (SELECT * REPLACE ({strip('result')} AS result) FROM responses WHERE length({strip('result')}) > 20)"
CTES["first_ok"] = """first_ok AS (
  SELECT r.request_id, coalesce(a.model, '') AS model, coalesce(a.result, '') AS result,
         coalesce(a.prompt_tokens, 0)::INTEGER AS prompt_tokens, coalesce(a.output_tokens, 0)::INTEGER AS output_tokens,
         coalesce(a.total_tokens, 0)::INTEGER AS total_tokens
  FROM (SELECT DISTINCT conv_id AS request_id FROM conversations) r LEFT JOIN (
    SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank) = 1) a
  ON a.request_id = r.request_id)"""


def _usage(source: str) -> str:
    return f"""SELECT r.*, CASE WHEN r.model = '' THEN 0 ELSE coalesce(l.lim, {R.DEFAULT_LIMIT}) END::INTEGER AS lim,
      CASE WHEN r.model = '' THEN 0.0 ELSE printf('%.1f', r.total_tokens / coalesce(l.lim, {R.DEFAULT_LIMIT}) * 100)::DOUBLE END::DOUBLE AS pct
      FROM {source} r LEFT JOIN limits l ON l.model = r.model"""


CTES["usage"] = f"usage AS ({_usage('responses')})"
CTES["ok_usage"] = f"ok_usage AS ({_usage('first_ok')})"
_EDGES = strip(r"regexp_replace(regexp_replace({0}, '\A```\w*\n?', ''), '\n?```\n?\z', '')")


def fences_all(x: str, target: str | None) -> str:
    out = strip(x)
    for fence in ([f"'```' || {target}"] if target else []) + [q("```" + t) for t in [*R.CONVERT_TAGS, ""]]:
        out = f"replace({out}, {fence}, '')"
    return strip(out)


CTES["asks"] = """asks AS (
  SELECT doc_id, ['convert', 'assistant', 'review', 'fix', 'assistant'][doc_id % 5 + 1] AS task, lang,
         ['java', 'python', 'go'][doc_id % 3 + 1] AS to_lang,
         CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 <> 0 THEN 'make it faster ' || doc_id::VARCHAR END AS prompt,
         code FROM snippets)"""
CTES["checked"] = f"""checked AS (
  SELECT *, CASE WHEN task = 'assistant' AND {strip("coalesce(prompt, '')")} = '' THEN {q(U.NO_PROMPT)}
    WHEN task <> 'assistant' AND {strip("coalesce(code, '')")} = '' THEN {q(U.NO_CODE)}
    WHEN task = 'convert' AND lang = to_lang THEN {q(U.SAME_LANG)} END AS error FROM asks)"""


CTES["checked_some"] = CTES["checked"].replace("checked AS", "checked_some AS").replace(
    "FROM asks", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 4 <> 0 THEN code END AS code) FROM asks)")


def _filled(template: str) -> str:
    for name in ("lang", "to_lang", "prompt", "code"):
        template = template.replace("'", "''") if name == "lang" else template
        template = template.replace("{" + name + "}", f"' || coalesce({name}, '') || '")
    return "'" + template + "'"


# ---- features, n-grams, corrections --------------------------------------------------------
_RE2_FEATURES = {
    "has_loose_eq": r"(?:\A|[^=])=(?:[^=]|\z)",
    "has_no_return": (r"def \w+\([^)]*\):\s*\n(?:\s+(?:[^r\s].*|r(?:[^e\n].*)?|re(?:[^t\n].*)?|ret(?:[^u\n].*)?"
                      r"|retu(?:[^r\n].*)?|retur(?:[^n\n].*)?)\n)*\s*\z"),
    "has_hardcoded_pw": "(?i)" + X.PATTERNS["has_hardcoded_pw"],
}


def _feature(name: str) -> str:
    if name == "len":
        return "length(code)::INTEGER AS len"
    if name == "lines":
        return f"(length(code) - length(replace(code, {NL}, '')))::INTEGER AS lines"
    if name in X.LANG_FLAGS:
        return f"(lang = {q(X.LANG_FLAGS[name])})::INTEGER AS {name}"
    if name == "has_open_no_with":
        return (r"(len(regexp_extract_all(code, 'open\(')) > len(regexp_extract_all(code, 'with open\(')))::INTEGER AS "
                + name)
    test = f"regexp_matches(code, {q(_RE2_FEATURES.get(name, X.PATTERNS[name]))})"
    if name in X.JAVASCRIPT_ONLY:
        test = f"(lang = 'javascript' AND {test})"
    return f"({test})::INTEGER AS {name}"


CTES["feats"] = f"feats AS (SELECT doc_id, has_bug, {', '.join(_feature(n) for n in X.NAMES)} FROM snippets)"
CTES["chances"] = f"""chances AS (
  SELECT doc_id, has_bug, least(1.0, ({' + '.join(f'{n} * {w}::DOUBLE' for n, w in X.WEIGHTS.items())}) / 3.0::DOUBLE)::DOUBLE AS p_bug FROM feats)"""
CTES["predicted"] = "predicted AS (SELECT *, (p_bug >= 0.4::DOUBLE)::INTEGER AS prediction FROM chances)"


def grams(x: str, lo: int, hi: int) -> str:
    words = rf"list_transform(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    return (f"flatten(list_transform({words}, lambda w: flatten(list_transform(range({lo}, least({hi}, length(w)) + 1), "
            f"lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))))))")


CTES["sim_pairs"] = f"""sim_pairs AS (
  SELECT a.bug_type, a.key, c.row_no, c.corrected_code, {{sim}} AS sim
  FROM (SELECT DISTINCT bug_type, {strip('code')} AS key FROM snippets WHERE bug_type <> '') a
  JOIN corr c ON c.bug_type = a.bug_type)"""


def similarity(a: str, b: str) -> str:
    return (f"coalesce(list_sum(list_transform(range(1, least(length({a}), length({b}), 50) + 1), "
            f"lambda i: (substring({a}, i, 1) = substring({b}, i, 1))::INTEGER)), 0)::INTEGER")


CTES["sim_pairs"] = CTES["sim_pairs"].replace("{sim}", similarity("a.key", "c.code"))
CTES["similar_rows"] = """similar_rows AS (
  SELECT bug_type, key, corrected_code FROM sim_pairs
  QUALIFY row_number() OVER (PARTITION BY bug_type, key ORDER BY sim DESC, row_no) = 1)"""
CTES["exact"] = f"""exact AS (
  SELECT {strip('code')} AS key, arg_max(corrected_code, row_no) AS corrected_code FROM corr GROUP BY 1)"""
CTES["model_text"] = "model_text AS (SELECT doc_id, code || ' ' || lang AS text FROM snippets)"
CTES["terms"] = f"terms AS (SELECT doc_id, unnest({grams('text', 2, 4)}) AS term FROM model_text)"
CTES["vocab"] = "vocab AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 8000)"
CTES["tf"] = "tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM vocab) GROUP BY ALL)"
CTES["weighted"] = """weighted AS (
  SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM snippets))
         / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM tf)"""

_NEEDS = {
    "snippets": ["templates"], "labelled": ["templates"], "corr": ["labelled"], "lint_log": ["snippets"],
    "lint": ["lint_log"], "lines": ["snippets"], "findings": ["lines", "rules"],
    "page_lines": ["page_scripts"], "page_findings": ["page_lines", "rules"], "hits": ["snippets"],
    "page_hits": ["page_scripts"], "skel": ["snippets"], "tokens": ["skel"], "headers": ["tokens"], "params": ["headers"],
    "mutable": ["params"], "zero": ["tokens"], "statements": ["skel"], "skel_lines": ["statements"], "recursion": ["skel_lines"], "tree": ["mutable", "recursion", "zero"],
    "base": ["hits", "tree"], "base_lint": ["hits", "tree", "lint"],
    "rule_report": ["findings"], "full_report": ["findings", "tree", "lint"], "tree_report": ["findings", "tree"],
    "page_report": ["page_findings"],
    "python_steps": ["snippets"], "javascript_steps": ["snippets"], "java_steps": ["snippets"],
    "body": ["python_steps", "javascript_steps", "java_steps"], "fixed": ["body"],
    "page_python_steps": ["page_scripts"], "page_javascript_steps": ["page_scripts"],
    "page_java_steps": ["page_scripts"],
    "page_body": ["page_python_steps", "page_javascript_steps", "page_java_steps"], "page_fixed": ["page_body"],
    "responses": ["limits"], "accepted": ["responses"], "first_ok": ["accepted"], "usage": ["responses"],
    "ok_usage": ["first_ok"], "asks": ["snippets"], "checked": ["asks"], "checked_some": ["asks"], "feats": ["snippets"],
    "chances": ["feats"], "predicted": ["chances"], "sim_pairs": ["snippets", "corr"], "similar_rows": ["sim_pairs"],
    "exact": ["corr"], "model_text": ["snippets"], "terms": ["model_text"], "vocab": ["terms"], "tf": ["vocab"],
    "weighted": ["tf"],
}


def sql(select: str, *needs: str) -> str:
    """The select with the CTEs it names, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    return ("WITH " + ",\n".join(CTES[n] for n in ordered) + "\n" if ordered else "") + select


def bands(x: str, zero: str | None, table) -> str:
    head = f"WHEN {x} = 0 THEN {q(zero)} " if zero is not None else ""
    return "CASE " + head + " ".join(f"WHEN {x} >= {f} THEN {q(n)}" for f, n in table[:-1]) + f" ELSE {q(table[-1][1])} END"


def case(x: str, table: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def count_icon(x: str, *icons: str) -> str:
    return "(" + " + ".join(f"length({x}) - length(replace({x}, '{i}', ''))" for i in icons) + ")::INTEGER"


def security(x: str) -> str:
    return (f"len(list_filter(string_split({x}, {NL}), lambda l: contains(l, '{S.RED}') AND "
            f"regexp_matches(lower(l), '{'|'.join(S.SECURITY_WORDS)}')))::INTEGER")


def analysis(docs: str, report: str, fixed: str, score: str) -> str:
    blank = f"{strip('d.code')} = ''"
    return f"""SELECT doc_id, lang, score, score::VARCHAR || '%' AS confidence, {bands('score', S.PROMPT_MESSAGE, S.SCORE_MESSAGES)} AS msg,
      old_line, full_code, lines, chars, {count_icon('old_line', S.RED)} AS critical_count,
      {count_icon('old_line', S.YELLOW, S.BLUE)} AS optims_count, {security('old_line')} AS security_count,
      {case('lang', SUFFIX_BY_LANG, "'txt'")} AS lang_ext
    FROM (SELECT d.doc_id, d.lang, CASE WHEN {blank} THEN 0 ELSE {score} END::INTEGER AS score,
      CASE WHEN {blank} THEN '' ELSE r.report END AS old_line, CASE WHEN {blank} THEN '' ELSE f.fixed_code END AS full_code,
      CASE WHEN {blank} THEN 0 ELSE len({lines_of('d.code')}) END::INTEGER AS lines,
      CASE WHEN {blank} THEN 0 ELSE length(d.code) END::INTEGER AS chars
      FROM {docs} d JOIN {report} r ON r.doc_id = d.doc_id JOIN {fixed} f ON f.doc_id = d.doc_id"""


_SNIPPET_ANALYSIS = analysis("snippets", "{report}", "fixed", "b.base_score") + " JOIN {base} b ON b.doc_id = d.doc_id)"
_PAGE_PEN = f"greatest(0, least(100, 100 - coalesce((SELECT sum({_PEN}) FROM page_hits h WHERE h.doc_id = d.doc_id), 0)))"
_REPORT = """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  WITH c AS (SELECT count(*) FILTER (has_bug = 1 AND prediction = 1) AS tp, count(*) FILTER (has_bug <> 1 AND prediction = 1) AS fp,
    count(*) FILTER (has_bug = 1 AND prediction <> 1) AS fn, count(*) FILTER (has_bug <> 1 AND prediction <> 1) AS tn FROM predicted),
  k AS (SELECT 'clean' AS class, tn AS hit, fn AS wrong, fp AS missed FROM c UNION ALL SELECT 'bug', tp, fp, fn FROM c),
  m AS (SELECT class, CASE WHEN hit + wrong = 0 THEN 0 ELSE hit / (hit + wrong) END AS precision,
        CASE WHEN hit + missed = 0 THEN 0 ELSE hit / (hit + missed) END AS recall, hit + missed AS support FROM k),
  f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
  SELECT class, precision, recall, f1, support::BIGINT AS support FROM f
  UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), tp + fp + fn + tn FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)"""


def _summary() -> str:
    parts = []
    for lang, steps in (("python", _STEPS), ("javascript", _JS_STEPS), ("java", _JAVA_STEPS)):
        for i, (name, _) in enumerate(steps):
            parts.append(f"SELECT '{lang}' AS lang, '{name}' AS fix, doc_id, count(*) AS n FROM {lang}_steps "
                         f"WHERE s{i} <> s{i + 1} GROUP BY doc_id")
    parts.append(r"SELECT 'python', 'mutable_default', doc_id, count(*) FROM python_steps WHERE regexp_matches(s9, "
                 r"'^\s*def\s+\w+\s*\(.*\w\s*=\s*(?:\[\]|\{\}).*\)\s*:') GROUP BY doc_id")
    parts.append("SELECT 'python', 'imports', doc_id, len(imports) FROM fixed WHERE len(imports) > 0")
    return ("SELECT lang, fix, count(*) AS docs, sum(n)::BIGINT AS lines FROM (" + " UNION ALL ".join(parts)
            + ") GROUP BY lang, fix")


_HISTORY = """SELECT user_id, pos, doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, lang, substring(code, 1, 120) AS code
  FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, doc_id DESC))::INTEGER AS pos FROM snippets)
  WHERE pos <= 20"""
_PATH = """(SELECT event_id, 'src.d/' || event_type || '/f' || event_id::VARCHAR
  || ['.py', '.TS', '.java', '.js', '.c', '.tar.gz', ''][event_id % 7 + 1] AS path FROM events)"""
_SUFFIX = r"regexp_extract(path, '[^/.]\.*(\.[^/.]*)\z', 1)"
_LANG = case(f"lower({_SUFFIX})", LANG_BY_SUFFIX, "'python'")

ORACLE: dict[str, str] = {
    "explode_lines": sql("SELECT doc_id, line_no, line FROM lines", "lines"),
    "line_findings": sql("SELECT doc_id, lang, line_no, rule_id, severity, message, line FROM findings", "findings"),
    "wide_pack_findings": r"""WITH rules AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS word FROM benchmark),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1))::INTEGER AS line_no FROM (
          SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1)
                 ELSE text END, chr(10)) END AS ls FROM documents)),
        w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS word FROM l)
        SELECT doc_id, line_no, word AS rule_id FROM w JOIN rules USING (word)
        QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY ascii(word), word) = 1""",
    "table_rule_findings": sql("SELECT doc_id, line_no, rule_id, severity FROM findings", "findings"),
    "doc_rule_hits": sql("SELECT * FROM hits", "hits"),
    "fault_report": sql("SELECT doc_id, report FROM rule_report", "rule_report"),
    "page_script_findings": sql(
        "SELECT doc_id, lang, line_no, rule_id, severity, message, line FROM page_findings", "page_findings"),
    "mutable_defaults": sql("SELECT doc_id, function_name FROM mutable", "mutable"),
    "unbounded_recursion": sql("SELECT doc_id, function_name FROM recursion", "recursion"),
    "zero_division": sql("SELECT * FROM zero", "zero"),
    "lint_log_findings": sql("SELECT doc_id, pos, text FROM lint", "lint"),
    "all_findings": sql(
        "SELECT doc_id, 1 AS source, severity, line, message FROM findings UNION ALL "
        "SELECT doc_id, 2, 3, 'AST', message FROM tree UNION ALL "
        "SELECT l.doc_id, 3, 2, 'PYLINT', text FROM lint l JOIN snippets s ON s.doc_id = l.doc_id AND s.lang = 'python'",
        "findings", "tree", "lint"),
    "base_score": sql("SELECT * FROM base", "base"),
    "base_score_with_lint": sql("SELECT * FROM base_lint", "base_lint"),
    "blend_score": sql(
        """SELECT b.doc_id, greatest(0, least(100, coalesce(trunc(base_score * 0.5::DOUBLE
             + (1.0::DOUBLE - CASE WHEN b.doc_id % 7 <> 0 THEN round(p_bug, 2) END) * 100 * 0.5::DOUBLE), base_score)))::INTEGER AS score
           FROM base b JOIN chances c ON c.doc_id = b.doc_id""", "base", "chances"),
    "score_message": sql(
        f"SELECT doc_id, {bands('base_score', S.PROMPT_MESSAGE, S.SCORE_MESSAGES)} AS msg, "
        "base_score::VARCHAR || '%' AS confidence FROM base", "base"),
    "health_band": sql(
        f"SELECT doc_id, {bands('base_score', 'none', S.HEALTH_BANDS)} AS band, "
        f"{bands('base_score', None, S.HEALTH_BANDS)} AS file_band FROM base", "base"),
    "severity_icon": sql(f"SELECT {icon('severity')} AS icon, count(*) AS lines FROM findings GROUP BY 1", "findings"),
    "severity_counts": sql(
        """SELECT doc_id, count(*) FILTER (severity = 3) AS critical, count(*) FILTER (severity <> 3) AS optims FROM (
             SELECT doc_id, NULL AS severity FROM snippets UNION ALL SELECT doc_id, severity FROM findings UNION ALL SELECT doc_id, 3 FROM tree UNION ALL
             SELECT l.doc_id, 2 FROM lint l JOIN snippets s ON s.doc_id = l.doc_id AND s.lang = 'python') GROUP BY doc_id""",
        "findings", "tree", "lint"),
    "security_count": sql(f"SELECT doc_id, {security('report')} AS security_count FROM rule_report", "rule_report"),
    "analyze_corpus": sql(_SNIPPET_ANALYSIS.replace("{report}", "full_report").replace("{base}", "base_lint"),
                            "full_report", "fixed", "base_lint"),
    "analyze_pages": sql(analysis("page_scripts", "page_report", "page_fixed", _PAGE_PEN) + ")",
                         "page_report", "page_fixed", "page_hits"),
    "report_by_lang": sql(
        "SELECT lang, count(*) AS docs, round(avg(score), 6) AS mean_score, sum(critical_count)::BIGINT AS critical, "
        "sum(optims_count)::BIGINT AS optims, sum(security_count)::BIGINT AS security FROM ("
        + _SNIPPET_ANALYSIS.replace("{report}", "tree_report").replace("{base}", "base") + ") GROUP BY lang",
        "tree_report", "fixed", "base"),
    "report_by_rule": sql("SELECT lang, rule_id, count(*) AS docs FROM hits GROUP BY lang, rule_id", "hits"),
    "apply_fixes": sql("SELECT doc_id, lang, fixed_code FROM fixed", "fixed"),
    "fix_summary": sql(_summary(), "fixed"),
    "text_metrics": f"""SELECT doc_id, len({lines_of('text')})::INTEGER AS line_count, length(text)::INTEGER AS char_count,
        (length(text) - length(replace(text, {NL}, '')))::INTEGER AS newline_count, ({strip('text')} = '')::INTEGER AS is_blank FROM documents""",
    "previews": """SELECT doc_id, substring(text, 1, 120) AS history,
        CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END AS prompt FROM documents""",
    "path_languages": f"""SELECT event_id, lang, {case('lang', SUFFIX_BY_LANG, "'txt'")} AS ext,
        left(path, length(path) - length(suffix)) || '_fixed.' || {case('lang', SUFFIX_BY_LANG, "'txt'")} AS out_path
        FROM (SELECT event_id, path, {_SUFFIX} AS suffix, {_LANG} AS lang FROM {_PATH})""",
    "normalise_lang": f"""SELECT event_id, {case('name', EDITOR_LANG, 'name')} AS lang FROM (
        SELECT event_id, ['typescript', 'cpp', 'go', 'java', 'c', 'ruby'][event_id % 6 + 1] AS name FROM events)""",
    "expand_corpus": sql(
        """SELECT code, language, bug_type, has_bug, corrected_code, description FROM labelled UNION ALL
           SELECT code, lang, bug_type, has_bug, corrected_code, description FROM snippets
           WHERE code NOT IN (SELECT code FROM labelled)
           QUALIFY row_number() OVER (PARTITION BY code ORDER BY doc_id) = 1""", "labelled", "snippets"),
    "ordered_corpus_lookup": sql(
        f"""SELECT s.doc_id, e.fixed AS exact_correction FROM snippets s LEFT JOIN (
              SELECT {strip('code')} AS key, arg_max(corrected_code, (part, n)) AS fixed FROM (
                SELECT code, has_bug, corrected_code, 0 AS part, row_no AS n FROM labelled UNION ALL
                (SELECT code, has_bug, corrected_code, 1, doc_id FROM snippets WHERE code NOT IN (SELECT code FROM labelled)
                 QUALIFY row_number() OVER (PARTITION BY code ORDER BY doc_id) = 1))
              WHERE has_bug <> 0 AND {strip('corrected_code')} <> '' GROUP BY 1) e ON e.key = {strip('s.code')}""", "labelled", "snippets"),
    "non_blank": sql(f"SELECT doc_id, lang FROM snippets WHERE {strip('code')} <> ''", "snippets"),
    "corpus_summary": sql("SELECT count(*) AS samples, count(*) FILTER (has_bug <> 0) AS bugs, "
                          "count(*) FILTER (has_bug = 0) AS clean FROM labelled", "labelled"),
    "stratified_split": sql(
        """SELECT doc_id, has_bug, (row_number() OVER (PARTITION BY has_bug ORDER BY md5('42:' || doc_id::VARCHAR), doc_id)
             <= floor(count(*) OVER (PARTITION BY has_bug) * 0.2 + 0.5))::INTEGER AS is_test FROM snippets""", "snippets"),
    "training_report": sql(
        f"""SELECT * FROM (WITH held AS (
              SELECT has_bug, floor(count(*) * 0.2 + 0.5)::BIGINT AS n FROM (
                SELECT code, has_bug FROM labelled UNION ALL
                (SELECT code, has_bug FROM snippets WHERE code NOT IN (SELECT code FROM labelled)
                 QUALIFY row_number() OVER (PARTITION BY code ORDER BY doc_id) = 1))
              WHERE {strip('code')} <> '' GROUP BY has_bug),
            classes AS (
              SELECT 'clean' AS class, coalesce(sum(n) FILTER (has_bug = 0), 0)::BIGINT AS support FROM held UNION ALL
              SELECT 'bug', coalesce(sum(n) FILTER (has_bug = 1), 0)::BIGINT FROM held UNION ALL
              SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), sum(n)::BIGINT FROM held)
            SELECT model, class, support, true AS in_range, true AS beats_majority
            FROM classes, (SELECT unnest(['basic', 'advanced']) AS model))""", "labelled", "snippets"),
    "corpus_file_summary": sql(
        "SELECT code, language, bug_type, has_bug, corrected_code, description FROM labelled", "labelled"),
    "submission_defaults": sql(
        """SELECT doc_id, user_id, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'python' END AS lang,
             CASE WHEN doc_id % 4 <> 0 THEN code ELSE '' END AS code FROM snippets""", "snippets"),
    "source_file_review": sql(
        "SELECT lang, 's' || doc_id::VARCHAR AS name, '_fixed.js' AS suffix, fixed_code FROM page_fixed", "page_fixed"),
    "corrections": sql("SELECT row_no, code, bug_type, corrected_code FROM corr", "corr"),
    "exact_lookup": sql(f"""SELECT s.doc_id, e.corrected_code AS exact_correction FROM snippets s
        LEFT JOIN exact e ON e.key = {strip('s.code')}""", "snippets", "exact"),
    "prefix_similarity": f"""SELECT a.doc_id, {similarity('a.text', 'b.text')} AS similarity
        FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1""",
    "best_by_type": sql(f"""SELECT s.doc_id, m.corrected_code AS similar_correction FROM snippets s
        LEFT JOIN similar_rows m ON m.bug_type = s.bug_type AND m.key = {strip('s.code')}""", "similar_rows"),
    "suggest_correction": sql(f"""SELECT s.doc_id, coalesce(e.corrected_code, m.corrected_code) AS suggestion FROM snippets s
        LEFT JOIN exact e ON e.key = {strip('s.code')}
        LEFT JOIN similar_rows m ON m.bug_type = s.bug_type AND m.key = {strip('s.code')}""", "exact", "similar_rows"),
    "correction_stats": sql(f"SELECT count(DISTINCT {strip('code')}) AS exact_entries, "
                            "count(DISTINCT bug_type) AS bug_categories FROM corr", "corr"),
    "corrections_by_type": sql("""SELECT bug_type, row_number() OVER (PARTITION BY bug_type ORDER BY row_no) AS position,
        code, corrected_code, description FROM corr""", "corr"),
    "extract_features": sql("SELECT * EXCLUDE (has_bug) FROM feats", "feats"),
    "rule_probability": sql("SELECT doc_id, round(p_bug, 6) AS p_bug, prediction FROM predicted", "predicted"),
    "rule_accuracy": sql("SELECT round(avg((prediction = has_bug)::INTEGER), 6) AS accuracy FROM predicted", "predicted"),
    "classification_report": sql(_REPORT, "predicted"),
    "balanced_weights": sql("""SELECT doc_id, has_bug, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY has_bug)), 6) AS weight
        FROM snippets""", "snippets"),
    "char_wb_ngrams": sql(f"SELECT doc_id, array_to_string({grams('text', 2, 5)}, '|') AS grams FROM model_text", "model_text"),
    "top_vocabulary": f"""SELECT term, count(*) AS freq FROM (SELECT unnest({grams('text', 2, 4)}) AS term FROM documents)
        GROUP BY term ORDER BY freq DESC, term LIMIT 8000""",
    "tfidf_sublinear": sql("""SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM weighted""", "weighted"),
    "strip_fence_edges": sql(
        f"SELECT request_id, rank, CASE WHEN length(t) > 20 THEN t END AS result FROM "
        f"(SELECT request_id, rank, {_EDGES.format('result')} AS t FROM responses)", "responses"),
    "strip_fences_all": sql(
        f"SELECT request_id, rank, {fences_all('result', 'target')} AS converted, {fences_all('result', None)} AS answered "
        "FROM (SELECT *, CASE WHEN rank // 2 % 2 = 0 THEN 'c' ELSE 'python' END AS target FROM responses)", "responses"),
    "accept_response": sql("SELECT request_id, rank, result FROM accepted", "accepted"),
    "first_success": sql("SELECT * FROM first_ok", "first_ok"),
    "context_usage": sql(
        """SELECT request_id, lim AS "limit", pct AS limit_pct, CASE WHEN pct >= 80 THEN 'red' WHEN pct >= 60 THEN 'amber'
             ELSE 'green' END AS band, least(pct, 100.0)::DOUBLE AS bar FROM ok_usage""", "ok_usage"),
    "usage_by_model": sql(
        f"""SELECT model, count(*) AS calls, count(*) FILTER (length({strip('result')}) <= 20) AS failures,
              sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens,
              sum(total_tokens)::BIGINT AS total_tokens, round(avg(pct), 6) AS mean_pct,
              round(avg((pct >= 80)::INTEGER), 6) AS share_near_limit FROM usage GROUP BY model""", "usage"),
    "validate_request": sql("SELECT doc_id, coalesce(error, '') AS error FROM checked_some", "checked_some"),
    "build_prompts": sql(
        "SELECT doc_id, kind, CASE kind " + " ".join(f"WHEN {q(k)} THEN {_filled(v[0])}" for k, v in U.PROMPTS.items())
        + " END AS system, CASE kind " + " ".join(f"WHEN {q(k)} THEN {_filled(v[1])}" for k, v in U.PROMPTS.items())
        + f""" END AS "user" FROM (SELECT *, CASE WHEN task <> 'assistant' THEN task WHEN {strip("coalesce(code, '')")} = ''
             THEN 'generate' ELSE 'modify' END AS kind FROM checked WHERE error IS NULL)""", "checked"),
    "fallback_to_rules": sql(
        f"""SELECT a.doc_id, CASE WHEN a.old_line = '' THEN '' WHEN r.result <> '' THEN r.result ELSE a.old_line END AS review,
              CASE WHEN a.old_line = '' THEN '' WHEN r.result <> '' AND length({_EDGES.format('r.result')}) > 20 THEN {_EDGES.format('r.result')}
                   ELSE a.full_code END AS fixed
            FROM ({_SNIPPET_ANALYSIS.replace('{report}', 'tree_report').replace('{base}', 'base')}) a
            LEFT JOIN first_ok r ON r.request_id = a.doc_id""", "tree_report", "fixed", "base", "first_ok"),
    "recent_history": sql(_HISTORY, "snippets"),
    "recent_outputs": sql("""SELECT user_id, pos, doc_id, CASE WHEN length(code) > 40 THEN substring(code, 1, 40) || '…' ELSE code END AS prompt
        FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, doc_id DESC))::INTEGER AS pos FROM snippets)
        WHERE pos <= 6""", "snippets"),
    "analyze_stream": sql(_SNIPPET_ANALYSIS.replace("{report}", "tree_report").replace("{base}", "base"),
                          "tree_report", "fixed", "base"),
    "recent_history_stream": sql(_HISTORY, "snippets"),
}

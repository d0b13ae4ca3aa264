"""Structure checks on Python text: mutable defaults, recursion without a guard, division by zero.

They work on a skeleton of the code in which comments and string bodies are blanked and continued
lines joined. Defaults are read token by token with the bracket depth, scopes line by line with bracket
depth and indentation. Known limits against a syntax tree: expressions inside f-strings are not seen,
text that does not parse is still checked, and a called name in brackets of its own is no call.

The expressions are SQL text over column names, like the rule packs.
"""

from __future__ import annotations

from codegauge.functions import text as T
from codegauge.functions.text import quote

# One alternation, so a quote in a comment or a # in a string is not misread. The possessive
# loops keep the matcher from recursing on long strings; the look-ahead skips other characters fast.
_STRING_OR_COMMENT = (
    r'(?s)(?=["\'#])(?:(#[^\n]*)|"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\z)' r"|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\z)"
    r'|"(?:[^"\\\n]|\\.)*+"' r"|'(?:[^'\\\n]|\\.)*+')"
)
_COMMENT = T.rx(r"#[^\n]*")
_CONTINUED = "\\\n"
_HEAD = T.rx(r"(?m)^([^\S\n]*)def\s+(\w+)\s*(?:\[[^\]]*\]\s*)?\(")
_NO_DEFAULT = T.rx(r"^[^()=]*\)")
_TOKEN = T.rx(r"\*\*|:=|->|[=!<>]=|\w+|''|[^\s\w]")
_HEADER = T.rx(r"^\s*def\s+(\w+)\s*[(\[]")
_OPENS = T.rx(r"^\s*(?:(?:async\s+)?def|class)\s+\w+\s*\(")
_CALL = T.rx(r"(?<![\w.])(\w+)\s*\(")
_LAST_NAME = T.rx(r"(?<![\w.])(\w+)\s*\z")
_PAREN_FIRST = T.rx(r"^\s*\(")
_BLANK = T.rx(r"^\s*\z")
_DECORATOR = T.rx(r"^\s*@")
_IF = T.rx(r"^\s*(?:el)?if\b")
_INDENT = T.rx(r"^\s*")
# A constant that equals zero, as the whole right side of a true division: opening brackets, the
# constant, closing brackets, and what would bind the constant closer than the division does.
_ZERO = (r"(?:0[xX][0_]+|0[oO][0_]+|0[bB][0_]+|(?:0[0_]*(?:\.[0_]*)?|\.0[0_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?|False)(?![\w.])")
_DIVISION = T.rx(r"(?<!/)/(?![/=])\s*((?:\(\s*)*+)" + _ZERO + r"((?:\s*\))*+)([^\S\n]*(?:\*\*|[.\[(]))?")

# Necessary conditions on the raw text, each one linear pass.
_GAP = r"(?:[\s(\\]|#[^\n]*\n)*+"
_MAYBE_MUTABLE = T.rx(r"=" + _GAP + r"[\[{]")
_MAYBE_ZERO = T.rx(r"/" + _GAP + r"(?:\.?0|False)")
_DEFINED = T.rx(r"\bdef\s+(\w+)\s*[(\[]")
_CALLED = T.rx(r"\bdef\s+\w+\s*\(|(?<![\w.])(\w+)[\s\\]*\(")

NAMES_TYPE = "array<string>"
_FRAMES = "array<struct<indent:int,pos:int,name:string,rec:boolean,guarded:boolean>>"


def may_have_mutable(code: str) -> str:
    return f"(contains({code}, 'def') AND {code} RLIKE {quote(_MAYBE_MUTABLE)})"


def may_recurse(code: str) -> str:
    """Some name is both defined and called."""
    return (f"(contains({code}, 'def') AND arrays_overlap(regexp_extract_all({code}, {quote(_DEFINED)}, 1), "
            f"filter(regexp_extract_all({code}, {quote(_CALLED)}, 1), n -> n <> '')))")


def may_divide(code: str) -> str:
    return f"({code} RLIKE {quote(_MAYBE_ZERO)})"


def skeleton(code: str) -> str:
    """Strings empty, comments gone, continued lines joined. Once strings are empty, every # begins a comment."""
    emptied = f"regexp_replace({T.unify_breaks_sql(code)}, {quote(_STRING_OR_COMMENT)}, {quote("$1''")})"
    return f"replace(regexp_replace({emptied}, {quote(_COMMENT)}, ''), {quote(_CONTINUED)}, ' ')"


def _displays(tail: str) -> str:
    """How many positional defaults in the text behind a header's bracket are list, dict or set displays.

    A fold over tokens with the bracket depth. `at` is the place in a default: 0 none, 1 begun, 2 inside a
    display, 3 behind it, 4 in any other expression. A display may stand in brackets of its own; a
    comprehension, or an operator behind the display, makes another expression of it.
    """
    opens, closes = "t IN ('(', '[', '{')", "t IN (')', ']', '}')"
    ends = "(s.depth = 1 AND (t = ')' OR (t = ',' AND NOT s.lambda)))"
    at = (f"CASE WHEN {ends} THEN 0 "
          "WHEN s.at = 0 THEN if(s.depth = 1 AND t = '=' AND NOT s.lambda, 1, 0) "
          "WHEN s.at = 1 THEN CASE WHEN t = '(' THEN 1 WHEN t IN ('[', '{') THEN 2 ELSE 4 END "
          f"WHEN s.at = 2 AND s.depth = s.base + 1 THEN CASE WHEN {closes} THEN 3 WHEN t = 'for' THEN 4 ELSE 2 END "
          "WHEN s.at = 2 THEN 2 WHEN s.at = 3 AND t = ')' THEN 3 ELSE 4 END")
    step = (f"if(s.done, s, named_struct('depth', s.depth + CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END, "
            f"'at', {at}, 'base', if(s.at = 1 AND t IN ('[', '{{'), s.depth, s.base), "
            "'lambda', CASE WHEN s.depth = 1 AND t = 'lambda' THEN true WHEN s.depth = 1 AND t = ':' THEN false ELSE s.lambda END, "
            "'named', s.named OR (s.depth = 1 AND t = '*' AND s.last IN ('(', ',')), 'last', t, "
            f"'n', s.n + if({ends} AND s.at = 3 AND NOT s.named, 1, 0), 'done', s.depth = 1 AND t = ')'))")
    start = ("named_struct('depth', 1, 'at', 0, 'base', 0, 'lambda', false, 'named', false, 'last', '(', 'n', 0, 'done', false)")
    fold = f"aggregate(regexp_extract_all({tail}, {quote(_TOKEN)}, 0), {start}, (s, t) -> {step}, s -> s.n)"
    return f"if({tail} RLIKE {quote(_NO_DEFAULT)}, 0, {fold})"


def mutable_defaults(skel: str) -> str:
    """ARRAY<STRING>: the function name once per list, dict or set default of a positional parameter.

    Outer functions come first, then position: the order of a breadth-first walk.
    """
    part = "regexp_extract(h.head, {0}, {1})".format
    heads = (f"zip_with(regexp_extract_all({skel}, {quote(_HEAD)}, 0), filter(split({skel}, {quote(_HEAD)}, -1), (t, i) -> i > 0), "
             "(a, b) -> named_struct('head', a, 'tail', b))")
    found = (f"transform({heads}, (h, i) -> named_struct('indent', length({part(quote(_HEAD), 1)}), 'pos', i, "
             f"'name', {part(quote(_HEAD), 2)}, 'n', {_displays('h.tail')}))")
    return f"flatten(transform(sort_array({found}), x -> array_repeat(x.name, x.n)))"


def zero_divisions(skel: str) -> str:
    """How many true divisions have a constant equal to zero as their right side; // and % do not count.

    Brackets that open behind the division belong to its right side: nothing may be left open behind the
    constant, and nothing may bind it closer once they are closed.
    """
    part = f"regexp_extract(d, {quote(_DIVISION)}, {{0}})".format
    opened, closed = (f"length({x}) - length(replace({x}, '{c}', ''))" for x, c in ((part(1), "("), (part(2), ")")))
    return (f"size(filter(regexp_extract_all({skel}, {quote(_DIVISION)}, 0), "
            f"d -> {closed} > {opened} OR ({closed} = {opened} AND {part(3)} = '')))")


def _line_facts(line: str) -> str:
    """One line: indentation, the function it opens, calls, brackets, and whether it is an if."""
    return (f"named_struct('blank', {line} RLIKE {quote(_BLANK)}, "
            f"'indent', length(regexp_extract({line}, {quote(_INDENT)}, 0)), "
            f"'name', regexp_extract({line}, {quote(_HEADER)}, 1), "
            f"'calls', regexp_extract_all(regexp_replace({line}, {quote(_OPENS)}, '('), {quote(_CALL)}, 1), "
            f"'delta', length(translate({line}, ')]}}', '')) - length(translate({line}, '([{{', '')), "
            f"'tail', regexp_extract({line}, {quote(_LAST_NAME)}, 1), 'paren', {line} RLIKE {quote(_PAREN_FIRST)}, "
            f"'decorates', {line} RLIKE {quote(_DECORATOR)}, 'is_if', {line} RLIKE {quote(_IF)})")


def unguarded_recursion(skel: str) -> str:
    """ARRAY<STRING>: functions that call themselves and hold no if statement, in tree order.

    One pass over the lines keeps the bracket depth and the stack of open functions. A line that begins
    inside brackets continues its statement: it closes nothing, its `if` is no statement, and a bracket at
    its start calls the name that ended the line before. A function closes at the first statement indented
    no deeper than its header. Nested lines count for every open function, a decorator's calls for its own.
    The stack and the findings are copied only by lines that change them.
    """
    faulty = "filter({0}, f -> f.rec AND NOT f.guarded)"
    begins = "(s.depth = 0 AND NOT x.blank)"
    called = "(array_contains(x.calls, {0}) OR (s.depth > 0 AND x.paren AND s.tail = {0}))".format
    kept = f"filter(s.open, f -> NOT {begins} OR f.indent < x.indent)"
    still = (f"transform({kept}, f -> named_struct('indent', f.indent, 'pos', f.pos, 'name', f.name, "
             f"'rec', f.rec OR {called('f.name')}, 'guarded', f.guarded OR ({begins} AND x.is_if)))")
    opened = (f"array(named_struct('indent', x.indent, 'pos', s.pos, 'name', x.name, "
              f"'rec', {called('x.name')} OR array_contains(s.deco, x.name), 'guarded', false))")
    closes = f"{begins} AND exists(s.open, f -> f.indent >= x.indent)"
    step = ("named_struct('pos', s.pos + 1, 'depth', greatest(0, s.depth + x.delta), 'tail', if(x.blank, s.tail, x.tail), "
            f"'deco', CASE WHEN NOT {begins} THEN s.deco WHEN x.decorates THEN concat(s.deco, x.calls) ELSE CAST(array() AS {NAMES_TYPE}) END, "
            f"'open', CASE WHEN {begins} AND x.name <> '' THEN concat({still}, {opened}) WHEN size(s.open) = 0 THEN s.open ELSE {still} END, "
            f"'found', if({closes}, concat(s.found, {faulty.format('filter(s.open, f -> f.indent >= x.indent)')}), s.found))")
    start = (f"named_struct('pos', 0, 'depth', 0, 'tail', '', 'deco', CAST(array() AS {NAMES_TYPE}), "
             f"'open', CAST(array() AS {_FRAMES}), 'found', CAST(array() AS {_FRAMES}))")
    facts = f"transform(split({skel}, '\\n', -1), line -> {_line_facts('line')})"
    found = (f"aggregate({facts}, {start}, (s, x) -> {step}, "
             f"s -> concat(s.found, {faulty.format('s.open')}))")
    return f"transform(sort_array({found}), f -> f.name)"

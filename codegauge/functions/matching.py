"""Rule packs unrolled into literal-pattern expressions.

A pattern column would be compiled for every row; a literal is compiled once per task. The
outer CASE on the language keeps a row to its own pack. The expressions are written as SQL text
over column names: a pack has dozens of branches, and one parse is far cheaper than thousands of
calls into the JVM.

Hits are bits, 62 rules to a BIGINT word, in an array with as many words as the language's pack needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from codegauge.functions import text as T
from codegauge.functions.rulebook import PENALTY, RULES, Rule, by_lang, text_precondition
from codegauge.functions.text import quote

WORD_BITS = 62
_NO_HITS = "CAST(array() AS array<bigint>)"
_OWNED_TYPE = "array<struct<ord:int,line_no:int,line:string>>"


def _per_lang(lang: str, rules: list[Rule], build: Callable[[list[Rule]], str], default: str) -> str:
    packs = by_lang(rules)
    if not packs:
        return default
    branches = " ".join(f"WHEN {quote(name)} THEN {build(pack)}" for name, pack in packs.items())
    return f"CASE {lang} {branches} ELSE {default} END"


def _test(text: str, pattern: str) -> str:
    return f"{text} RLIKE {quote(T.rx(pattern))}"


def _bit(i: int) -> str:
    return f"{1 << i % WORD_BITS}L"


def _has(words: str, i: int) -> str:
    return f"(get({words}, {i // WORD_BITS}) & {_bit(i)}) <> 0"


def _words(tests: list[str]) -> str:
    """ARRAY<BIGINT> of bits, from one SQL value per rule: its bit or 0."""
    packed = [" | ".join(tests[i:i + WORD_BITS]) for i in range(0, len(tests), WORD_BITS)]
    return "array(" + ", ".join(f"({word})" for word in packed) + ")"


def rule_hits(code: str = "code", lang: str = "lang", rules: list[Rule] = RULES) -> Column:
    """ARRAY<BIGINT>: the bits of the language's rules that match anywhere in the text."""
    def build(pack: list[Rule]) -> str:
        return _words([f"if({_test(code, r.pattern)}, {_bit(i)}, 0L)" for i, r in enumerate(pack)])

    return F.expr(_per_lang(lang, rules, build, _NO_HITS))


def line_candidates(code: str = "code", lang: str = "lang", hits: str = "hits",
                    rules: list[Rule] = RULES) -> Column:
    """ARRAY<BIGINT>: rules that can own a line of the text, a superset of `hits`.

    Only rules whose whole-text match is stricter than their line match are searched again.
    """
    def build(pack: list[Rule]) -> str:
        words = [[f"get({hits}, {w})"] for w in range(-(-len(pack) // WORD_BITS))]
        for i, rule in enumerate(pack):
            core = text_precondition(rule.pattern)
            if core is None:
                words[i // WORD_BITS].append(_bit(i))
            elif core != rule.pattern:
                words[i // WORD_BITS].append(f"if({_test(code, core)}, {_bit(i)}, 0L)")
        return "array(" + ", ".join("(" + " | ".join(word) + ")" for word in words) + ")"

    return F.expr(_per_lang(lang, rules, build, hits))


def penalty(hits: str = "hits", lang: str = "lang", rules: list[Rule] = RULES) -> Column:
    """Points lost: the bits of each severity are counted at once."""
    def build(pack: list[Rule]) -> str:
        parts = []
        for severity, points in PENALTY.items():
            for w in range(0, len(pack), WORD_BITS):
                mask = sum(1 << i for i, r in enumerate(pack[w:w + WORD_BITS]) if r.severity == severity)
                if mask:
                    parts.append(f"bit_count(get({hits}, {w // WORD_BITS}) & {mask}L) * {points}")
        return "(" + (" + ".join(parts) or "0") + ")"

    return F.expr(_per_lang(lang, rules, build, "0"))


def hit_ids(hits: str = "hits", lang: str = "lang", rules: list[Rule] = RULES) -> Column:
    """ARRAY<STRING> of the rules in a hit mask, in pack order."""
    def build(pack: list[Rule]) -> str:
        return "array_compact(array(" + ", ".join(
            f"if({_has(hits, i)}, {quote(r.rule_id)}, NULL)" for i, r in enumerate(pack)) + "))"

    return F.expr(_per_lang(lang, rules, build, "CAST(array() AS array<string>)"))


def owned_lines(code: str = "code", lang: str = "lang", candidates: str = "candidates",
                rules: list[Rule] = RULES) -> Column:
    """ARRAY<STRUCT<ord, line_no, line>>: each line with the first rule of the pack that hits it.

    Row-local, so neither a shuffle nor a regrouping by document is needed. Documents without
    a candidate rule are not split at all, and a line is tested against candidates only.
    """
    empty = f"CAST(array() AS {_OWNED_TYPE})"

    def build(pack: list[Rule]) -> str:
        first = "coalesce(" + ", ".join(
            f"if({_has(candidates, i)} AND {_test('x', r.pattern)}, {i}, NULL)" for i, r in enumerate(pack)) + ")"
        found = (f"filter(transform({T.split_lines_sql(code)}, (x, i) -> "
                 f"named_struct('ord', {first}, 'line_no', i + 1, 'line', x)), f -> f.ord IS NOT NULL)")
        return (f"transform({found}, f -> named_struct('ord', f.ord, 'line_no', f.line_no, "
                f"'line', {T.strip_sql('f.line')}))")

    found = _per_lang(lang, rules, build, empty)
    return F.expr(f"if(exists({candidates}, w -> w <> 0), {found}, {empty})")


def pick_sql(lang: str, ord_: str, field: str, rules: list[Rule] = RULES) -> str:
    """A rule attribute (rule_id, severity, message) by language and position: array indexing."""
    def literal(rule: Rule) -> str:
        value = getattr(rule, field)
        return str(value) if isinstance(value, int) else quote(value)

    return _per_lang(lang, rules,
                     lambda pack: f"get(array({', '.join(literal(r) for r in pack)}), {ord_})", "NULL")


def pick(field: str, lang: str = "lang", ord_: str = "ord", rules: list[Rule] = RULES) -> Column:
    return F.expr(pick_sql(lang, ord_, field, rules))


def report_entries(lang: str = "lang", owned: str = "owned", rules: list[Rule] = RULES) -> Column:
    """ARRAY<STRING> of report entries, in (rule order, line) order."""
    from codegauge.functions.score import ENTRY_SQL

    def build(pack: list[Rule]) -> str:
        severity = f"get(array({', '.join(str(r.severity) for r in pack)}), f.ord)"
        message = f"get(array({', '.join(quote(r.message) for r in pack)}), f.ord)"
        return f"transform(sort_array({owned}), f -> {ENTRY_SQL.format(severity=severity, message=message)})"

    return F.expr(_per_lang(lang, rules, build, "CAST(array() AS array<string>)"))

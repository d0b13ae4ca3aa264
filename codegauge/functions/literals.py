"""Rule packs of any size: an index over the literals that patterns cannot match without.

Most patterns hold a piece of plain text that stands in every match. One Aho-Corasick automaton over those pieces reads a line
once, whatever the number of rules, and only the rules whose literal it met are tried; rules without such a literal are tried on
every line.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cached_property
from re import _constants as K, _parser

import ahocorasick

#: A pattern that may be met by more texts than this counts as one without a literal.
_MOST_ALTERNATIVES = 64


def needed_literals(pattern: str) -> list[str] | None:
    """Texts of which every match of the pattern holds at least one; None where the pattern names none."""
    tree = _parser.parse(pattern)
    found = None if tree.state.flags & re.IGNORECASE else _needed(tree)
    return sorted(found) if found else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The choice that fewer texts meet: longer literals, then fewer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _needed(tree) -> frozenset[str] | None:
    best, run = None, ""

    def ended(run: str) -> frozenset[str] | None:
        return frozenset([run]) if run else None

    for op, arg in tree:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):  # no width: what stands beside it stays together
            continue
        best, run = _better(best, ended(run)), ""
        if op is K.SUBPATTERN:
            best = best if arg[1] & re.IGNORECASE else _better(best, _needed(arg[3]))
        elif op is K.ATOMIC_GROUP:
            best = _better(best, _needed(arg))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _better(best, _needed(arg[2]))
        elif op is K.BRANCH:
            parts = [_needed(part) for part in arg[1]]
            if all(parts) and sum(map(len, parts)) <= _MOST_ALTERNATIVES:
                best = _better(best, frozenset().union(*parts))
    return _better(best, ended(run))


class LineIndex:
    """The rules of one language, least position first; finds the rule that owns a line."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = patterns

    @cached_property
    def _compiled(self) -> list[re.Pattern[str] | None]:
        return [None] * len(self.patterns)

    @cached_property
    def _index(self) -> tuple[ahocorasick.Automaton | None, list[int]]:
        by_literal, free = defaultdict(list), []
        for number, pattern in enumerate(self.patterns):
            literals = needed_literals(pattern)
            if literals is None:
                free.append(number)
            for literal in literals or []:
                by_literal[literal].append(number)
        if not by_literal:
            return None, free
        automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            automaton.add_word(literal, numbers)
        automaton.make_automaton()
        return automaton, free

    def candidates(self, line: str) -> list[int]:
        automaton, free = self._index
        if automaton is None:
            return free
        met = {n for _, numbers in automaton.iter(line) for n in numbers}
        return sorted(met.union(free)) if met else free

    def owner(self, line: str) -> int | None:
        """The first rule that matches the line."""
        for number in self.candidates(line):
            pattern = self._compiled[number]
            if pattern is None:
                pattern = self._compiled[number] = re.compile(self.patterns[number])
            if pattern.search(line):
                return number
        return None

"""Random code-like texts and small independent models of the operators."""

from __future__ import annotations

import random
import re

from codegauge.functions.rulebook import RULES

TOKENS = [
    "except", ":", " ", "\n", "    ", "==", "!=", "None", "eval", "(", ")", "exec", "from x import *", "import *",
    "global", "time.sleep(", "pickle.loads(", "pickle.load(", "shell = True", "hashlib.md5", "hashlib.sha1 (",
    "password", "=", "'a'", '"b"', "random.random()", "type(x) ==", "assert", "range(len(", "print(", "os.system(",
    "open('f')", "as", "with ", "def f(a=[], b={}):", "    def g(x):", "def ", "self", "return", "if x:", "\n\n",
    "api_key = 'z'", "var ", ".innerHTML =", "document.write(", "setTimeout('", "localStorage.setItem", "delete a[",
    "JSON.parse(", "console.log(", "== \"s\"", "catch (Exception", "System.out.print", ".length() == 0",
    "Thread.sleep(", "null", "Integer.parseInt(", "static List", "result += x;", "gets(", "scanf(\"%s\"", "strcpy(",
    "strcat(", "sprintf(", "malloc(n);", "free(p);", "p = NULL", "NULL ==", "printf(x)", "int main()", "strcmp(",
    "system(", "char c[3] = gets", "while (1)", "for (;;)", "\t", "é", "x", "0.5", "0", "/", "SELECT", "+", "md5(",
    "open(", "=+", "#", "\r\n", "\r", "\x0b", " ", "try", "import os", "__init__", "(self)", "(self, x):",
]


def texts(n: int, seed: int, longest: int = 14) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(TOKENS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def pack(lang: str):
    return [r for r in RULES if r.lang == lang]


def hits(code: str, lang: str) -> list[str]:
    return [r.rule_id for r in pack(lang) if re.search(r.pattern, code)]


def owners(code: str, lang: str) -> list[tuple[int, str, str]]:
    """(line number, rule, stripped line) of every line that some rule matches."""
    out = []
    for number, line in enumerate(code.splitlines(), 1):
        first = next((r for r in pack(lang) if re.search(r.pattern, line)), None)
        if first:
            out.append((number, first.rule_id, line.strip()))
    return out


def similarity(a: str, b: str) -> int:
    return sum(x == y for x, y in zip(a[:50], b[:50]))

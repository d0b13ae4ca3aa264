"""The rule packs.

Fixed values: identifiers, patterns and severities (3 critical, 2 moderate, 1 minor) below are
data that decides results; their order inside a language decides which rule owns a line.
The message wording is this project's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    lang: str
    ord: int
    pattern: str
    severity: int
    message: str


_PACKS = {
    "python": ("py", [
        (r"except\s*:", 2, "handler catches everything; name the exception type"),
        (r"==\s*None", 1, "compare with None by identity: is None"),
        (r"!=\s*None", 1, "compare with None by identity: is not None"),
        (r"\beval\s*\(", 3, "eval runs any expression it is given; parse literals instead"),
        (r"\bexec\s*\(", 3, "exec runs any statement it is given; avoid it"),
        (r"from .+? import \*|import \*", 1, "star import hides where names come from"),
        (r"\bglobal\b", 1, "global state; hand the value over as a parameter"),
        (r"time\.sleep\s*\(", 2, "the thread is blocked while it sleeps"),
        (r"pickle\.loads?\s*\(", 3, "unpickling foreign data can run code; use a data format"),
        (r"shell\s*=\s*True", 3, "command goes through a shell; pass an argument list"),
        (r"hashlib\.md5|hashlib\.sha1", 3, "weak digest; choose a modern one"),
        (r"password\s*=\s*['\"].+['\"]", 3, "secret written in the code; read it from the environment"),
        (r"random\.randint|random\.random\(", 2, "predictable random numbers; use secrets for tokens"),
        (r"type\s*\([^)]+\)\s*==", 1, "compare types with isinstance"),
        (r"\bassert\b", 1, "asserts vanish under -O; raise an error"),
        (r"range\s*\(\s*len\s*\(", 1, "index loop; enumerate the items"),
        (r"\bprint\s*\(", 1, "print in library code; use a logger"),
        (r"os\.system\s*\(", 2, "os.system starts a shell; use subprocess with a list"),
        (r"open\s*\([^)]+\)(?!\s*as)", 2, "file may stay open; use a with block"),
    ]),
    "java": ("ja", [
        (r'==\s*"[^"]*"', 2, "strings compared by reference; call equals"),
        (r"catch\s*\(\s*Exception\b", 2, "catches every exception; name the type"),
        (r"System\.out\.print", 1, "console output; use a logger"),
        (r"\.length\s*\(\s*\)\s*==\s*0", 1, "ask isEmpty instead of the length"),
        (r"Thread\.sleep\s*\(", 2, "the thread is blocked while it sleeps"),
        (r"==\s*null|null\s*==", 2, "null test; consider Optional or Objects.isNull"),
        (r"Integer\.parseInt\s*\(", 2, "parsing may throw; handle bad numbers"),
        (r"static\s+(?:List|Map|Set|ArrayList)\b", 2, "shared mutable collection is not thread-safe"),
        (r"result\s*\+=\s*\w+\s*;", 2, "string grown in a loop; use a StringBuilder"),
    ]),
    "javascript": ("js", [
        (r"\beval\s*\(", 3, "eval runs any script it is given; remove it"),
        (r"\bvar\s+", 1, "function-scoped variable; use let or const"),
        (r"\.innerHTML\s*=", 3, "markup set from data; set text instead"),
        (r"document\.write\s*\(", 2, "document.write replaces the page; use DOM calls"),
        (r"setTimeout\s*\(\s*['\"]", 2, "timer evaluates a string; pass a function"),
        (r"localStorage\.setItem", 3, "stored data is readable by any script on the page"),
        (r"delete\s+\w+\[", 2, "leaves a hole in the array; use splice"),
        (r"JSON\.parse\s*\(", 2, "parsing may throw; guard it"),
        (r"console\.log\s*\(", 1, "debug output left in"),
    ]),
    "c": ("c", [
        (r"\bgets\s*\(", 3, "no bound on the input; use fgets"),
        (r'\bscanf\s*\(\s*"%s"', 3, "no bound on the input; give a field width"),
        (r"\bstrcpy\s*\(", 3, "copy without a bound; use strncpy or strlcpy"),
        (r"\bstrcat\s*\(", 3, "append without a bound; use strncat"),
        (r"\bsprintf\s*\(", 3, "format without a bound; use snprintf"),
        (r"\bmalloc\s*\([^)]+\)\s*;(?!\s*if)", 2, "allocation result is not tested"),
        (r"\bfree\s*\(\s*\w+\s*\)\s*;(?!.*\w+\s*=\s*NULL)", 2, "pointer keeps its value after free; reset it"),
        (r"==\s*NULL|NULL\s*==", 1, "spell the null test out"),
        (r"\bprintf\s*\(\s*\w+\s*\)", 3, "variable used as the format; pass it as an argument"),
        (r"int\s+main\s*\(\s*\)", 1, "state the parameters of main"),
        (r"#include\s*<string\.h>.*\bstrcmp\b|strcmp\s*\(", 1, "strcmp is zero for equal texts"),
        (r"\bsystem\s*\(", 3, "starts a command interpreter; use the exec family"),
        (r"char\s+\w+\s*\[\s*\d+\s*\].*=.*gets|gets.*char\s+\w+", 3, "buffer filled without a bound"),
        (r"while\s*\(\s*1\s*\)|for\s*\(\s*;\s*;\s*\)", 2, "endless loop; make sure it can stop"),
    ]),
}

RULES: list[Rule] = [
    Rule(f"{prefix}{i:02d}", lang, i, pattern, severity, message)
    for lang, (prefix, pack) in _PACKS.items()
    for i, (pattern, severity, message) in enumerate(pack)
]

# Points lost per severity, per structure finding and per linter line.
PENALTY = {1: 5, 2: 12, 3: 22}
STRUCTURE_PENALTY = 10
LINT_PENALTY = 3


def by_lang(rules: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: r.ord):
        out.setdefault(rule.lang, []).append(rule)
    return out


def text_precondition(pattern: str) -> str | None:
    """A pattern that must hit the whole text if `pattern` hits one of its lines.

    A trailing negative look-ahead can see the next line, so it is cut off. Patterns with
    anchors, other look-around or inline flags have no safe precondition: None.
    """
    core = re.sub(r"\(\?!(?:[^()\\]|\\.)*\)\Z", "", pattern)
    plain = re.sub(r"\\\\|\\[$^(]", "", core).replace("[^", "[")
    if re.search(r"[\^$]|\\[AzZGB]|\(\?[^:]", plain):
        return None
    return core

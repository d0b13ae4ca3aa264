"""Automatic fixes as whole-text replacements.

Lines are first joined by plain newlines. From then on a blank that must not cross a line is
written `[^\\S\\n]` and `.` stops at newlines, so replacing in the whole text equals replacing
line by line, and the text is never split. Only a mutable default needs lines, because it adds some.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codegauge.functions import text as T

_S = r"[^\S\n]"
_M = "(?m)"

# What each fix looks for and what it writes, in the order they are applied.
PYTHON_REPLACEMENTS = [
    ("none_eq", rf"=={_S}*None", "is None"),
    ("none_ne", rf"!={_S}*None", "is not None"),
    ("bare_except", rf"except{_S}*:", "except Exception as e:"),
    ("md5", rf"hashlib\.md5{_S}*\(", "hashlib.sha256("),
    ("sha1", rf"hashlib\.sha1{_S}*\(", "hashlib.sha256("),
    ("os_system", rf"os\.system{_S}*\(", "subprocess.run("),
]
PYTHON_SECRETS = [
    ("password", rf"(password{_S}*={_S}*)['\"].+['\"]", r"$1os.environ.get('PASSWORD', '')"),
    ("api_key", rf"(api_key{_S}*={_S}*)['\"].+['\"]", r"$1os.environ.get('API_KEY', '')"),
]
JAVASCRIPT_REPLACEMENTS = [
    ("var", rf"\bvar{_S}+", "let "),
    ("inner_html", rf"\.innerHTML{_S}*=", ".textContent ="),
]
JAVA_REPLACEMENTS = [
    ("length_zero", rf"\.length{_S}*\({_S}*\){_S}*=={_S}*0", ".isEmpty()"),
]
IMPORT_NEEDS = [
    ("os.environ", "import os"),
    ("subprocess.run", "import subprocess"),
    ("logging", "import logging"),
    ("hashlib", "import hashlib"),
]

_METHOD = rf"^({_S}{{4,}}def{_S}+)(?!__)(\w+){_S}*\((?!self\b){_S}*+"
_METHOD_NO_ARGS = _M + _METHOD + rf"\){_S}*:.*"
_METHOD_ARGS = _M + _METHOD + rf"([^)\n]+?){_S}*\){_S}*:.*"
_HEAD = rf"^({_S}*def{_S}+\w+{_S}*\()(.*)(\){_S}*:).*"
_LIST_DEFAULT = rf"(\w+){_S}*={_S}*\[\]"
_DICT_DEFAULT = rf"(\w+){_S}*={_S}*\{{\}}"
MUTABLE_HEAD = _M + rf"^{_S}*def{_S}+\w+{_S}*\(.*\w{_S}*={_S}*(?:\[\]|\{{\}}).*\){_S}*:"


def _sub(text: Column, pattern: str, to: str, any_case: bool = False) -> Column:
    flags = T.FLAGS_ANYCASE if any_case else T.FLAGS
    return F.regexp_replace(text, flags + pattern, to)


def add_self(text: Column) -> Column:
    """Indented functions without self get it; whatever follows the header colon is dropped."""
    return _sub(_sub(text, _METHOD_NO_ARGS, "$1$2(self):"), _METHOD_ARGS, "$1$2(self, $3):")


def _expand_header(line: Column) -> Column:
    head = F.regexp_extract(line, T.rx(_HEAD), 1)
    args = F.regexp_extract(line, T.rx(_HEAD), 2)
    tail = F.regexp_extract(line, T.rx(_HEAD), 3)
    indent = F.concat(F.regexp_extract(line, T.rx(r"^\s*"), 0), F.lit("    "))

    def guards(pattern: str, empty: str) -> Column:
        return F.transform(
            F.regexp_extract_all(args, F.lit(T.rx(pattern)), F.lit(1)),
            lambda v: F.concat(indent, F.lit("if "), v, F.lit(" is None: "), v, F.lit(f" = {empty}")))

    bare = _sub(_sub(args, _LIST_DEFAULT, "$1=None"), _DICT_DEFAULT, "$1=None")
    return F.concat(F.array(F.concat(head, bare, tail)),
                    guards(_LIST_DEFAULT, "[]"), guards(_DICT_DEFAULT, "{}"))


def shorten_headers(text: Column) -> Column:
    """One-line headers lose whatever follows their colon."""
    return _sub(text, _M + _HEAD, "$1$2$3")


def guard_defaults(short: Column) -> Column:
    """Mutable defaults of one-line headers become None plus one guard line each."""
    expanded = F.array_join(F.flatten(F.transform(
        F.split(short, "\n", -1),
        lambda line: F.when(line.rlike(T.rx(MUTABLE_HEAD)), _expand_header(line)).otherwise(F.array(line)),
    )), "\n")
    return F.when(short.rlike(T.rx(MUTABLE_HEAD)), expanded).otherwise(short)


def missing_imports(text: Column) -> Column:
    """ARRAY<STRING> of the import lines the fixed text needs."""
    return F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(use)) & ~F.contains(text, F.lit(line)), line)
        for use, line in IMPORT_NEEDS]))


def add_imports(text: Column) -> Column:
    lines = missing_imports(text)
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), text)).otherwise(text)


def python_steps(text: Column) -> list[tuple[str, Column]]:
    """(step, text after it) in order; each step reads the one before."""
    steps: list[tuple[str, Column]] = []
    for name, pattern, to in PYTHON_REPLACEMENTS:
        text = _sub(text, pattern, to)
        steps.append((name, text))
    for name, pattern, to in PYTHON_SECRETS:
        text = _sub(text, pattern, to, any_case=True)
        steps.append((name, text))
    text = add_self(text)
    steps.append(("add_self", text))
    return steps


def fix_python(text: Column) -> Column:
    """All replacements that keep the number of lines."""
    return shorten_headers(python_steps(text)[-1][1])


def fix_javascript(text: Column) -> Column:
    for _, pattern, to in JAVASCRIPT_REPLACEMENTS:
        text = _sub(text, pattern, to)
    return text


def fix_java(text: Column) -> Column:
    for _, pattern, to in JAVA_REPLACEMENTS:
        text = _sub(text, pattern, to)
    return text


def fix_in_place(text: Column, lang: Column) -> Column:
    """Replacements of joined text by language; other languages keep their lines."""
    return (F.when(lang == "python", fix_python(text))
            .when(lang == "javascript", fix_javascript(text))
            .when(lang == "java", fix_java(text))
            .otherwise(text))

"""Language names, file suffixes and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix -> language when reading, language -> suffix when writing.
LANG_BY_SUFFIX = {".py": "python", ".java": "java", ".js": "javascript", ".ts": "javascript"}
SUFFIX_BY_LANG = {"python": "py", "java": "java", "javascript": "js", "c": "c"}
EDITOR_LANG = {"typescript": "javascript", "cpp": "python", "go": "python"}
DEFAULT_LANG = "python"

# The suffix of the last path part; leading dots of a name start no suffix.
_SUFFIX = r"[^/.]\.*(\.[^/.]*)\z"


def _choose(key: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(path, _SUFFIX, 1)


def lang_of_path(path: Column, override: Column | None = None) -> Column:
    found = _choose(F.lower(path_suffix(path)), LANG_BY_SUFFIX, F.lit(DEFAULT_LANG))
    return found if override is None else F.coalesce(override, found)


def ext_of_lang(lang: Column) -> Column:
    return _choose(lang, SUFFIX_BY_LANG, F.lit("txt"))


def normalise_lang(lang: Column) -> Column:
    return _choose(lang, EDITOR_LANG, lang)


def fixed_path(path: Column, lang: Column) -> Column:
    """`dir/name.py` -> `dir/name_fixed.py`; only the final suffix is replaced."""
    stem_len = F.length(path) - F.length(path_suffix(path))
    return F.concat(F.substring(path, F.lit(1), stem_len), F.lit("_fixed."), ext_of_lang(lang))

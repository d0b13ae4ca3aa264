from pyspark.sql import functions as F

from codegauge.functions import lang as L, text as T
from helpers import texts


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, code string")


def test_text_primitives_match_python(spark):
    values = texts(600, 1) + ["", "a", "a\n", "a\n\n", "a\r\nb", "\n", " \t　x\x1f ", "\x85", "a\x1cb"]
    code = F.col("code")
    rows = frame(spark, values).select(
        "i", T.split_lines(code).alias("lines"), T.line_count(code).alias("n"), T.char_count(code).alias("chars"),
        T.newline_count(code).alias("nl"), T.strip(code).alias("s"), T.is_blank(code).alias("blank"),
        T.history_preview(code).alias("h"), T.prompt_preview(code).alias("p")).collect()
    for r in rows:
        v = values[r.i]
        assert r.lines == v.splitlines(), repr(v)
        assert (r.n, r.chars, r.nl) == (len(v.splitlines()), len(v), v.count("\n")), repr(v)
        assert (r.s, r.blank) == (v.strip(), not v.strip()), repr(v)
        assert r.h == v[:120] and r.p == (v if len(v) <= 40 else v[:40] + "…")


def test_languages_and_paths(spark):
    cases = {"x.TS": ("javascript", "x_fixed.js"), "x.unknown": ("python", "x_fixed.py"), "a.py/b": ("python", "a.py/b_fixed.py"),
             "d.js/m.js": ("javascript", "d.js/m_fixed.js"), ".bashrc": ("python", ".bashrc_fixed.py"),
             "A.java": ("java", "A_fixed.java"), "t.tar.gz": ("python", "t.tar_fixed.py")}
    lang = L.lang_of_path(F.col("code"))
    got = {r.code: (r.lang, r.out) for r in frame(spark, cases).select(
        "code", lang.alias("lang"), L.fixed_path(F.col("code"), lang).alias("out")).collect()}
    assert got == cases
    names = spark.createDataFrame([("typescript",), ("cpp",), ("go",), ("c",)], "n string")
    rows = names.select(L.normalise_lang(F.col("n")), L.ext_of_lang(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("javascript", "txt"), ("python", "txt"), ("python", "txt"), ("c", "c")]
    assert names.select(L.lang_of_path(F.lit("a.py"), F.lit("java"))).first()[0] == "java"

from pyspark.sql import functions as F

from codegauge.operators import structure

# Code, then by hand: functions once per mutable default, recursive functions without an if, divisions by zero.
SAMPLES = [
    ("def f(a=[], b={}, c={1}, d=(), e=None):\n    return a", ["f", "f", "f"], [], 0),
    ("def f(a, *, b=[]):\n    pass\ndef g(*args, c={}):\n    pass", [], [], 0),
    ("def f(\n    a: list = [],\n    b=max(1, 2),\n):\n    return a", ["f"], [], 0),
    ("async def f(a=[]):\n    return f(a)", [], [], 0),
    ("def fact(n):\n    return n * fact(n - 1)", [], ["fact"], 0),
    ("def fact(n):\n    if n < 2:\n        return 1\n    return n * fact(n - 1)", [], [], 0),
    ("def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)", [], ["fact"], 0),
    ("def outer():\n    def inner():\n        return outer()\n    return inner\n\ndef other():\n    pass", [], ["outer"], 0),
    ("def outer():\n    def inner(x):\n        if x:\n            return 1\n    return outer()", [], [], 0),
    ("def f(x):\n    return self.f(x)", [], [], 0),
    ("def f(x):\n    # f(x)\n    return 'f(x)'", [], [], 0),
    ("def f(x):\n    \"\"\"calls f(x)\n    and if\n\"\"\"\n    return f(x)", [], ["f"], 0),
    ("def f(x): return f(x)\nf(1)", [], ["f"], 0),
    ("class A:\n    def m(self, x=[]):\n        return m(x)\n    def k(self):\n        return k()\n", ["m"], ["m", "k"], 0),
    ("def a(x={}):\n    def b(y=[]):\n        return b(y)\n    return a(x)\ndef c():\n    return c()", ["a", "b"], ["a", "c", "b"], 0),
    ("x = 1 / 0\ny = 1 // 0\nz = 1 % 0\nw = 1 / 0.0", [], [], 2),
    ("x = a / 0 / 0\ny = 1 / 0.5\nz = 1 / 00\nw = 10 / 05.0", [], [], 3),
    ("x = '1 / 0'  # 1 / 0\ny = (1 /\n 0)\nx /= 0", [], [], 1),
    ("def f(a, /, b=0):\n    return a", [], [], 0),
    ("def loop(\n    n,\n):\n    while n:\n        loop(n)\n", [], ["loop"], 0),
    ("x = \"it's\"\ny = 1 / 0 # don't\nz = 'a\\'b' / 0", [], [], 2),
    ("def long(s):\n    t = '" + "a" * 30000 + "'\n    return long(t)", [], ["long"], 0),
    ("def f(x):\n    if_only = x\n    return f(if_only)", [], ["f"], 0),
    # nested brackets, and displays that are only a part of the default
    ("def f(a=g(h(1)), b=[]):\n    pass", ["f"], [], 0),
    ("def f(a=dict(a=[1]), b=(1, [2]), c=g([{}])):\n    pass", [], [], 0),
    ("def f(a=([]), b=(({})), c=([],), d=[] or None, e=[1][0], g=[] + [2]):\n    pass", ["f", "f"], [], 0),
    ("def f(a=[x for x in y], b={k: v for k, v in z}, c=[(i for i in j)], d={*e}):\n    pass", ["f", "f"], [], 0),
    ("def f(a: dict[str, list] = {}, b: 'x=[]' = None, c=lambda p, q=[]: p, d=[1, [2]]):\n    pass", ["f", "f"], [], 0),
    ("def f[T](a: T = [], /, b=[], *c, d=[]):\n    def g(x=\\\n{}): pass", ["f", "f", "g"], [], 0),
    ("def f(a=[  # why\n    1,\n    2]) -> list: return [3]", ["f"], [], 0),
    ("x = dict(a=[1])\ndef f(a): return {}\ny = f(a=[])", [], [], 0),
    # statements over several lines
    ("def f(x):\n    return [f(y)\n            for y in x\n            if y]", [], ["f"], 0),
    ("def f(x):\n    return (f\n(x - 1))", [], ["f"], 0),
    ("def f(x):\n    return g(\nx,\n\nf(x)\n)\nif x:\n    pass", [], ["f"], 0),
    ("def f(x):\n    y = f\n    (x)", [], [], 0),
    ("def f(x):\n    z = 1 + \\\nf(x)\n    return z", [], ["f"], 0),
    ("def f(x,\nif_=None):\n    try:\n        f(x)\n    except E:\n        pass\n    else:\n        z = 0\n    elif_ = 1", [], ["f"], 0),
    ("@f(1)\n@other\ndef f(x):\n    pass\n\n@f(2)\ndef g(): pass\n", [], ["f"], 0),
    ("def f(x, y=f(1)):\n    pass\ndef g(x) -> g(2): pass", [], ["f", "g"], 0),
    ("def f(x):\n    async def f(y):\n        pass\n    class f(object):\n        pass", [], [], 0),
    # every spelling of zero, and what binds closer than the division
    ("a = 1 / 0x0 + 1 / 0b00 + 1 / 0o0 + 1 / 0_0 + 1 / 0j + 1 / .0 + 1 / 0. + 1 / 0e5 + 1 / 0.0E-3j + 1 / False", [], [], 10),
    ("a = 1 / 0x10 + 1 / 0b1 + 1 / 0.01 + 1 / 1e0 + 1 / zero + 1 / 0xF0 + 1 / Falsely + 1 / -0", [], [], 0),
    ("a = 1 / (0) + 1 / ((0.0)) + (1 / 0) ** 2 + f(1 / 0) + g[1 / (0)]", [], [], 5),
    ("a = 1 / 0 ** 2 + 1 / (0) ** 2 + 1 / (0 + 1) + 1 / (0, 1) + 1 / 0 .real + 1 / (0)[1] + 1 / (0)(2)", [], [], 0),
    ("a = 1 / 0\n(b, c) = d\ne = 1 / (  # zero\n  0\n)\n[f] = g", [], [], 2),
    ("a = 1 / 0 if b else 1 / 0 * 2 @ c", [], [], 2),
]


def test_findings_are_those_noted_beside_the_samples(spark):
    rows = [(i, "python", s[0]) for i, s in enumerate(SAMPLES)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, code string")
    got = {r.doc_id: r.structure for r in structure.with_structure(df).collect()}
    for i, (code, mutable, recursive, zero) in enumerate(SAMPLES):
        assert (got[i].mutable, got[i].recursive, got[i].zero_divs) == (mutable, recursive, zero), code[:200]


def test_other_languages_have_no_structure_findings(spark):
    df = spark.createDataFrame([(1, "java", SAMPLES[0][0]), (2, "java", SAMPLES[15][0])], "doc_id bigint, lang string, code string")
    assert structure.with_structure(df).filter(structure.structure_count(F.col("structure")) > 0).count() == 0


def test_long_text_is_checked_by_the_exact_pass(spark):
    code = "x = 1\n" * 20000 + "def f(n):\n    return f(n)\n"
    df = spark.createDataFrame([(1, "python", code)], "doc_id bigint, lang string, code string")
    assert structure.unbounded_recursion_findings(df).first().function_name == "f"


def test_lint_log_keeps_the_first_ten_positions(spark):
    rows = [(1, i, f"/t/a.py/b.py:{i}:2: C0103: bad name") for i in range(30)] + [(1, -1, "*** Module a"), (2, 0, "x:1:2:")]
    got = structure.lint_log_findings(spark.createDataFrame(rows, "doc_id bigint, seq int, line string"))
    assert [(r.doc_id, r.text) for r in got.orderBy("doc_id", "pos").collect()] == [
        (1, f"Line {i}: bad name") for i in range(10)] + [(2, "x:1:2:")]

import re

from codegauge.operators import fixes
from helpers import texts

# Language, code, and by hand what the fixes make of it.
CASES = [
    ("python", "if a ==None or b !=  None:", "if a is None or b is not None:"),
    ("python", "try:\n    go()\nexcept  :\n    pass", "try:\n    go()\nexcept Exception as e:\n    pass"),
    ("python", "import hashlib\nh = hashlib.md5 (x) + hashlib.sha1(y)", "import hashlib\nh = hashlib.sha256(x) + hashlib.sha256(y)"),
    ("python", "h = hashlib.md5(x)", "import hashlib\n\nh = hashlib.sha256(x)"),
    ("python", "import os\nos.system( 'ls')", "import subprocess\n\nimport os\nsubprocess.run( 'ls')"),
    ("python", "Password = 'a' + \"b\"\napi_key='c'", "import os\n\nPassword = os.environ.get('PASSWORD', '')\napi_key=os.environ.get('API_KEY', '')"),
    ("python", "logging.info(password == 'x')", "import logging\n\nlogging.info(password == 'x')"),
    ("python", "def f(a=[], b={}): return 1", "def f(a=None, b=None):\n    if a is None: a = []\n    if b is None: b = {}"),
    ("python", "def f(a = [] , b={ }):", "def f(a=None , b={ }):\n    if a is None: a = []"),
    ("python", "def r(a={}, b=[], c={}):\n\n",
     "def r(a=None, b=None, c=None):\n    if b is None: b = []\n    if a is None: a = {}\n    if c is None: c = {}\n"),
    ("python", "def q(a=[], c=(1)) : # )", "def q(a=None, c=(1)) :\n    if a is None: a = []"),
    ("python", "def p(x=[])\n:", "def p(x=[])\n:"),
    ("python", "    def g( ): pass", "    def g(self):"),
    ("python", "    def g(\tx , y ) : x", "    def g(self, x , y):"),
    # only a self right behind the bracket counts
    ("python", "    def m( self):\n    def n(selfish=[]):", "    def m(self, self):\n    def n(self, selfish=None):\n        if selfish is None: selfish = []"),
    ("python", "      def __h(x):\n\tdef k(x):", "      def __h(x):\n\tdef k(x):"),
    ("python", "a\r\nb\x0bc\n", "a\nb\nc"),
    ("python", "\n", ""),
    ("python", "", ""),
    ("javascript", "var x = 1; var  y;\nbox.innerHTML = z; invar a", "let x = 1; let y;\nbox.textContent = z; invar a"),
    ("javascript", "var\nx", "var\nx"),
    ("java", "if (s.length( ) ==  0 && t.length() == 1)", "if (s.isEmpty() && t.length() == 1)"),
    ("c", "x == NULL; var y\r\n", "x == NULL; var y"),
    ("ruby", "a == None", "a == None"),
]


def test_fixes_are_those_noted_beside_the_cases(spark):
    df = spark.createDataFrame([(i, lang, code) for i, (lang, code, _) in enumerate(CASES)], "doc_id bigint, lang string, code string")
    got = {r.doc_id: r.fixed_code for r in fixes.apply_fixes(df).collect()}
    for i, (_, code, want) in enumerate(CASES):
        assert got[i] == want, code


def test_fixed_texts_have_nothing_left_to_fix(spark):
    """Properties over many texts: no faulty pattern stays, needed imports stand in front, other languages keep their lines."""
    rows = [(i, lang, code) for i, (lang, code) in enumerate(
        (lang, code) for lang in ("python", "javascript", "java", "c") for code in texts(400, 40 + len(lang)))]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, code string")
    got = {r.doc_id: r.fixed_code for r in fixes.apply_fixes(df).collect()}
    gone = {"python": r"==[ \t]*None|except[ \t]*:|hashlib\.(?:md5|sha1)\(|os\.system\(|password = ['\"].+['\"]",
            "javascript": r"\bvar[ \t]|\.innerHTML[ \t]*=", "java": r"\.length\(\) == 0"}
    for i, lang, code in rows:
        if lang in gone:
            assert not re.search(gone[lang], got[i]), (lang, code)
        if lang == "python":
            for use, line in (("os.environ", "import os"), ("subprocess.run", "import subprocess"), ("hashlib", "import hashlib")):
                assert use not in got[i] or line in got[i]
        else:
            assert len(got[i].split("\n")) == max(1, len(code.splitlines()))
        if lang == "c":
            assert got[i] == "\n".join(code.splitlines())


def test_body_after_a_one_line_header_is_lost(spark):
    df = spark.createDataFrame([(1, "python", "def f(a=[], b={}): return 1")], "doc_id bigint, lang string, code string")
    assert fixes.apply_fixes(df).first().fixed_code == (
        "def f(a=None, b=None):\n    if a is None: a = []\n    if b is None: b = {}")


def test_summary_counts_documents_and_lines(spark):
    df = spark.createDataFrame([
        (1, "python", "a == None\nb == None\nhashlib.md5(x)"), (2, "python", "a == None"),
        (3, "javascript", "var a\nvar b"), (4, "python", "def f(x=[]):\n    pass")],
        "doc_id bigint, lang string, code string")
    got = {(r.lang, r.fix): (r.docs, r.lines) for r in fixes.fix_summary(df).collect()}
    assert got == {("python", "none_eq"): (2, 3), ("python", "md5"): (1, 1), ("python", "imports"): (1, 1),
                   ("javascript", "var"): (1, 2), ("python", "mutable_default"): (1, 1)}

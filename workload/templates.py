"""Snippet templates laid over the events table; one list feeds both engines."""

from __future__ import annotations

# (language, has_bug, bug_type, body, corrected body, description); {k} is replaced per event.
TEMPLATES: list[tuple[str, int, str, str, str, str]] = [
    ("python", 1, "bare_except", "try:\n    run_{k}()\nexcept:\n    pass",
     "try:\n    run_{k}()\nexcept OSError as err:\n    report(err)", "handler without a type"),
    ("python", 0, "none", "def scale_{k}(v):\n    return v * {k}", "", "clean scaling"),
    ("python", 1, "none_comparison", "if total == None or total != None:\n    print(total)",
     "if total is None:\n    pass", "None compared by value"),
    ("python", 1, "weak_hash", "import hashlib\nprint(hashlib.md5(b'{k}').hexdigest())",
     "import hashlib\nprint(hashlib.sha256(b'{k}').hexdigest())", "weak digest"),
    ("python", 1, "hardcoded_secret", "Password = 'p{k}'\npassword = 'q{k}'\napi_key = \"r{k}\"",
     "import os\npassword = os.environ['PW']", "secrets in code"),
    ("python", 1, "open_file", "fh = open('f{k}.txt')\nwith open('g{k}.txt') as gh:\n    rows = gh.read()",
     "with open('f{k}.txt') as fh:\n    rows = fh.read()", "file left open"),
    ("python", 1, "mutable_default",
     "class Box:\n    def put(item, seen=[], meta={}):\n        seen.append(item)\n        return seen\n",
     "class Box:\n    def put(self, item, seen=None):\n        return seen\n", "mutable defaults"),
    ("python", 1, "recursion", "def count_down(n):\n    return count_down(n - 1)",
     "def count_down(n):\n    return 0 if n == 0 else count_down(n - 1)", "no base case"),
    ("python", 1, "zero_division", "ok = (total ==\n      None)\nratio = {k} / 0", "ratio = 0", "division by zero"),
    ("java", 1, "string_compare",
     "if (name == \"v{k}\") {\n    System.out.println(name.length() == 0);\n}",
     "if (name.equals(\"v{k}\")) {\n    log.info(name);\n}", "strings by reference"),
    ("java", 0, "none", "int v{k} = Math.max(a, b);", "", "clean maximum"),
    ("javascript", 1, "inner_html", "var box = find({k});\nbox.innerHTML = text; console.log(box);",
     "const box = find({k});\nbox.textContent = text;", "markup from data"),
    ("javascript", 0, "none", "const id{k} = make({k});", "", "clean constant"),
    ("c", 1, "unchecked_malloc",
     "char *p = malloc({k});\nif (p == NULL) return 1;\nfree(p);\nfree(q); q = NULL;",
     "char *p = malloc({k});\nif (!p) return 1;\nfree(p);\np = NULL;", "allocation"),
    ("c", 1, "buffer", "int main() {\n    gets(buf); strcpy(dst, buf);\n    while (1) { printf(buf); }\n}",
     "int main(void) {\n    fgets(buf, sizeof buf, stdin);\n}", "unbounded input"),
    ("python", 0, "none", "   \n\t", "", "blank"),
    ("python", 1, "eval_use", "value_{k} = eval(text)\nexec(value_{k})\nglobal shared_{k}",
     "import ast\nvalue_{k} = ast.literal_eval(text)", "dynamic code"),
    ("python", 1, "star_import", "from tools_{k} import *\nimport *\nwait = time.sleep(1)",
     "from tools_{k} import wait", "star import"),
    ("python", 1, "pickle_load", "data = pickle.loads(raw)\nmore = pickle.load(fh_{k})",
     "data = json.loads(raw)", "unpickling"),
    ("python", 1, "shell_true", "subprocess.run(cmd_{k}, shell = True)\nos.system('ls {k}')\n",
     "subprocess.run(['ls', '{k}'])", "shell command"),
    ("python", 1, "weak_random", "token = random.randint(0, {k})\nnext_token = random.random()",
     "token = secrets.randbelow({k})", "predictable numbers"),
    ("python", 1, "type_compare", "if type(x) == int:\n    assert x > {k}\nfor i in range(len(xs)):\n    use(xs[i])",
     "if isinstance(x, int):\n    use(x)", "type comparison"),
    ("python", 0, "none",
     "def walk_{k}(node, depth):\n    if node is None:\n        return depth\n    return walk_{k}(node.next, depth + 1)\n",
     "", "clean recursion"),
    ("python", 1, "missing_return", "def square_{k}(x):\n    x * x\n", "def square_{k}(x):\n    return x * x\n",
     "result is lost"),
    ("python", 1, "mutable_default", "def f_{k}(a=[], b={}): return 1\n\ndef g(c, *, d=[]):\n    return 'x / 0'  # 1 / 0",
     "def f_{k}(a=None, b=None):\n    return 1", "mutable defaults in one line"),
    ("python", 1, "zero_division", "a = 1 / 0 / 0.0\nb = 1 // 0\nc = 1 / 0.5\nd = {k} % 0",
     "a = 0", "several divisions"),
    ("python", 1, "recursion",
     "class Tree:\n    def size(self):\n        def inner(n):\n            return inner(n)\n        return inner(1)\n"
     "    def depth(self, d):\n        return self.depth(d)\n\ndef loop(\n    n,\n):\n    while n:\n        loop(n)\n",
     "class Tree:\n    pass", "nested recursion"),
    ("python", 1, "sql_concat", "q = \"SELECT * FROM t WHERE id = \" + uid_{k}\nif ratio == 0.3:\n    run(q)",
     "q = \"SELECT * FROM t WHERE id = ?\"", "statement glued together"),
    ("java", 1, "generic_catch", "try {\n    go_{k}();\n} catch (Exception e) {\n    Thread.sleep(5);\n}",
     "try {\n    go_{k}();\n} catch (IOException e) {\n    log.warn(e);\n}", "catch all"),
    ("java", 1, "null_compare",
     "static List<String> names;\nif (names == null || null == other) {\n    int n = Integer.parseInt(text);\n    result += n;\n}",
     "private final List<String> names;", "null test"),
    ("javascript", 1, "eval_use", "eval(input_{k});\ndocument.write(x);\nsetTimeout('go()', {k});",
     "go();", "dynamic script"),
    ("javascript", 1, "storage",
     "localStorage.setItem('k{k}', v);\ndelete items[{k}];\nvar o = JSON.parse(raw); if (o == 1) {}",
     "const o = parse(raw);", "stored data"),
    ("c", 1, "string_copy",
     "strcat(dst, src);\nsprintf(out, src);\nscanf(\"%s\", name);\nif (strcmp(a, b) == 0 && NULL == p) {}\nsystem(cmd);",
     "strncat(dst, src, {k});", "unbounded copies"),
    ("c", 1, "buffer", "char line[{k}]; p = gets(line);\nfor (;;) { step(); }\nchar *q = malloc(n);\nuse(q);",
     "char line[{k}];\nfgets(line, {k}, stdin);", "unbounded buffer"),
    ("c", 0, "none", "int add(int a, int b) {\n    return a + b + {k};\n}\n", "", "clean addition"),
    ("go", 0, "none", "func add(a int) int { return a + {k} }\n// eval(x) gets(y)", "", "unknown language"),
    ("python", 1, "hardcoded_secret", "PASSWORD_{k} = 1\npassword='a' + \"b\"\nSELECT = api_key = 'z{k}'; print('sql')",
     "password = os.environ['PW']", "secret in one line"),
    ("python", 1, "bare_except",
     "def load(path):\n    try:\n        return open(path).read()\n    except :\n        logging.error('x{k}')\n        return None\n",
     "def load(path):\n    with open(path) as fh:\n        return fh.read()\n", "handler without a type"),
    ("python", 0, "none",
     "class Shape:\n    \"\"\"A shape / 0 def bad(x=[])\n\n    def hidden(n): hidden(n)\n    \"\"\"\n"
     "    def __init__(sides, n):\n        sides.n = n\n    def area():\n        return {k}\n",
     "", "class with text"),
    ("python", 1, "none_comparison", "if a ==None and b!=  None: x = hashlib.sha1 (b)\nelse: y = c == None",
     "if a is None:\n    x = b", "None compared by value"),
    ("python", 1, "mutable_default",
     "def pick_{k}(a=min(len('x'), {k}), b=[], *, c={}):\n"
     "    def inner(d=dict(e=[1]), f=([]), g=[n for n in a], h={1: [2]}, i=[] or b):\n        return d\n    return inner\n",
     "def pick_{k}(a=1, b=None):\n    return a", "defaults in nested brackets"),
    ("python", 1, "recursion",
     "def walk(x):\n    return [walk(y)\n            for y in x\n            if y]\n\ndef call(x):\n    return (call\n            (x - {k}))\n\n"
     "def stop(x):\n    if x: return 0\n    return stop(\n        x)\n",
     "def walk(x):\n    return x", "calls over several lines"),
    ("python", 1, "zero_division",
     "a = 1 / 0x0 + {k} / 0j + b / (0.0)\nc = b / 0 ** 2 + b / (0 + 1)\nd = (b /\n     0) ** 2 # b / 0\n(e, f) = d\n",
     "a = b", "spellings of zero"),
]


def rows() -> list[tuple]:
    """TEMPLATES with their position as tid."""
    return [(tid, *t) for tid, t in enumerate(TEMPLATES)]

from churnlens.operators import symbols as sym
from test_plans import plan

PHP = """<?php
function helper($a) {
    return strlen($a) + inner($a);
}
class K {
    public function run() { return $this->go(1); }
}
function inner($x) { return $x; }
"""
PY = """def top(a):
    return helper(a)

def helper(b):
    if b:
        return len(b)
    return 0
"""


def test_find_definitions():
    defs = sym.find_definitions(PHP, "php")
    assert [(d["name"], d["is_method"]) for d in defs] == [("helper", False), ("run", True), ("inner", False)]
    assert defs[0]["text"].endswith("}") and "inner($a)" in defs[0]["text"]
    py = sym.find_definitions(PY, "python")
    assert [d["name"] for d in py] == ["top", "helper"] and py[1]["text"].rstrip().endswith("return 0")


def test_tables_resolution_and_context(spark):
    files = spark.createDataFrame([("r", "v", "src/a.php", PHP), ("r", "v", "lib/b.py", PY),
                                   ("r", "v", "vendor/c.php", "<?php\nfunction inner($y) { return 1; }\n")],
                                  "repo string, version string, path string, content string")
    defs = sym.definitions(files)
    sigs = {(r.path, r.name): (r.signature, r.body) for r in defs.collect()}
    assert sigs[("src/a.php", "inner")] == ("function inner($x)", " return $x;")
    assert sigs[("lib/b.py", "top")][0] == "def top(a):"
    calls = {(r.caller, r.callee) for r in sym.calls(defs).collect()}
    assert ("helper", "strlen") in calls and ("helper", "inner") in calls and ("run", "go") in calls
    user = {(r.caller, r.callee) for r in sym.drop_builtins(sym.calls(defs)).collect()}
    assert ("helper", "strlen") not in user and ("top", "helper") in user and ("helper", "len") not in user
    res = {(r.caller, r.callee): r.def_path for r in sym.resolve_calls(sym.calls(defs), defs).collect()}
    assert res[("helper", "inner")] == "src/a.php"          # vendor/ is excluded from the index
    diff = spark.createDataFrame([("r", "v", "src/a.php", "+    return strlen($a) + inner($a);"),
                                  ("r", "v", "src/a.php", " function HELPER($a) {")],
                                 "repo string, version string, path string, line string")
    changed = {r.name for r in sym.changed_functions(diff, defs).collect()}
    assert changed == {"helper", "inner"}
    ctx = sym.function_context(diff, defs).collect()[0]
    assert ctx.n_functions == 1 and "[Function: inner]" in ctx.context and ctx.context.startswith("\n=== Function Context")


def test_resolve_in_tree(spark):
    files = spark.createDataFrame([("r", "v", "a/x.php", "<?php\nfunction f() { return g(1); }\n"),
                                   ("r", "v", "a/b/g.php", "<?php\nfunction g($a) { return $a; }\n"),
                                   ("r", "v", "c/g.php", "<?php\nfunction g($a) { return 2; }\n"),
                                   ("r", "v", "c/y.php", "<?php\nfunction h() { return k(1); }\n"),
                                   ("r", "v", "k.php", "<?php\nfunction k($a) { return 3; }\n")],
                                  "repo string, version string, path string, content string")
    defs = sym.definitions(files)
    calls = sym.drop_builtins(sym.calls(defs))
    got = {(r.caller, r.callee): r.def_path for r in sym.resolve_in_tree(calls, defs).collect()}
    assert got == {("f", "g"): "a/b/g.php"}                       # c/g.php is outside a/; k.php is above c/
    anywhere = {(r.caller, r.callee): r.def_path for r in sym.resolve_calls(calls, defs).collect()}
    assert anywhere[("f", "g")] == "a/b/g.php" and anywhere[("h", "k")] == "k.php"


def test_first_definition_walk_order(spark):
    files = spark.createDataFrame([("r", "v", "a/b.php", "<?php\nfunction g() { return 1; }\n"),
                                   ("r", "v", "a/b/x.php", "<?php\nfunction g() { return 2; }\n"),
                                   ("r", "v", "a/z.phtml", "<?php\nfunction g() { return 3; }\n")],
                                  "repo string, version string, path string, content string")
    first = sym.first_definitions(sym.definitions(files)).collect()
    assert [(r.name, r.def_path) for r in first] == [("g", "a/b/x.php")]    # '.php' ranks before '.phtml'


DEFINITIONS = [
    ("python", "def f(\n    a,\n    b={'x': 1},\n):\n    s = '}'\n    return a\n\nx = 1\n", {"f": "    return a"}),
    ("php", "<?php\nfunction f($a) {\n  $s = '}'; // }\n  return g($a);\n}\nfunction g($x) { return $x; }\n", {"f": "return g($a);\n}", "g": "return $x; }"}),
    ("c", 'int f(int a)\n{\n  puts("}");\n  return a; /* } */\n}\nint g(void) { return 1; }\n', {"f": "/* } */\n}", "g": "return 1; }"}),
    ("cpp", 'int K::f(int a) const {\n  char c = \'}\';\n  return a;\n}\n', {"K::f": "return a;\n}"}),
    ("csharp", "class K {\n  public int Twice(int a) => Compute(a);\n  public int F(int a)\n  {\n    return a;\n  }\n}\n", {"Twice": "Compute(a);", "F": "return a;\n  }"}),
    ("go", "func f(x interface{}, y map[string]struct{}) (map[string]interface{}, error) {\n\treturn run(x)\n}\n", {"f": "return run(x)\n}"}),
    ("java", 'class K {\n  public int f(int a) throws E {\n    String s = "}";\n    return a;\n  }\n}\n', {"f": "return a;\n  }"}),
    ("javascript", "function f({a, b}, c) {\n  return `}` + a;\n}\n", {"f": "+ a;\n}"}),
    ("typescript", "function f(o: { a: string }): { b: string } {\n  return g(o);\n}\n", {"f": "return g(o);\n}"}),
    ("ruby", "def f(a)\n  s = 'end'\n  go(a)\nend\n\ndef g\n  1\nend\n", {"f": "go(a)\nend", "g": "  1\nend"}),
    ("rust", "fn h(k: [u8; 32]) -> [u8; 4] {\n    let c = '}';\n    run(k)\n}\n", {"h": "run(k)\n}"}),
]


def test_definitions_end_where_they_end():
    for lang, text, expected in DEFINITIONS:
        got = {d["name"]: d["text"] for d in sym.find_definitions(text, lang)}
        assert set(got) == set(expected), (lang, got)
        for name, end in expected.items():
            assert got[name].rstrip().endswith(end), (lang, name, got[name])
    assert sym.find_definitions("int f(int a);\n", "c") == []  # a declaration


CALLS = [
    ("csharp", 'Compute(x); svc.Load(y); if (z) { new Foo(1); } // Skip(1)\nLog("Not(1)");', ["Compute", "Load", "Log"]),
    ("go", "DoThing(x)\npkg.Run(y)\nfor (a) {}\n", ["DoThing", "Run"]),
    ("php", "doThing($x); $this->go(1); K::make(2); $f(3); new Foo(4); while (isset($a)) {}", ["doThing", "go", "make", "isset"]),
    ("c", "Compute(a); p->call(b); s.run(c); return (d);", ["Compute"]),
    ("cpp", "obj.runAll(); DoIt(); p->Go(); std::sort(a);", ["runAll", "DoIt", "Go"]),
    ("ruby", "doThing(1)\nobj.meth(2)\nFoo.bar(3)\n", ["doThing", "obj", "bar"]),
    ("python", "Foo(x)\nobj.doIt(y)\nif (z):\n    return (w)\n# no(1)\n", ["Foo", "doIt"]),
    ("java", "doBar(1); this.run(2); obj.go(3); a.b.c(4); new Foo(5);", ["doBar", "run", "obj", "c"]),
    ("javascript", "doIt(1); a.b.call2(2); new Foo(3); function g(x) {}", ["doIt", "call2"]),
    ("typescript", "doIt(1); this.x.run(2);", ["doIt", "run"]),
    ("rust", "run(k); a.b(c); Foo::new(d); println!(\"x(1)\");", ["run", "b"]),
]


def test_calls_of_a_body(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(lang, text) for lang, text, _ in CALLS], "lang string, body string")
    got = {r.lang: r.names for r in rows.select("lang", sym.body_call_names(F.col("body"), F.col("lang")).alias("names")).collect()}
    for lang, _, expected in CALLS:
        assert sorted(got[lang]) == sorted(expected), (lang, got[lang])


BUILTIN_CASES = {
    "php": ("array strlen json_encode mysqli_connect exec", "myCustomFunction"),
    "javascript": ("Array log parseInt fetch setTimeout", "myCustomFunction"),
    "typescript": ("Promise Map", "myCustomFunction"),
    "python": ("len print range dict isinstance __import__", "my_custom_function"),
    "c": ("printf malloc strcpy fopen memcpy sin", "myFunction"),
    "cpp": ("cout vector push_back sort make_shared", "myFunction"),
    "csharp": ("WriteLine ToString Add Where Select", "MyCustomMethod"),
    "go": ("len make append panic close", "myFunction"),
    "java": ("println toString equals parseInt sort", "myMethod"),
    "ruby": ("puts print each map require nil?", "my_method"),
    "rust": ("println! println vec! panic! unwrap collect", "my_function"),
    "cobol": ("", "DISPLAY"),
    "": ("", "func"),
}


def test_builtins(spark):
    rows = [(lang, n, True) for lang, (names, _) in BUILTIN_CASES.items() for n in names.split()]
    rows += [(lang, n, False) for lang, (_, own) in BUILTIN_CASES.items() for n in (own, "")]
    frame = spark.createDataFrame(rows, "lang string, callee string, builtin boolean")
    left = {(r.lang, r.callee) for r in sym.drop_builtins(frame).collect()}
    assert left == {(lang, n) for lang, n, builtin in rows if not builtin}


def test_resolve_in_tree_against_every_definition(spark):
    import random
    rnd = random.Random(9)
    folders = ["", "a/", "a/b/", "a/b/c/", "a/bb/", "d/", "vendor/"]
    path = lambda: rnd.choice(folders) + f"f{rnd.randint(0, 9)}" + rnd.choice([".php", ".phtml"])
    defs = {("r", "v", path(), "php", f"fn{rnd.randint(0, 5)}", False, rnd.randint(0, 2)) for _ in range(120)}
    rows = [(*d, f"sig {k}", f"body {k}", "t") for k, d in enumerate(sorted(defs))]
    table = spark.createDataFrame(rows, "repo string, version string, path string, lang string, name string, is_method boolean, seq int, signature string, body string, text string")
    calls = {("r", "v", path(), "php", f"c{rnd.randint(0, 3)}", f"fn{rnd.randint(0, 6)}") for _ in range(80)}
    frame = spark.createDataFrame(sorted(calls), "repo string, version string, path string, lang string, caller string, callee string")
    want = {}
    for c in calls:
        tree = c[2].rpartition("/")[0] + "/" if "/" in c[2] else ""
        found = [r for r in rows if r[4] == c[5] and r[2].startswith(tree) and not r[2].startswith("vendor/")]
        if found:
            best = min(found, key=lambda r: (r[2].endswith(".phtml"), r[2].split("/"), -r[6]))
            want[c] = (best[2], best[8])
    got = sym.resolve_in_tree(frame, table).collect()
    assert len(got) == len(want) and {tuple(r)[:6]: (r.def_path, r.body) for r in got} == want
    index = sym.folder_index(table)
    assert index.groupBy("repo", "version", "lang", "name", "tree").count().where("count > 1").isEmpty()


def test_a_call_whose_bracket_is_on_the_next_line(spark):
    files = spark.createDataFrame([("r", "v", "a.php", "<?php\nfunction g($a) { return $a; }\n")], "repo string, version string, path string, content string")
    defs = sym.definitions(files)
    lines = ["@@ -1,2 +1,2 @@", "-x", " $y = g", " (1);"]
    diff = spark.createDataFrame([("r", "v", "b.php", x) for x in lines], "repo string, version string, path string, line string")
    text = spark.createDataFrame([("r", "v", "b.php", "\n".join(lines))], "repo string, version string, path string, text string")
    assert {r.callee for r in sym.context_calls(diff, defs, text).collect()} == {"g"}
    assert sym.context_calls(diff, defs).collect() == []


def _files(spark, rows):
    return spark.createDataFrame([(r, "v", p, c) for r, p, c in rows], "repo string, version string, path string, content string")


def test_brackets_are_read_as_in_one_pass():
    for code in ("f(a[1], (b)) { x(); }", "{ a { b { c } } }", "( [ ) ]", "{ ( }", "f() {", "a { (b) [c] {d} } }"):
        closes, pairs = sym.closing_place(code), sym.bracket_pairs(code)
        for at in [i for i, ch in enumerate(code) if ch in "([{"]:
            assert closes(at, -1) == pairs.get(at, -1), (code, at)


def test_patterns_of_all_languages_stay_out_of_one_generated_method(spark):
    defs = sym.definitions(_files(spark, [("p", "src/a.php", "function f() { return g($x); }")]))
    assert "lambda" in plan(sym.calls(defs))


def test_only_called_names_are_looked_up(spark):
    defs = sym.materialized_definitions(_files(spark, [("p", "src/a.php", "function f() { return g($x); }"), ("p", "src/b.php", "function g() { return 1; }"),
                                                       ("p", "src/c.php", "function h() { return 2; }")]))
    assert "callees" in defs.columns
    calls = sym.calls(defs)
    assert {r.name for r in sym.first_definitions(defs, sym.called_names(calls)).collect()} == {"g"}
    assert [(r.caller, r.def_path) for r in sym.resolve_calls(calls, defs).collect()] == [("f", "src/b.php")]
    assert "LeftSemi" in plan(sym.resolve_calls(calls, defs))


def test_a_file_listed_twice_is_resolved_once_in_its_tree(spark):
    files = _files(spark, [("p", "src/a.php", "function f() { return g($x); }"), ("p", "src/b.php", "function g() { return 1; }")] * 2)
    defs = sym.materialized_definitions(files)
    got = sym.resolve_in_tree(sym.calls(defs), defs).collect()
    assert [(r.caller, r.callee, r.def_path, r.body) for r in got] == [("f", "g", "src/b.php", " return 1;")]

"""Sources, bundles, streams and the façade."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom import facade
from codeloom.operators.graph import load
from codeloom.sources import bundle, discovery, python_code, resolution, scanners
from codeloom.streaming import maintenance

SOURCE = '''import os.path as p
from util.text import clean
LIMIT: int = 3

@app.route("/x")
def page(a, *rest, b=1, **more):
    """Shows."""
    if a and b and rest:
        return [clean(x) for x in a if x]
    return Box(a).open()

class Box(Base):
    def open(self):
        return self.close(1)

    def close(self, n): pass

twice = lambda n: n * 2
'''


def test_python_elements():
    rows = python_code.parse_text("/r/app.py", SOURCE)
    by = {(r["kind"], r["name"]): r for r in rows}
    page = by["function", "page"]
    assert page["args"] == ["a", "rest", "b", "more"] and page["decorators"] == ["@app.route('/x')"] and page["docstring"] == "Shows."
    assert page["complexity"] == 1 + 1 + 2 + 1
    assert by["class", "Box"]["bases"] == ["Base"] and by["function", "open"]["class_context"] == "Box"
    assert by["call", "close"]["full_name"] == "self.close" and by["function", "twice"]["args"] == ["n"]
    assert by["import", "os.path"]["alias"] == "p" and by["import", "clean"]["full_name"] == "util.text.clean"
    assert by["variable", "LIMIT"]["value"] == "3"


def test_broken_and_empty_sources():
    assert [r["kind"] for r in python_code.parse_text("x.py", "def (")] == ["error"]
    assert python_code.parse_text("x.py", None) == []
    cell = '{"cells": [{"cell_type": "code", "source": ["%time\\n", "def f(): pass"]}, {"cell_type": "markdown", "source": "x"}]}'
    assert [r["name"] for r in python_code.parse_text("x.ipynb", cell)] == ["f"]


def test_call_resolution(spark):
    files = [
        ("/repo/main.py", "from parser import parse\nimport helper\nclass A:\n    def run(self):\n        self.go()\n        print(1)\n        local()\n        parse()\n        twice()\n        nowhere()\n    def go(self): pass\ndef local(): pass\n"),
        ("/repo/parser.py", "def parse(): pass\n"),
        ("/repo/helper.py", "def twice(): pass\n"),
        ("/repo/other.py", "def twice(): pass\n"),
    ]
    elements = python_code.parse(spark.createDataFrame(files, "path string, text string"))
    found = {r.name: (r.target, r.how) for r in resolution.resolve_calls(elements, python_code.symbol_index(elements)).collect()}
    assert "print" not in found
    assert found["go"] == ("/repo/main.py", "self") and found["local"] == ("/repo/main.py", "local")
    assert found["parse"] == ("/repo/parser.py", "unique") and found["twice"] == ("/repo/helper.py", "named")
    assert found["nowhere"] == ("/repo/main.py", "unresolved")
    left = resolution.resolve_calls(elements, python_code.symbol_index(elements), skip_external=True)
    assert "nowhere" not in {r.name for r in left.collect()}


def test_base_classes(spark):
    files = [("/r/a.py", "from b import Base\nclass C(Base): pass\nclass D(C, object): pass\n"), ("/r/b.py", "class Base: pass\n")]
    elements = python_code.parse(spark.createDataFrame(files, "path string, text string"))
    found = resolution.resolve_bases(elements, python_code.symbol_index(elements)).collect()
    assert {(r.child, r.parent, r.target) for r in found} == {("C", "Base", "/r/b.py"), ("D", "C", "/r/a.py")}


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "sub/b.go": "package b", "sub/skip.log": "", "node_modules/c.js": "", "notes.tmp": "", "keep/d.py": "y = 1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = discovery.scan(spark, str(tmp_path), ["*.log", "keep/", "# no", "!keep/"]).collect()
    assert {(r.relative, r.language) for r in found} == {("a.py", "python"), ("sub/b.go", "go"), ("keep/d.py", "python")}


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.pyc", "a/b.pyc", True), ("/build", "build/x", True), ("/build", "a/build/x", False), ("doc/**/x", "doc/a/b/x", True), ("temp?", "temp1", True), ("temp?", "temp12", False), ("logs/", "logs/a", True), ("logs/", "logs", False)])
def test_ignore_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(discovery.ignored(F.lit(path), [pattern]).alias("x")).first().x is hit


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("go", 'import "fmt"\nfunc (s *S) Run(a int) { fmt.Println(a) }\ntype S struct {}', {("import", "fmt"), ("function", "Run"), ("class", "S"), ("call", "Println")}),
        ("rust", "use std::io;\npub fn f() { g(1); } // h()\nstruct P;", {("import", "std::io"), ("function", "f"), ("class", "P"), ("call", "g")}),
        ("java", "import a.b.C;\npublic class D extends C {\n  public int run(int x) {\n    if (x > 1) go(x);\n  }\n}", {("import", "a.b.C"), ("class", "D"), ("function", "run"), ("call", "go")}),
        ("typescript", "import {a} from './a';\nexport const f = async (x) => b(x);\ninterface I {}", {("import", "./a"), ("function", "f"), ("class", "I"), ("call", "b")}),
        ("ruby", "require 'set'\nclass A\n  def go?\n    run(1) # no()\n  end\nend", {("import", "set"), ("class", "A"), ("function", "go?"), ("call", "run")}),
        ("c", "#include <stdio.h>\nstatic int add(int a) {\n  return twice(a);\n}\nstruct S { int x; };", {("import", "stdio.h"), ("function", "add"), ("call", "twice"), ("class", "S")}),
    ],
)
def test_other_languages(language, text, want):
    assert {(k, n) for k, n, _ in scanners.scan_text(language, text)} == want


def test_every_language_has_a_reader():
    assert set(discovery.LANGUAGES.values()) - {"python"} == set(scanners.PATTERNS)


def test_bundle_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "File", "/a/x.py"), (2, "File", "/a/y.py"), (3, "File", "/b/z.py")], "id long, label string, path string")
    edges = spark.createDataFrame([(1, 2, "CALLS"), (3, 1, "CALLS"), (3, 3, "CALLS")], "src long, dst long, type string")
    bundle.export_frames(nodes, edges, str(tmp_path / "out"), "/a/")
    bundle.archive(str(tmp_path / "out"), str(tmp_path / "x.zip"), {"name": "x"})
    bundle.unpack(str(tmp_path / "x.zip"), str(tmp_path / "in"))
    known = spark.createDataFrame([(10, "/a/x.py")], "id long, path string")
    n, e = bundle.import_frames(spark, str(tmp_path / "in/nodes.jsonl"), str(tmp_path / "in/edges.jsonl"), known)
    assert {(r.id, r.path) for r in n.collect()} == {(10, "/a/x.py"), (13, "/a/y.py")}
    assert {(r.src, r.dst) for r in e.collect()} == {(10, 13)}
    left, kept = bundle.deleted(nodes, edges, "/a")
    assert [r.id for r in left.collect()] == [3] and [(r.src, r.dst) for r in kept.collect()] == [(3, 3)]


def test_unsafe_archives_are_refused(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError, match="unsafe"):
        bundle.unpack(str(tmp_path / "x.zip"), str(tmp_path / "in"))


def test_debounce(spark):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("p", "modified", start + timedelta(seconds=s)) for s in (0, 1, 1.5, 5)], maintenance.EVENTS)
    fires = sorted(r.fires for r in maintenance.debounced(rows).collect())
    assert fires == [start + timedelta(seconds=3.5), start + timedelta(seconds=7)]


def test_watch_follows_a_folder(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for k, s in enumerate((0, 1, 60)):
        spark.createDataFrame([("p", "modified", start + timedelta(seconds=s))], maintenance.EVENTS).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    watchers = maintenance.Watchers(spark)
    query = watchers.watch(str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state"), lambda batch, epoch: seen.extend(batch.collect()), once=True)
    query.awaitTermination(120)
    assert [(r.path, r.events) for r in seen] == [("p", 2)]
    assert watchers.unwatch(str(tmp_path / "log")) and not watchers.unwatch("none")


def test_incremental_replacement(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, x long")
    new = spark.createDataFrame([("a", 3)], "path string, x long")
    assert {tuple(r) for r in maintenance.replaced(old, new, new).collect()} == {("a", 3), ("b", 2)}


def test_facade(spark, small):
    engine = facade.Engine(load(spark, small), spark)
    assert engine.sql("SELECT count(*) AS n FROM functions").first().n == 200
    assert engine.analyse("fuzzy", "hot bolt").count() >= 1
    assert engine.audit("brand_13").count() == 24
    with pytest.raises(ValueError, match="unknown"):
        engine.analyse("nonsense", "x")


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; DELETE FROM x", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_only_reading_statements(sql):
    with pytest.raises(ValueError, match="read"):
        facade.read_only(sql)


def test_quoted_words_are_no_commands():
    assert facade.read_only("SELECT 'drop it', replace(a, 'x', 'y') FROM t;") == "SELECT 'drop it', replace(a, 'x', 'y') FROM t"


def test_layout_of_parsed_files(spark):
    from codeloom.sources import layout

    elements = python_code.parse(spark.createDataFrame([("/r/app.py", SOURCE)], "path string, text string"))
    assert {(r.outer, r.name) for r in layout.contained(elements).collect()} == {("Box", "open"), ("Box", "close")}
    assert {(r.name, r.arg) for r in layout.parameters_of(elements).filter("name in ('close', 'twice')").collect()} == {("close", "self"), ("close", "n"), ("twice", "n")}
    assert {(r.module, r.alias) for r in layout.import_edges(elements).collect()} == {("os.path", "p"), ("util.text.clean", None)}
    resolved = resolution.resolve_calls(elements, python_code.symbol_index(elements))
    assert ("close", 16) in {(r.name, r.defined_at) for r in layout.call_edges(resolved, elements).collect()}
    chain = layout.directory_chain(spark.createDataFrame([("/r/a/x.py",), ("/r/a/y.py",)], "path string"))
    assert {tuple(r) for r in chain.collect()} == {("/r", "/r/a", "directory"), ("/r/a", "/r/a/x.py", "file"), ("/r/a", "/r/a/y.py", "file")}


def test_embedding_skips_what_is_there(spark):
    from codeloom.operators import hybrid

    rows = spark.createDataFrame([(1, "a b", [1.0]), (2, "a b", None), (3, " ", None)], "id long, name string, embedding array<double>")
    found = {r.id: r.embedding for r in hybrid.embedded(rows, F.col("name")).collect()}
    assert found[1] == [1.0] and len(found[2]) == hybrid.SIZE and found[3] is None


def test_latest_bundle_of_each_name(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", "u1"), ("a", "2024-02-01", "u2"), ("b", "2023-01-01", "u3")], "name string, generated_at string, url string")
    assert [r.url for r in bundle.latest_bundles(rows).collect()] == ["u2", "u3"]


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "path string, n long")
    new = spark.createDataFrame([("y", 5), ("z", 6)], "path string, n long")
    assert {tuple(r) for r in bundle.merged(old, new, "path").collect()} == {("x", 1), ("y", 5), ("z", 6)}


def test_main_language(spark):
    rows = spark.createDataFrame([("a.py",), ("b.py",), ("c.go",), ("d.zip",)], "path string")
    assert tuple(discovery.main_language(rows).first()) == ("python", 2)


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def nested(number, data):
    data = data.encode() if isinstance(data, str) else data
    return varint(number << 3 | 2) + varint(len(data)) + data


def occurrence(line, symbol, roles=0):
    return nested(2, nested(1, varint(line) + varint(4) + varint(9)) + nested(2, symbol) + (varint(3 << 3) + varint(roles) if roles else b""))


def test_symbol_indexes(spark):
    from codeloom.sources import scip

    info = nested(3, nested(1, "py . . a/f().") + nested(3, "Says f.") + varint(5 << 3) + varint(17) + nested(6, "f"))
    a = nested(1, "a.py") + nested(4, "python") + occurrence(0, "py . . a/f().", 1) + occurrence(300, "py . . b/C#g()."), info
    b = nested(1, "b.py") + occurrence(2, "py . . b/C#", 1) + occurrence(3, "py . . b/C#g().", 1) + occurrence(3, "local 4", 1) + occurrence(9, "py . . a/f().") + occurrence(9, "py . . ext/h().")
    index = nested(1, b"\x08\x01") + nested(2, b"".join(a)) + nested(2, b)
    found = scip.occurrences(spark.createDataFrame([(bytearray(index),)], "content binary"))
    assert {(r.path, r.symbol, r.line, r.definition) for r in found.collect()} == {
        ("a.py", "py . . a/f().", 1, True), ("a.py", "py . . b/C#g().", 301, False), ("b.py", "py . . b/C#", 3, True), ("b.py", "py . . b/C#g().", 4, True), ("b.py", "py . . a/f().", 10, False), ("b.py", "py . . ext/h().", 10, False),
    }
    assert {(r.name, r.label, r.path, r.line, r.documentation) for r in scip.definitions(found).collect()} == {("f", "Function", "a.py", 1, "Says f."), ("C", "Class", "b.py", 3, None), ("g", "Function", "b.py", 4, None)}
    assert {(r.caller, r.callee_name, r.callee_path, r.line) for r in scip.call_edges(found).collect()} == {("py . . a/f().", "g", "b.py", 301), ("py . . b/C#g().", "f", "a.py", 10)}
    elements = python_code.parse(spark.createDataFrame([("a.py", "def f(x):\n    if x: pass\n")], "path string, text string"))
    more = {r.name: (r.complexity, r.args) for r in scip.supplemented(scip.definitions(found), elements).collect()}
    assert more == {"f": (2, ["x"]), "C": (1, None), "g": (1, None)}


def test_changes_of_a_repository(spark, tmp_path):
    import subprocess

    from codeloom.sources import changes

    def run(*arguments):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *arguments], check=True, capture_output=True)

    run("init")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-m", "one")
    assert changes.first_changes(spark, str(tmp_path), locked=["b.py"])[0] == "locked"
    (tmp_path / "new.py").write_text("y\n")
    kind, files = changes.first_changes(spark, str(tmp_path))
    assert kind == "untracked" and [r.path for r in files.collect()] == ["new.py"]
    (tmp_path / "a.py").write_text("x = 2\n")
    kind, files = changes.first_changes(spark, str(tmp_path))
    assert kind == "diff" and [r.path for r in files.collect()] == ["a.py"]
    run("commit", "-am", "two")
    (tmp_path / "@types").mkdir()
    (tmp_path / "@types" / "x.py").write_text("")
    run("add", ".")
    run("commit", "-m", "three")
    run("commit", "--allow-empty", "-m", "four")
    (tmp_path / "log").write_text(changes.log_text(str(tmp_path)))
    rows = changes.commits(changes.read_log(spark, str(tmp_path / "log")))
    assert {(r.path, r.commits) for r in changes.churn(rows).collect()} == {("a.py", 2), ("new.py", 1), ("@types/x.py", 1)}
    assert changes.changed_files(spark, str(tmp_path / "nowhere"), "diff").isEmpty()
    indexed = spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "z")], "path string, text string")
    hashed = indexed.selectExpr("path", "sha1(text) AS sha1")
    assert [r.path for r in changes.stale(hashed, spark.createDataFrame([("a.py", "x = 2\n"), ("b.py", "z")], "path string, text string")).collect()] == ["a.py"]


def test_complexity_counts_branches_once():
    import ast

    def of(text):
        return python_code.complexity(ast.parse(text).body[0])

    assert of("def f(a):\n  if a: pass\n  elif a > 1: pass\n  else: pass\n") == 2
    assert of("def f(a):\n  if a: pass\n  else:\n    if a > 1: pass\n") == 3
    assert of("def f(a):\n  return a if a and a or a else [x for y in a for x in y]\n") == 4
    assert of("def f(a):\n  assert a\n  return {x for x in a}, {x: 1 for x in a}, (x for x in a)\n") == 2
    assert of("async def f(a):\n  async for x in a:\n    async with x: pass\n  while a:\n    try: pass\n    except E: pass\n") == 5


def test_files_that_shape_a_project(spark):
    names = ["a.py", "schema.sql", "x.proto", "Dockerfile", "Dockerfile.dev", "requirements-test.txt", "package.json", "tsconfig.base.json", "notes.md", "data.json", "config.yaml", "LICENSE", "Makefile", "app.toml", "README.md"]
    kept = spark.createDataFrame([(f"/r/{x}",) for x in names], "path string").filter(discovery.code_or_structural(F.col("path")))
    assert {r.path[3:] for r in kept.collect()} == {"a.py", "schema.sql", "x.proto", "Dockerfile", "Dockerfile.dev", "requirements-test.txt", "package.json", "tsconfig.base.json", "Makefile"}


def test_call_resolution_by_type_full_name_and_language(spark):
    rows = [
        ("/r/a.py", "call", "run", "job.run", "Worker", None), ("/r/a.py", "call", "print", "log.print", None, None), ("/r/a.py", "import", "pick", "lib.pick", None, None), ("/r/a.py", "call", "pick", "pick", None, None),
    ]
    elements = spark.createDataFrame([(p, k, n, f, t, c, 1, None) for p, k, n, f, t, c in rows], "path string, kind string, name string, full_name string, receiver_type string, context string, line_number long, alias string")
    symbols = spark.createDataFrame([("Worker", ["/r/w.py", "/r/x.py"], "python"), ("Worker", ["/r/a.rb"], "ruby"), ("pick", ["/r/p.py", "/r/q.py"], "python"), ("lib.pick", ["/r/q.py"], "python")], "symbol string, paths array<string>, lang string")
    found = {(r.name, r.target, r.how) for r in resolution.resolve_calls(elements, symbols).collect()}
    assert found == {("run", "/r/w.py", "type"), ("pick", "/r/q.py", "import")}
    kinds = resolution.buckets(resolution.resolve_calls(elements, symbols), elements)
    assert {(r.caller_kind, r.called_kind) for r in kinds.collect()} == {("file", "function")}
    sharp = spark.createDataFrame([("/r/a.cs", "class", "A", ["IThing", "Base"]), ("/r/a.cs", "class", "IThing", []), ("/r/a.cs", "class", "Base", []), ("/r/a.py", "class", "B", ["Base2"]), ("/r/a.py", "class", "Base2", [])], "path string, kind string, name string, bases array<string>")
    sharp = sharp.selectExpr("*", "cast(null as string) as alias", "cast(null as string) as full_name")
    others, split = resolution.split_bases(sharp, python_code.symbol_index(sharp))
    assert {(r.child, r.parent) for r in others.collect()} == {("B", "Base2")} and {(r.parent, r.implements) for r in split.collect()} == {("IThing", True), ("Base", False)}


def test_listings_of_c_and_callers_without_a_file(spark, small):
    from codeloom.operators import exports

    elements = spark.createDataFrame([("b.c", "struct", "s", 4), ("a.h", "struct", "t", 9), ("a.py", "struct", "u", 1), ("a.h", "macro", "M", 1)], "path string, kind string, name string, line_number long")
    assert [r.name for r in exports.listing(elements, "structs").collect()] == ["t", "s"]
    with pytest.raises(ValueError, match="unknown"):
        exports.listing(elements, "friends")
    g = load(spark, small)
    name = g.functions.join(g.calls.selectExpr("dst AS id"), "id").first()
    assert exports.any_callers(g, name["name"], name.path).count() > 0
    assert exports.any_callers(g, name["name"], "/nowhere.py").count() >= exports.any_callers(g, name["name"], name.path).count()
    assert exports.full_text(g.functions.selectExpr("id", "source AS text").limit(0), "hot").count() == 0


ODD = '''import os
@dec
def f(a, b="""
class Not: pass
"""):
    if a:
        return g(1,
x(2))
y = 1 + \\
z
try:
    h()
except E:
    pass
else:
    k = h(3)
class C(B):
    def m(self): return self.f()
for i in y: pass
else: f(i)
t = lambda q: q
'''


@pytest.mark.parametrize("text", [ODD, ODD.replace("\n", "\r\n"), ODD + "def (", ODD + '"""\nx', ODD.replace("x(2))", "x(2)"), "a = 1\n\x00", ""])
def test_a_file_parsed_by_statements_has_the_elements_of_the_whole(text):
    whole = python_code.parse_text("x.py", text, 1 << 30)
    for size in (1, 40, 100):
        assert python_code.parse_text("x.py", text, size) == whole
    assert len(whole) == 1 or len(whole) > 10 or not text


def test_only_the_tree_of_some_statements_is_held():
    import tracemalloc

    text = "".join(f"def f{k}(a, b):\n    if a and b:\n        return f{k}(a)\n" for k in range(20_000))
    tracemalloc.start()
    rows = sum(map(len, python_code.elements_of("x.py", text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40_000 and peak < 40_000_000


def test_resolution_parses_once(spark, small):
    for query in (resolution.resolved_calls, resolution.call_buckets):
        assert "MapIn" not in query(spark, small)._jdf.queryExecution().optimizedPlan().toString()

"""Structure of planted sources by language: declarations, scopes, arguments, bases, complexity, calls, receivers."""

import pytest

from codeloom.sources import resolution, structure
from codeloom.sources.python_code import symbol_index

SOURCES = {
('/a/A.java','java'):'''package x;
import y.B;
// class Not {}
public class A extends Base implements Run, java.io.Closeable {
  private WorkService workService;
  public A(int n, Map<String, Integer> m) { this.n = n; }
  abstract int area(double r);
  @Override
  public String go(final String s, int... xs) throws IOException {
    if (s == null || xs.length > 3) { return "}{"; }
    for (int i = 0; i < 3; i++) { workService.doWork(i); helper(); }
    return new Foo(1).run();
  }
  class Inner { void f() { while (true) {} } }
}
''',
('/a/a.js','javascript'):'''function add(a, b = 2) {
  if (a && b) return a + b;
  return `x ${a}`;
}
class Dog extends Animal {
  constructor(name) { super(name); this.name = name; }
  bark() { return add(1, 2) ? 1 : 2; }
}
const twice = (x) => { return add(x, x); };
const inc = y => y + 1;
const f = async function (q) { await go(q); }
''',
('/a/a.go','go'):'''package main
type Cat struct { name string }
func (c *Cat) Meow(n int, s string) string {
	if n > 1 && n < 3 { return c.name }
	fmt.Println(n)
	return ""
}
func main() { c := Cat{}; c.Meow(1, "x") }
''',
('/a/a.rs','rust'):'''pub struct P<'a> { x: &'a str }
fn area(r: f64, mut k: i32) -> f64 { match k { 1 => 2.0, _ => r } }
trait T { fn g(&self) -> i32; }
''',
('/a/a.kt','kotlin'):'''class Svc(val repo: Repo) : Base(), Runner {
    fun go(x: Int, y: Map<String, Int>): Int = x + 1
    fun run() {
        val w = Worker()
        when (x) { 1 -> w.doIt(); else -> repo.save() }
    }
}
fun <T> top(a: T) { println(a) }
''',
('/a/a.cpp','cpp'):'''#include <a>
class Shape : public Base, private virtual ns::Other {
 public:
  Shape(int a) : x(a) { }
  virtual double area() const override { return x ? 1 : 2; }
  int later(int z);
};
template <typename T> T max(T a, std::vector<T> b) { if (a < b) { return b; } return a; }
static void Shape::go(struct Foo *p) { run(p); }
''',
('/a/a.rb','ruby'):'''module Greet
  def hi(name, x = 1)
    puts "x" if name && x
    if x > 1 then
      yell(name)
    end
    [1].each do |k|
      say(k)
    end
  end
end
class Dog < Animal
  include Greet
  def self.make(a)
    while a do
      a = nil
    end
    new(a)
  end
end
''',
('/a/a.ex','elixir'):'''defmodule My.Mod do
  def add(a, b) do
    if a and b do
      helper(a)
    end
  end
  defp one(x), do: x
end
''',
('/a/a.hs','haskell'):'''module M where
import Data.List
data T = A | B
area :: Int -> Int
area 0 = 1
area n
  | n > 1 = go n
  | otherwise = 2
other x = if x then 1 else 2
''',
('/a/a.swift','swift'):'''class V: UIView, P {
  func go(at x: Int, y: Int = 2) -> Int { guard x > 1 else { return y }; return helper(x) }
  init(a: Int) { self.a = a }
}
''',
('/a/a.ts','typescript'):'''interface I extends J { go(): void }
class S<T> extends Q<T> implements I, K {
  private svc: Service;
  go(a: string, b?: Map<string, number>): void { this.svc.run(a); }
  arrow = (z: number): number => { return z; };
}
''',
('/a/a.php','php'):'''<?php
class A extends B implements C { # x
  public function go(int $a, $b = [1, 2]) { foreach ($b as $x) { $this->run($x); } }
}
''',
('/a/a.cs','csharp'):'''namespace X { public class Svc : Base, IRun { public int Go(string a, List<int> b) { return a ?? b; } int F(int x) => x > 1 ? 1 : 2; } }
''',
('/a/a.scala','scala'):'''class A(x: Int) extends B with C {
  def go(a: Int, b: String): Int = { if (a > 1) a else run(b) }
  def short = 1
}
''',
('/a/a.dart','dart'):'''class A extends B with M implements C {
  int go(int a, String b) { if (a > 1 && b != '') { return run(a); } return 1; }
  Future<int> later() async { await x(); }
}
''',
('/a/a.pl','perl'):'''package Foo;
sub go { my ($x) = @_; if ($x and $y) { run($x); } return 1; }
''',
('/a/a.c','c'):'''struct node { int x; };
int add(int a, struct node *b) { return a + b->x; }
void proto(int);
''',
}

#: path, kind, name, first and last line, complexity, arguments or bases, class around it.
DECLARED = """
A.java class A 4 15 - Base,Run,Closeable -
A.java function A 6 6 1 n,m A
A.java function area 7 7 1 r A
A.java function go 9 13 4 s,xs A
A.java class Inner 14 14 - - A
A.java function f 14 14 2 - Inner
a.c class node 1 1 - - -
a.c function add 2 2 2 a,b -
a.cpp class Shape 2 7 - Base,Other -
a.cpp function Shape 4 4 1 a Shape
a.cpp function area 5 5 2 - Shape
a.cpp function max 8 8 2 a,b -
a.cpp function go 9 9 1 p Shape
a.cs class Svc 1 1 - Base,IRun -
a.cs function Go 1 1 2 a,b Svc
a.cs function F 1 1 2 x Svc
a.dart class A 1 4 - B,M,C -
a.dart function go 2 2 3 a,b A
a.dart function later 3 3 1 - A
a.ex class My.Mod 1 8 - - -
a.ex function add 2 6 3 a,b My.Mod
a.ex function one 7 7 1 x My.Mod
a.go class Cat 2 2 - - -
a.go function Meow 3 7 3 n,s Cat
a.go function main 8 8 1 - -
a.hs class T 3 3 - - -
a.hs function area 4 8 3 - -
a.hs function other 9 9 2 - -
a.js function add 1 4 4 a,b -
a.js class Dog 5 8 - Animal -
a.js function constructor 6 6 1 name Dog
a.js function bark 7 7 2 - Dog
a.js function twice 9 9 1 x -
a.js function inc 10 10 2 y -
a.js function f 11 11 1 q -
a.kt class Svc 1 7 - Base,Runner -
a.kt function go 2 2 1 x,y Svc
a.kt function run 3 6 4 - Svc
a.kt function top 8 8 1 a -
a.php class A 2 4 - B,C -
a.php function go 3 3 2 $a,$b A
a.pl class Foo 1 1 - - -
a.pl function go 2 2 3 - Foo
a.rb class Greet 1 11 - - -
a.rb function hi 2 10 4 name,x Greet
a.rb class Dog 12 20 - Animal -
a.rb function make 14 19 2 a Dog
a.rs class P 1 1 - - -
a.rs function area 2 2 3 r,k -
a.rs class T 3 3 - - -
a.rs function g 3 3 1 self T
a.scala class A 1 4 - B,C -
a.scala function go 2 2 2 a,b A
a.scala function short 3 3 1 - A
a.swift class V 1 4 - UIView,P -
a.swift function go 2 2 2 x,y V
a.swift function init 3 3 1 a V
a.ts class I 1 1 - J -
a.ts class S 2 6 - Q,I,K -
a.ts function go 4 4 1 a,b S
a.ts function arrow 5 5 1 z S
"""


@pytest.fixture(scope="module")
def planted(spark):
    files = spark.createDataFrame([(path, language, text) for (path, language), text in SOURCES.items()] + [("/a/none", "java", None), ("/a/empty", "c", ""), ("/a/other", "cobol", "x")], "path string, language string, text string")
    return files, structure.structure(files)


def test_declarations_of_all_languages(planted):
    found = []
    for r in planted[1].declarations.orderBy("path", "pos").collect():
        names = ",".join(r.args if r.kind == "function" else r.bases)
        found.append(" ".join(str(x) for x in (r.path.removeprefix("/a/"), r.kind, r.name, r.line_number, r.end_line, r.complexity or "-", names or "-", r.class_context or "-")))
    assert found == DECLARED.strip().split("\n")


def test_calls_are_in_the_function_around_them(planted):
    found = {(r.path.removeprefix("/a/"), r.full_name, r.line_number, r.context) for r in planted[1].calls.collect()}
    assert {("A.java", "workService.doWork", 11, "go"), ("A.java", "Foo", 12, "go"), ("a.go", "c.Meow", 8, "main"), ("a.js", "add", 9, "twice"), ("a.kt", "repo.save", 5, "run"), ("a.rb", "yell", 5, "hi"), ("a.php", "$this.run", 3, "go"), ("a.cpp", "run", 9, "go"), ("a.ex", "helper", 4, "add")} <= found
    assert not [x for x in found if x[1] in ("proto", "later", "Not", "my")]


def test_receivers_have_the_type_of_their_nearest_declaration(planted, spark):
    found = {(r.path.removeprefix("/a/"), r.full_name): r.receiver_type for r in structure.receiver_types(planted[1]).collect()}
    assert found["A.java", "workService.doWork"] == "WorkService"
    assert found["a.kt", "w.doIt"] == "Worker" and found["a.kt", "repo.save"] == "Repo"
    assert found["a.ts", "this.svc.run"] == "Service" and found["a.go", "c.Meow"] == "Cat"
    shadow = "class A {\n  Outer x;\n  void f(Inner x) { x.a(); }\n  void g() { x.b(); { Local x = new Local(); x.c(); } x.d(); }\n  void h() { y.e(); Late y; y.e2(); }\n}\n"
    files = spark.createDataFrame([("/s/A.java", "java", shadow)], "path string, language string, text string")
    types = {r.name: r.receiver_type for r in structure.receiver_types(structure.structure(files)).collect() if r.receiver}
    assert types == {"a": "Inner", "b": "Outer", "c": "Local", "d": "Outer", "e": None, "e2": "Late"}


def test_types_resolve_calls_of_java_and_kotlin(planted, spark):
    more = spark.createDataFrame([("/b/WorkService.java", "java", "class WorkService { void doWork(int i) {} }"), ("/b/Other.java", "java", "class Other { void doWork(int i) {} }"), ("/b/Worker.kt", "kotlin", "class Worker { fun doIt() { } }"), ("/b/W2.kt", "kotlin", "class W2 { fun doIt() { } }")], "path string, language string, text string")
    files = planted[0].union(more)
    found = structure.elements(files, structure.structure(files)).cache()
    rows = {(r.path, r.name): (r.target, r.how) for r in resolution.resolve_calls(found, symbol_index(found)).collect()}
    assert rows["/a/A.java", "doWork"] == ("/b/WorkService.java", "type")
    assert rows["/a/a.kt", "doIt"] == ("/b/Worker.kt", "type")
    imports = {(r.path, r.full_name) for r in found.filter("kind = 'import'").collect()}
    assert {("/a/A.java", "y.B"), ("/a/a.hs", "Data.List"), ("/a/a.cpp", "a")} <= imports


def test_unbalanced_and_odd_sources(spark):
    files = spark.createDataFrame([("/x/1.js", "javascript", "function a( { if (x) {"), ("/x/2.c", "c", "}}} int f(int a) { return 1; } }"), ("/x/3.rb", "ruby", "end end def f"), ("/x/4.java", "java", "/* class A {"), ("/x/5.go", "go", "\"unclosed")], "path string, language string, text string")
    found = {(r.path, r.name, r.end_line) for r in structure.structure(files).declarations.collect()}
    assert ("/x/2.c", "f", 1) in found and ("/x/3.rb", "f", 1) in found
    assert not [x for x in found if x[0] == "/x/4.java"]


def test_ancestors_follow_prepends_includes_and_parents(spark):
    mixed = spark.createDataFrame([("C", "A", "include", 1), ("C", "B", "include", 2), ("C", "P", "prepend", 3), ("C", "E", "extend", 4), ("A", "M", "include", 1), ("B", "M", "include", 1), ("X", "Y", "include", 1), ("Y", "X", "include", 1)], "name string, module string, how string, nth int")
    parents = spark.createDataFrame([("D", "C"), ("C", "Root")], "name string, parent string")
    order = structure.ancestors(parents, mixed).cache()
    by = {}
    for r in order.orderBy("name", "place").collect():
        by.setdefault(r.name, []).append(r.ancestor)
    assert by["C"] == ["P", "C", "B", "A", "M", "Root"] and by["D"] == ["D", "P", "C", "B", "A", "M", "Root"]
    assert by["X"] == ["X", "Y"]
    methods = spark.createDataFrame([("M", "go"), ("B", "go"), ("Root", "stop"), ("P", "stop")], "name string, method string")
    assert {(r.name, r.method): r.owner for r in structure.looked_up(order, methods).collect()}["D", "go"] == "B"


def test_no_window_reads_a_file_anew_for_each_token(spark, capsys):
    """A frame up to the end of a file takes the square of its tokens."""
    files = spark.createDataFrame([("/a/A.java", "java", "class A { int f(int a) { return g(a); } }")], "path string, language string, text string")
    structure.with_stops(structure.tokens(files)).explain(True)
    shown = capsys.readouterr().out.lower()
    assert "windowframe" in shown and "unboundedfollowing" not in shown


def test_pieces_of_a_text_have_its_tokens(spark, monkeypatch):
    """A text is cut into pieces between tokens, whatever is open or never closed."""
    odd = ['"never closed /* x', "a /* open\n b", 'x = """a\nb', "'a 'b' `c\nd` `e", "#[x] # y\n/x", "=begin\n=end\n=beginx a::b c: d", "\n \t\n\r\nété\U0001f600 == === !", "{- a -} -- b\n{- c", "   ", ""]
    rows = [(path, language, text) for (path, language), text in SOURCES.items()] + [(f"/o/{k}-{language}", language, text) for k, text in enumerate(odd) for language in structure.LANGUAGES]
    files = spark.createDataFrame(rows, "path string, language string, text string")

    def found(size):
        monkeypatch.setattr(structure, "PIECE", size)
        return sorted(structure.tokens(files).select("path", "pos", "token", "line", "first", "n1", "p1").collect(), key=lambda r: r[:2])

    whole = found(1_000_000)
    assert len(whole) > 1000 and all(found(size) == whole for size in (1, 3))


def test_no_array_of_a_whole_files_tokens(spark):
    """A file of many tokens becomes rows by way of arrays of at most PIECE."""
    from pyspark.sql import functions as F

    files = spark.range(1).select(F.lit("/a.java").alias("path"), F.lit("java").alias("language"), F.expr("repeat('f(a, b);\n', 5000)").alias("text"))
    plan = structure.tokens(files)._jdf.queryExecution().analyzed().toString()
    arrays = [line for line in plan.splitlines() if "posexplode(" in line]
    assert len(arrays) == 2 and f"{{1,{structure.PIECE}}}+" in arrays[1] and f"{{1,{structure.PIECE}}}+" not in arrays[0]
    assert structure.tokens(files).count() == 35_000

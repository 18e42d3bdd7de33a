"""A live index: scans, event streams that stop and go on, commits that are killed, deletions."""

import pytest
from pyspark.sql import functions as F

from codeloom.sources.versions import Versions
from codeloom.streaming import live

ONE, TWO = "def a():\n    return b()\n", "def b():\n    return 1\n\ndef c():\n    return b()\n"


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def state(index):
    found = index.elements()
    return set() if found is None else {(r.path, r.kind, r.name, r.line_number) for r in found.collect()}


@pytest.fixture
def index(spark, tmp_path):
    return live.LiveIndex(spark, str(tmp_path / "index"))


def full(spark, tmp_path, rows):
    other = live.LiveIndex(spark, str(tmp_path / "full"))
    other.scan(files_of(spark, rows))
    return state(other)


def test_scan_parses_only_what_changed(spark, index):
    assert state(index) == set() and index.files().count() == 0
    assert index.scan(files_of(spark, [("/a/x.py", ONE), ("/a/y.py", TWO), ("/b/e.py", None), (None, ONE)])) == 3
    assert index.scan(files_of(spark, [("/a/x.py", ONE), ("/a/y.py", ONE), ("/b/e.py", "")])) == 1
    assert {x for x in state(index) if x[1] == "function"} == {("/a/x.py", "function", "a", 1), ("/a/y.py", "function", "a", 1)}
    assert index.scan(files_of(spark, [("/a/x.py", "")]), under="/a") == 1  # y goes, x is empty now, b is not under /a
    assert state(index) == set()
    assert {r.path for r in index.files().collect()} == {"/a/x.py", "/b/e.py"}


def test_a_killed_commit_leaves_the_old_state(spark, index):
    index.scan(files_of(spark, [("/a/x.py", ONE)]))
    before = state(index)
    index.versions.write({"files": files_of(spark, [("/z.py", "h")]).withColumnRenamed("text", "hash"), "elements": index.parser(files_of(spark, [("/z.py", TWO)]))})  # no manifest
    assert state(index) == before
    assert index.scan(files_of(spark, [("/a/x.py", TWO)])) == 1  # takes the number that was left
    assert {x[0] for x in state(index)} == {"/a/x.py"}
    now = state(index)
    index.versions.compact()
    assert state(index) == now
    assert {x[2] for x in {(r.path, r.kind, r.name) for r in index.versions.read("elements", 1).collect()} if x[1] == "function"} == {"a"}


def test_a_stream_that_stops_and_goes_on_equals_a_full_scan(spark, index, tmp_path):
    index.scan(files_of(spark, [("/a/x.py", ONE), ("/a/y.py", TWO), ("/a/gone.py", ONE)]))
    log = tmp_path / "log"

    def events(*rows):
        spark.createDataFrame([(*r[:4], r[4]) for r in rows], "path string, kind string, to string, text string, at int").select("path", "kind", "to", "text", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(log))

    def follow():
        stream = spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(log))
        index.follow(stream, str(tmp_path / "marks"), once=True).awaitTermination(120)

    events(("/a/x.py", "modified", None, TWO, 1), ("/a/x.py", "modified", None, ONE + TWO, 2), ("/a/new.py", "created", None, ONE, 1))
    events(("/a/y.py", "moved", "/b/y.py", TWO, 3), ("/a/gone.py", "deleted", None, None, 4))
    follow()
    versions = index.versions.last()
    follow()  # nothing new
    assert index.versions.last() == versions
    events(("/a/new.py", "deleted", None, None, 5), ("/a/new.py", "created", None, TWO, 5), (None, "created", None, ONE, 6))
    follow()
    assert state(index) == full(spark, tmp_path, [("/a/x.py", ONE + TWO), ("/b/y.py", TWO), ("/a/new.py", TWO)])


def test_a_batch_that_comes_again_is_not_applied_twice(spark, index):
    batch = spark.createDataFrame([("/x.py", "created", None, ONE, None)], live.EVENTS)
    assert index.apply(batch, "events 0") == 1
    assert index.apply(batch, "events 0") == 0 and index.versions.last() == 1
    index.delete("/x.py")
    assert state(index) == set()


def test_directories_and_heirs(spark):
    files = files_of(spark, [("/a/b/c/x.py", None), ("/a/b/y.py", None), ("/d/z.py", None)])
    assert {r.directory for r in live.emptied(files, files.filter("path <> '/a/b/y.py'")).collect()} == {"/a/b/c", "/d"}
    functions = spark.createDataFrame([(1, "/f.py"), (2, "/g.py")], "id long, path string")
    classes = spark.createDataFrame([(1, "/f.py"), (2, "/h.py"), (3, "/i.py")], "id long, path string")
    calls = spark.createDataFrame([(2, 1)], "src long, dst long")
    inherits = spark.createDataFrame([(2, 1), (3, 2)], "child long, parent long")
    found = live.affected(functions.filter("id = 1"), functions, calls, classes, inherits)
    assert {r.path for r in found.collect()} == {"/f.py", "/g.py", "/h.py"}


def test_versions_of_any_table(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "v"), {"t": ["k"]})
    assert table.read("t") is None and table.last() == 0
    table.commit({"t": spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")})
    table.commit({"t": spark.createDataFrame([(1, "d")], "k int, x string")}, {"t": spark.createDataFrame([(2,)], "k int")}, "m")
    table.commit({"t": spark.createDataFrame([(9, "z")], "k int, x string")}, mark="m")
    assert [tuple(r) for r in table.read("t").collect()] == [(1, "d")]
    assert table.read("t", 1).count() == 3

"""Small hand-made graphs whose answers are known."""

from dataclasses import fields, replace
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import topology, traversal, vectors
from codeloom.operators.graph import Graph, reach, reversed_edges, within
from codeloom.operators.search import callers_of, dead, fuzzy
from codeloom.plans import commands, rules

FUNCTIONS = "id long, name string, path string, line_number long, end_line long, complexity long, docstring string, source string, is_dependency boolean, decorator string, decorators array<string>"


def edges(spark, *pairs):
    return spark.createDataFrame(pairs or [(0, 0)], "src long, dst long").filter(F.lit(bool(pairs)))


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def graph(spark, functions, calls=()):
    rows = [(i, n, p, i * 10, i * 10 + 5, 1, "", n, False, d, [d] if d else []) for i, n, p, d in functions]
    nothing = spark.range(0)
    g = Graph(**{f.name: nothing for f in fields(Graph)})
    return replace(g, functions=spark.createDataFrame(rows, FUNCTIONS), calls=edges(spark, *calls))


CYCLE = ((1, 2), (2, 3), (3, 1), (3, 4))


def test_reach_holds_a_seed_on_a_cycle(spark):
    assert {r.id for r in reach(ids(spark, 1), edges(spark, *CYCLE)).collect()} == {1, 2, 3, 4}


def test_within_counts_fewest_hops(spark):
    found = within(ids(spark, 1), edges(spark, *CYCLE), 5)
    assert {tuple(r) for r in found.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_reach_of_nothing(spark):
    assert reach(ids(spark, 9), edges(spark, *CYCLE)).count() == 0


def test_chains_of_a_diamond(spark):
    found = traversal.chains(ids(spark, 1), ids(spark, 4), edges(spark, (1, 2), (1, 3), (2, 4), (3, 4)), 5)
    assert {(tuple(r.path), r.length) for r in found.collect()} == {((1, 2, 4), 2), ((1, 3, 4), 2)}


def test_chains_use_no_edge_twice(spark):
    found = traversal.chains(ids(spark, 1), ids(spark, 2), edges(spark, (1, 2), (2, 1)), 5)
    assert [tuple(r.path) for r in found.collect()] == [(1, 2)]


def test_call_tree_keeps_both_parents_and_no_back_edge(spark):
    tree = traversal.call_tree(ids(spark, 1), edges(spark, (1, 2), (1, 3), (2, 4), (3, 4)))
    assert {(r.src, r.dst) for r in tree.collect()} == {(1, 2), (1, 3), (2, 4), (3, 4)}
    tree = traversal.call_tree(ids(spark, 1), edges(spark, (1, 2), (2, 1)))
    assert {(r.src, r.dst) for r in tree.collect()} == {(1, 2)}


def test_call_sites_and_callers_differ(spark):
    g = graph(spark, [(1, "a", "x.py", None), (2, "_b", "y.py", None)], [(1, 2), (1, 2)])
    assert g.calls.groupBy("dst").count().first()["count"] == 2
    assert rules.fan_out(g).first()["n"] == 1
    assert rules.cross_file_private_access(g).count() == 2
    assert callers_of(g, ids(spark, 2)).count() == 2


def test_test_code_that_reaches_a_private_function(spark):
    g = graph(spark, [(1, "t", "/tests/x.py", None), (2, "_b", "/src/y.py", None)], [(1, 2)])
    assert [r.metric for r in rules.test_reaches_private_seam(g).collect()] == ["_b"]


def test_sensitive_pairs_are_a_bag(spark):
    g = graph(spark, [(1, "f", "a.py", None), (2, "get_password", "b", None), (3, "read_token", "b", None), *((k, f"send_{k}", "c", None) for k in (4, 5, 6))], [(1, k) for k in range(2, 7)])
    assert rules.sensitive_data_unprotected(g).count() == 6


def test_handlers_are_known_by_decorator_not_by_name(spark):
    g = graph(
        spark,
        [(1, "show", "/src/a.py", "@app.route('/x')"), (2, "request_handler", "/src/a.py", None), (3, "run_query", "/src/b.py", None), (4, "do_auth", "/src/c.py", None), (5, "page", "/src/tests/a.py", "@router.get('/y')"), (6, "find_all", "/src/b.py", None)],
        [(1, 3), (2, 3), (5, 6)],
    )
    assert {(r.id, r.metric) for r in rules.auth_bypass(g).collect()} == {(1, "run_query"), (5, "find_all")}  # tests count here
    assert {r.id for r in rules.unlogged_endpoint(g).collect()} == {1, 5}
    checked = replace(g, calls=edges(spark, (1, 3), (3, 4), (5, 6)))
    assert {r.id for r in rules.auth_bypass(checked).collect()} == {5}
    far = replace(g, calls=edges(spark, (1, 2), (2, 6), (6, 3), (3, 4)))  # authorisation four calls away, two data stores within three
    assert sorted((r.id, r.metric) for r in rules.auth_bypass(far).collect()) == [(1, "find_all"), (1, "run_query")]


def test_admins_are_known_by_decorator_or_path(spark):
    g = graph(spark, [(1, "admin_panel", "/src/a.py", None), (2, "f", "/src/admin/a.py", None), (3, "g", "/src/a.py", "@staff_only"), (4, "save_all", "/src/b.py", None), (5, "audit", "/src/b.py", None)], [(1, 4), (2, 4), (3, 4), (3, 5)])
    assert [(r.id, r.metric) for r in rules.admin_action_no_audit_trail(g).collect()] == [(2, "save_all")]


def test_duties_need_a_call_of_a_class(spark):
    functions = [(1, "deploy_app", "/src/a.py", None), (2, "price", "/src/a.py", None), (3, "migrate", "/src/b.py", None), (4, "order", "/src/b.py", None)]
    g = replace(graph(spark, functions, [(4, 2)]), class_calls=edges(spark, (2, 77)))
    assert [(r.path, r.metric) for r in rules.separation_of_duties(g).collect()] == [("/src/a.py", 2)]


def test_private_access_between_project_files(spark):
    g = graph(spark, [(1, "a", "/src/x.py", None), (2, "_b", "/src/y.py", None), (3, "t", "/src/tests/z.py", None), (4, "t2", "/src/test_q.py", None)], [(1, 2), (3, 2), (4, 2)])
    assert {r.id for r in rules.cross_file_private_access(g).collect()} == {1, 4}
    assert {(r.id, r.metric) for r in rules.test_reaches_private_seam(g).collect()} == {(3, "_b"), (4, "_b")}
    outside = replace(g, functions=g.functions.withColumn("is_dependency", F.col("id") == 2))
    assert rules.cross_file_private_access(outside).count() == rules.test_reaches_private_seam(outside).count() == 0


def test_depth_of_several_bases_and_cycles(spark):
    inherits = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (8, 9), (9, 8), (10, 9)], "child long, parent long")
    found = traversal.inheritance_depth(Graph(**{f.name: inherits for f in fields(Graph)}))
    assert {tuple(r) for r in found.collect()} == {(2, 1), (3, 2), (4, 3), (5, 4)}
    chain = spark.createDataFrame([(k + 1, k) for k in range(50)], "child long, parent long")
    found = {r.id: r.depth for r in traversal.inheritance_depth(Graph(**{f.name: chain for f in fields(Graph)})).collect()}
    assert found == {k: k for k in range(1, 31)}


def test_presets_and_overrides():
    found = {r.id: r for r in rules.selected()}
    assert len(found) == 28 and found["cross_file_private_access"].severity == found["auth_bypass"].severity == "hard" and found["unlogged_endpoint"].severity == "warn"
    assert {r.category for r in rules.selected(rules.Settings("minimal"))} == {"coupling"}
    assert {r.category for r in rules.selected(rules.Settings("soc2"))} == {"coupling", "compliance"}
    assert {r.category for r in rules.selected(rules.Settings("soc2", categories=("clarity",)))} == {"clarity"}
    own = rules.Settings("strict", overrides={"auth_bypass": "off", "unlogged_endpoint": "blocker", "test_import_in_prod": "warn"}, hard_stop=("missing_docstring",), thresholds={"cyclomatic_complexity": {"warn": 3}}, library=True)
    found = {r.id: r for r in rules.selected(own)}
    assert not {"auth_bypass", "unreferenced_public_function", "unreferenced_public_class", "circular_imports"} & found.keys()
    assert all(found[x].severity == "hard" for x in ("unlogged_endpoint", "missing_docstring", "excessive_fan_out", "test_import_in_prod"))
    assert found["cyclomatic_complexity"].thresholds == {"warn": 3}


def test_an_audit_with_a_rule_of_its_own(spark):
    g = graph(spark, [(1, "alpha", "/src/a.py", None), (2, "beta", "/src/b.py", None), (3, "gamma", "/src/tests/c.py", None), (4, "delta", "/src/d.py", "property")])
    own = rules.Rule.from_sql({"id": "late_names", "query": "SELECT id, name, path, line_number AS metric FROM functions WHERE name > 'b' AND line_number >= $least", "severity": "hard", "thresholds": {"least": 20}, "exemptions": True, "suggestion": "{{name}} at {{metric_value}}{{nothing}}"})
    found = rules.findings(g, rules={own.id: own}).collect()
    assert [(r.rule, r.severity, r.name, r.metric, r.suggestion) for r in found] == [("late_names", "hard", "beta", "20", "beta at 20")]  # a path and a decorator spare the others
    counted = rules.audit(g, rules={own.id: own})
    assert tuple(rules.gate(counted).first()) == (0, 1, False)
    assert rules.audit(g, scope=("src/a.py",), rules={own.id: own}).first().offenders == 0


def test_dead_code_leaves_entry_points(spark):
    g = graph(spark, [(1, "main", "a.py", None), (2, "used", "a.py", None), (3, "idle", "a.py", None), (4, "__init__", "a.py", None), (5, "test_x", "a.py", None), (6, "page", "a.py", "@app.route"), (7, "far", "/venv/a.py", None)], [(1, 2)])
    assert [r.name for r in dead(g, ("@app.route",)).collect()] == ["idle"]


def test_fuzzy_names(spark):
    rows = spark.createDataFrame([("process",), ("access",), ("proc",)], "name string")
    assert {(r.name, r.distance) for r in fuzzy(rows, "procss").collect()} == {("process", 1), ("proc", 2)}


def test_hotspots_of_two_files(spark):
    functions = spark.createDataFrame([(1, "routes"), (2, "validators")], "id long, path string")
    calls = edges(spark, *[(9, 1)] * 10, *[(9, 2)] * 5)
    changes = spark.createDataFrame([("routes",)] * 20 + [("validators",)] * 8, "path string")
    assert [(r.path, r.risk) for r in commands.hotspots_of(changes, functions, calls).collect()] == [("routes", 100.0), ("validators", 20.0)]


@pytest.mark.parametrize(("counts", "score", "grade"), [([("hard", 6), ("warn", 3)], 54, "D"), ([("hard", 1)], 92, "B"), ([("warn", 0)], 100, "A"), ([("hard", 9), ("hard", 9), ("hard", 9)], 0, "F")])
def test_health(spark, counts, score, grade):
    found = rules.health(spark.createDataFrame(counts, "severity string, offenders long")).first()
    assert (found.score, found.grade) == (score, grade)


def test_percentiles_interpolate(spark):
    found = rules.calibration(spark.createDataFrame([(1,), (2,), (3,), (10,)], "metric long"), 2)
    values = {round(r.q, 2): r.value for r in found.collect()}
    assert (values[0.25], values[0.5], round(values[0.9], 6)) == (1.75, 2.5, 7.9)


def test_entry_points_by_decorator(spark):
    g = graph(spark, [(1, "a", "x", "@app.route('/x')"), (2, "b", "x", "@click.command()"), (3, "c", "x", None)], [(2, 1)] * 4 + [(1, 2)] * 30)
    assert {(r.name, r.framework, r.base) for r in commands.classified(g.functions).collect()} == {("a", "flask", 5.0), ("b", "click", 4.0)}


def test_the_highest_of_several_decorators(spark):
    rows = [(1, ["@overload", "@celery.task", "@pytest.fixture(scope='x')", "@celery.task()"]), (2, ["@a.get('/x')", "@app.route('/y')"]), (3, ["@overload"]), (4, []), (5, None), (6, [" @ click.command ()", None])]
    found = {r.id: (r.framework, r.category, r.base, r.matched) for r in commands.classified(spark.createDataFrame(rows, "id long, decorators array<string>")).collect()}
    assert found == {1: ("celery", "task", 3.0, ["celery.task", "pytest.fixture"]), 2: ("fastapi", "http", 5.0, ["a.get", "app.route"]), 6: ("click", "cli", 4.0, ["click.command"])}


def test_surprise(spark):
    member = spark.createDataFrame([(k, "a") for k in range(10)] + [(k, "b") for k in range(10, 20)] + [(20, "c"), (21, "c"), (22, "d"), (23, "d")], "id long, community string")
    found = topology.surprise_of(edges(spark, (0, 10), (20, 22), (20, 23), (21, 22)), member)
    assert {(r.a, r.b, r.surprise) for r in found.collect()} == {("a", "b", 6.64), ("c", "d", 0.42)}


def test_two_triangles_fall_apart():
    found = topology.communities_of([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)])
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_communities_are_the_same_at_every_size(spark):
    rng = np.random.default_rng(5)
    cliques = [(10 * c + i, 10 * c + j) for c in range(8) for i in range(6) for j in range(i)]
    pairs = cliques + [(int(a), int(b)) for a, b in 10 * rng.integers(0, 8, (12, 2)) + rng.integers(0, 6, (12, 2))] + [(500, 500)]
    one = {(r.id, r.community) for r in topology.communities(edges(spark, *pairs)).collect()}
    joined = {(r.id, r.community) for r in topology.communities(edges(spark, *pairs), 0).collect()}
    assert joined == one and len({c for _, c in one}) == 9
    star = [(0, k) for k in range(1, 9)]  # one community at first, of more than a quarter
    one = {(r.id, r.community) for r in topology.communities(edges(spark, *star)).collect()}
    assert one == {(r.id, r.community) for r in topology.communities(edges(spark, *star), 0).collect()}
    assert len({c for _, c in one}) > 1


def test_communities_by_joins_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 400, (450, 2)) if a != b})
    rounds, joined = [], topology.checkpoint
    monkeypatch.setattr(topology, "checkpoint", lambda df: rounds.append(1) or (joined(df) if len(rounds) <= 60 else pytest.fail("too many rounds")))
    mixed = {(r.id, r.community) for r in topology.communities(edges(spark, *pairs), 250).collect()}  # a level by joins, the rest in one task
    assert mixed == set(topology.communities_of(pairs).items()) and 1 < len({c for _, c in mixed}) < 200


def test_a_path_of_rising_weights_takes_few_rounds(monkeypatch):
    turns = []
    monkeypatch.setattr(topology, "coin", lambda node, turn: turns.append(turn) or crc32(f"{node}:{turn}".encode()))
    a = np.arange(3000)
    found = topology.louvain(a, a + 1, a + 1)
    assert max(turns) < 60 and len(found) == 3001 and 10 < len(set(found.values())) < 100


def test_density_clusters_of_two_clouds():
    rng = np.random.default_rng(0)
    points = np.concatenate((rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50.0, 50.0]]))
    labels = topology.density_labels(points)
    assert len(set(labels[:20])) == 1 and len(set(labels[20:40])) == 1 and labels[0] != labels[20] and labels[40] == -1


def test_vector_edge_cases(spark):
    from codeloom.functions import vectors as v

    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [])], "a array<float>, b array<float>")
    found = rows.select(v.cosine(F.col("a"), F.col("b")).alias("c"), v.similarity(v.l2(F.col("a"), F.col("b"))).alias("s")).collect()
    assert [r.c for r in found] == [1.0, 0.0, 0.0, 0.0] and found[0].s == 1.0


def test_search_all_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    found = vectors.search_all(rows, rows.filter("vec_id % 100 = 0"), 4)
    want = {(q, int(i)) for q in (0, 100, 200) for i in np.argsort(((m - m[q]) ** 2).sum(1))[:4]}
    assert {(r["query"], r.vec_id) for r in found.collect()} == want


def test_search_by_chunks_equals_that_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 70)
    rng = np.random.default_rng(2)
    m = rng.integers(0, 3, (300, 4)).astype(float)  # with ties
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 10 = 0")
    whole, dealt = (vectors.search_all(rows, queries, 7, block=b).collect() for b in (4096, 8))
    assert {tuple(r) for r in whole} == {tuple(r) for r in dealt} and len(whole) == 210
    assert vectors.search_all(rows.limit(0), queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("threshold", (0.95, 0.2))
def test_pairs_around_pivots_are_all_found(spark, threshold):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(0, 0.1, (60, 6)) + centre for centre in rng.normal(0, 1, (8, 6))])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T > threshold, 1)))}
    found = vectors.similar_pairs(rows, threshold, block_rows=40)
    assert {(r.a, r.b) for r in found.collect()} == want and found.count() == len(want)
    dealt = vectors.blocked(rows.withColumnRenamed("vec_id", "id"), threshold, 40)
    if threshold > 0.9:  # pairs of far blocks are left out
        blocks = dealt.select("block").distinct().count()
        assert dealt.select("low", "high").distinct().count() < 0.7 * blocks * (blocks + 1) / 2


def test_locks_and_lanes(spark):
    paths = spark.createDataFrame([("src/a/b.py:12",)], "path string").withColumn("path", F.concat(F.lit("/"), "path"))
    locks = spark.createDataFrame([("lane1", "/src/a"), ("lane2", "/src/a/b.py"), ("mine", "/src")], "lane string, locked string")
    assert {r.lane for r in commands.lock_overlaps(paths, locks, "mine").collect()} == {"lane1", "lane2"}


def test_enclosing_definitions(spark):
    rows = spark.createDataFrame([(1, "f", 1, 0), (2, "f", 10, 0), (3, "f", 20, 0), (4, "f", 5, 1), (5, "f", 10, 1), (6, "f", 25, 1)], "ref long, file string, line long, kind int")
    assert {(r.ref, r.enclosing) for r in commands.enclosing(rows).collect()} == {(4, 1), (5, 2), (6, 3)}


def test_orphans(spark):
    left = traversal.orphans(ids(spark, 1, 2, 3, 4, 5), edges(spark, (1, 2), (2, 3), (4, 5)), ids(spark, 1))
    assert {r.id for r in left.collect()} == {4, 5}


def test_reversed_edges(spark):
    assert {tuple(r) for r in reversed_edges(edges(spark, (1, 2))).collect()} == {(2, 1)}


def test_names_and_paths(spark):
    from codeloom.functions import text as fn

    rows = spark.createDataFrame([("getUserById", "get User By Id"), ("calculate_total_price", "calculate total price"), ("getHTTPUserById", "get HTTP User By Id")], "name string, want string")
    assert all(r.got == r.want for r in rows.select(fn.humanised(F.col("name")).alias("got"), "want").collect())
    one = spark.createDataFrame([("/src/tests/a.py",)], "p string").select(fn.is_test_path(F.col("p")).alias("t"), fn.in_scope(F.col("p"), "tests").alias("s"), fn.ancestors(F.col("p")).alias("a"), fn.slug(F.lit("My Repo!")).alias("slug"), fn.suggestion(F.lit("use {{x}}{{y}}"), {"x": F.lit(1)}).alias("m")).first()
    assert one.t and one.s and one.a == ["/src", "/src/tests"] and one.slug == "my-repo" and one.m == "use 1"


def test_replay_counts_only_comparable_events(spark):
    rows = spark.createDataFrame([(40, 400), (0, 100)], "packet_chars long, raw_chars long")
    assert tuple(commands.replay(rows).first()) == (10, 100, 1, 90.0)


def test_label_propagation_and_cross_edges(spark):
    pairs = edges(spark, (1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4))
    member = spark.createDataFrame([(k, 1 if k < 4 else 4) for k in range(1, 7)], "id long, community long")
    assert [(r.src, r.dst) for r in topology.cross_edges(pairs, member).collect()] == [(3, 4)]
    assert topology.label_propagation(pairs).count() == 6


def test_projection_keeps_the_main_axis(spark):
    rng = np.random.default_rng(0)
    m = np.column_stack((rng.normal(0, 5, 200), rng.normal(0, 1, 200), rng.normal(0, 0.1, 200)))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    found = topology.pca(rows).orderBy("vec_id").toPandas()
    assert abs(np.corrcoef(found["x"], m[:, 0])[0, 1]) > 0.99 and abs(np.corrcoef(found["y"], m[:, 1])[0, 1]) > 0.99


def test_advice_has_an_id_of_the_hour():
    said = commands.advise("lock", {"path": "a.py"}, "2024010112")
    assert said["text"].startswith("Another lane has locked a.py") and said["id"].startswith("adv_2024010112_")


def test_a_class_has_its_parents_children_and_methods(spark):
    from codeloom.facade import Engine

    g = graph(spark, [(9, "run", "/a.py", None), (10, "other", "/a.py", None)])
    classes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id long, name string")
    inherits = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "child long, parent long")
    methods = spark.createDataFrame([(2, 9), (1, 10)], "class_id long, function_id long")
    found = Engine(replace(g, classes=classes, inherits=inherits, methods=methods), spark).analyse("hierarchy", "2")
    assert sorted(map(tuple, found.collect())) == [("child", 3, "C"), ("method", 9, "run"), ("parent", 1, "A")]


def test_six_decimals_are_those_of_printf(spark):
    from codeloom.functions.vectors import tsv

    xs = np.array([2.0**-7, 3 * 2.0**-7, -(2.0**-7), 1e-9, -1e-9, 0.5, 1e12, 3.0000005], np.float32).tolist()
    assert spark.createDataFrame([(xs,)], "a array<float>").select(tsv(F.col("a"))).first()[0] == "\t".join(f"{x:.6f}" for x in xs)


def far_apart(n, seed=5, size=8):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, size)).astype(np.float32), r.normal(size=(n, size)).astype(np.float32)


def cosines(x, y):
    x, y = (m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True) for m in (x, y))
    return x @ y.T


NAMED = "id long, behaviour array<float>, naming array<float>"


def test_naming_rules_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 16)
    monkeypatch.setattr(vectors, "TILE", 5)
    does, called = far_apart(150)
    rows = spark.createDataFrame([(i, does[i].tolist(), called[i].tolist()) for i in range(150)], NAMED)
    alike, names = cosines(does, does), cosines(called, called)
    own = np.diag(cosines(does, called))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if alike[i, j] >= 0.5 and names[i, j] < 0.1}
    assert {(r.a, r.b) for r in vectors.inconsistent_naming(rows, 0.5, 0.1).collect()} == want
    better = {}
    for i in np.flatnonzero(own < 0.0):
        good = [int(j) for j in np.argsort(-alike[i], kind="stable") if own[j] > 0.1 and alike[i, j] > 0.2][:3]
        better |= {int(i): good} if good else {}
    assert {r.id: r.exemplars for r in vectors.better_name(rows, 0.0, 0.1, 0.2).collect()} == better


def test_vectors_are_sent_few_times(spark):
    """Blocks of 2,048 rows, each sent to each other, made the shuffle grow with the square of the rows."""
    rows = spark.range(20_000).select("id", F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    assert vectors.blocked(rows, -1.0).groupBy("block").count().count() <= 2 * vectors.FEW_BLOCKS
    names = rows.select("id", F.col("embedding").alias("behaviour"), F.col("embedding").alias("naming"))
    plan = vectors.inconsistent_naming(names.limit(10), 0.5, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_single_precision_as_the_sql_takes_it(spark, duck):
    x, _ = far_apart(400, size=64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {(r.a, r.b): r.similarity for r in vectors.similar_pairs(rows, 0.1, single=True).collect()}
    assert found
    for a, b in sorted(found)[:300]:
        got = duck.execute("SELECT list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) FROM (SELECT ?::FLOAT[] AS a, ?::FLOAT[] AS b)", [x[a].tolist(), x[b].tolist()]).fetchone()
        assert found[a, b] == got[0]


def test_texts_that_hold_a_name(spark):
    names = ["get", "get_query", "", "ab", "query", "none_such"]
    texts = ["my_get_query", "ab", "xget", "", None]
    found = rules.holding(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, found.collect())) == sorted((n, t) for n in names for t in texts if t is not None and n in t)


def test_an_audit_of_names_writes_functions_alone(spark, monkeypatch):
    written = []
    monkeypatch.setattr(rules, "checkpoint", lambda df: written.append(df) or df)
    g = graph(spark, [(1, "run", "/a.py", None)])
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "id long, behaviour array<double>, naming array<double>")
    files = spark.createDataFrame([("/a.py", [1.0, 0.0])], "path string, naming array<double>")
    counted = rules.audit(g, rules.Settings(categories=("naming",)), embeddings=vectors.Named(rows, files))
    assert {r.rule: r.offenders for r in counted.collect()}["misleading_name"] == 1 and len(written) == 1


def test_an_audit_holds_one_rule_at_a_time(spark, monkeypatch):
    """The plan of a rule is counted and gone before the next rule is made."""
    made = []
    count = type(spark.range(1)).count
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: made.append("counted") or count(df))

    def rule(name, least):
        return rules.Rule(name, lambda g: made.append(name) or g.functions.filter(F.col("id") >= least))

    g = graph(spark, [(k, f"f{k}", "/a.py", None) for k in range(1, 6)])
    counted = rules.audit(g, rules={x.id: x for x in (rule("three", 3), rule("none", 9), rule("all", 0))})
    assert made == ["three", "counted", "none", "counted", "all", "counted"]
    assert {r.rule: r.offenders for r in counted.collect()} == {"three": 3, "none": 0, "all": 5}


def test_hybrid_search_embeds_once(spark, small):
    from codeloom.operators import hybrid
    from codeloom.operators.graph import load

    assert "MapIn" not in hybrid.hybrid_search(load(spark, small))._jdf.queryExecution().optimizedPlan().toString()

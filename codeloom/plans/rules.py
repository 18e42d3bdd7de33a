"""Quality rules over the graph: each finds offenders (rule, id, name, path, metric), with thresholds as parameters.

A registry holds every rule with its severity, category, thresholds and suggestion;
an audit takes a preset, overrides, exemptions and a scope, as data. Compliance rules
know a function's part by fixed words in its decorators, name or path. They are
registered over `coded` tables: the graph of the warehouse, whose names, paths and
decorators are made to look like source code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import vectors
from ..operators.graph import Graph, checkpoint, load, top, within
from ..operators.traversal import inheritance_depth
from ..registry import on_graph, on_tables

TEST_PREFIX = "/tests/"


def offenders(rule: str, rows: DataFrame, metric: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "id", "name", "path", metric.cast("long").alias("metric"))


def own(g: Graph) -> DataFrame:
    """Functions of the project outside tests."""
    return g.functions.filter(~F.col("is_dependency") & ~F.col("path").contains(TEST_PREFIX))


def cyclomatic_complexity(g: Graph, warn: int = 10) -> DataFrame:
    return offenders("cyclomatic_complexity", own(g).filter(F.col("complexity") > warn), F.col("complexity"))


def function_too_long(g: Graph, warn: int = 50) -> DataFrame:
    length = F.col("end_line") - F.col("line_number")
    return offenders("function_too_long", own(g).filter(length > warn), length)


def class_too_large(g: Graph, warn: int = 20) -> DataFrame:
    counted = g.methods.groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > warn)
    return offenders("class_too_large", g.classes.filter("not is_dependency").join(counted, "id"), F.col("n"))


def parameter_count(g: Graph, warn: int = 5) -> DataFrame:
    counted = g.parameters.groupBy(F.col("function_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > warn)
    return offenders("parameter_count", own(g).filter(~F.col("name").startswith("__")).join(counted, "id"), F.col("n"))


def fan_out(g: Graph) -> DataFrame:
    """(id, n): distinct callees of each caller."""
    return g.calls.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def excessive_fan_out(g: Graph, warn: int = 15) -> DataFrame:
    return offenders("excessive_fan_out", own(g).join(fan_out(g).filter(F.col("n") > warn), "id"), F.col("n"))


def call_sites(g: Graph) -> DataFrame:
    """Calls with name and file of both ends, a row for each call site."""
    ends = g.functions.select("id", "name", "path", "is_dependency")
    src = ends.select(*(F.col(c).alias("src" if c == "id" else f"src_{c}") for c in ends.columns))
    dst = ends.select(*(F.col(c).alias("dst" if c == "id" else f"dst_{c}") for c in ends.columns))
    return g.calls.join(src, "src").join(dst, "dst")


def circular_imports(g: Graph) -> DataFrame:
    """(file_a, file_b): pairs of files that call each other."""
    pairs = call_sites(g).filter("src_path <> dst_path").select(F.col("src_path").alias("file_a"), F.col("dst_path").alias("file_b")).distinct()
    back = pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"))
    return pairs.filter("file_a < file_b").join(back, ["file_a", "file_b"], "left_semi")


def cross_file_private_access(g: Graph) -> DataFrame:
    """A row for each call of a private function of the project from another file outside tests."""
    rows = call_sites(g).filter(F.col("dst_name").startswith("_") & (F.col("src_path") != F.col("dst_path")) & ~F.col("src_is_dependency") & ~F.col("dst_is_dependency") & ~F.col("src_path").contains(TEST_PREFIX))
    return by_callee("cross_file_private_access", rows)


def by_callee(rule: str, rows: DataFrame) -> DataFrame:
    """Offenders that are callers; the metric is the callee's name."""
    return rows.select(F.lit(rule).alias("rule"), F.col("src").alias("id"), F.col("src_name").alias("name"), F.col("src_path").alias("path"), F.col("dst_name").alias("metric"))


def test_import_in_prod(g: Graph) -> DataFrame:
    """(rule, path, metric): imports of a test module by files outside tests; the metric is the module's name."""
    files = g.imports.filter(~fn.holds(F.col("path"), "/tests/", "/test/")).join(g.modules.select(F.col("id").alias("module_id"), F.col("path").alias("module_path")), "module_id", "left")
    outside = g.functions.filter("is_dependency").select("path").distinct()
    rows = files.join(outside, "path", "left_anti").filter(fn.holds(F.col("module_path"), "/tests/", "/test/") | F.col("imported_name").contains("test_"))
    return rows.select(F.lit("test_import_in_prod").alias("rule"), "path", F.col("imported_name").alias("metric"))


def shallow_pass_through(g: Graph, lines: int = 8, complexity: int = 2) -> DataFrame:
    short = own(g).filter((F.col("end_line") - F.col("line_number") <= lines) & (F.col("complexity") <= complexity))
    callers = call_sites(g).filter("src_path <> dst_path").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers")).filter("callers >= 2")
    return offenders("shallow_pass_through", short.join(fan_out(g).filter("n = 1").select("id"), "id", "left_semi").join(callers, "id"), F.col("callers"))


def single_adapter_seam(g: Graph, least: int = 2) -> DataFrame:
    """Classes named as a seam that fewer than `least` classes extend."""
    name = F.col("name")
    seam = name.endswith("Protocol") | name.endswith("Interface") | name.endswith("Port") | name.startswith("Base") | name.startswith("Abstract")
    children = g.inherits.groupBy(F.col("parent").alias("id")).agg(F.count_distinct("child").alias("n"))
    rows = g.classes.filter(seam & ~F.col("is_dependency") & ~F.col("path").contains(TEST_PREFIX)).join(children, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)
    return offenders("single_adapter_seam", rows, F.col("n"))


def test_reaches_private_seam(g: Graph) -> DataFrame:
    """A row for each call of a private function outside tests by a test."""
    rows = call_sites(g).filter(fn.holds(F.col("src_path"), "/tests/", "/test_") & F.col("dst_name").startswith("_") & ~fn.holds(F.col("dst_path"), "/tests/", "/test_") & ~F.col("dst_is_dependency"))
    return by_callee("test_reaches_private_seam", rows)


def wide_public_interface(g: Graph, warn: int = 12) -> DataFrame:
    """(path, n): files of more than `warn` public functions."""
    return own(g).filter(~F.col("name").startswith("_")).groupBy("path").agg(F.count_distinct("id").alias("n")).filter(F.col("n") > warn)


def unreferenced_public_function(g: Graph) -> DataFrame:
    callers = g.calls.join(g.functions.filter("not is_dependency").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return offenders("unreferenced_public_function", own(g).filter(~F.col("name").startswith("_")).join(callers, "id", "left_anti"), F.lit(0))


def unreferenced_public_class(g: Graph, implements: DataFrame | None = None) -> DataFrame:
    """Public classes that no class extends or implements and none of whose methods a function of the project calls from another file. implements: edges (child, parent)."""
    called = call_sites(g).join(g.methods.select(F.col("function_id").alias("dst"), "class_id"), "dst").join(g.classes.select(F.col("id").alias("class_id"), F.col("path").alias("class_path")), "class_id")
    used = called.filter(~F.col("src_is_dependency") & (F.col("src_path") != F.col("class_path"))).select(F.col("class_id").alias("id"))
    rows = g.classes.filter(~F.col("is_dependency") & ~F.col("name").startswith("_") & ~F.col("path").contains(TEST_PREFIX)).join(g.inherits.select(F.col("parent").alias("id")), "id", "left_anti").join(used, "id", "left_anti")
    if implements is not None:
        rows = rows.join(implements.select(F.col("parent").alias("id")), "id", "left_anti")
    return offenders("unreferenced_public_class", rows, F.lit(0))


def missing_docstring(g: Graph, exempt: tuple[str, ...] = ("@overload", "@abstractmethod")) -> DataFrame:
    bare = F.coalesce("docstring", F.lit("")) == ""
    free = ~F.coalesce(F.exists("decorators", lambda d: d.isin(*exempt)), F.lit(False))
    return offenders("missing_docstring", own(g).filter(bare & free & F.col("path").endswith(".py") & ~F.col("name").startswith("_")), F.lit(0))


INIT = "__init__.py"


#: First letters of a name by which texts that hold it are looked up.
GRAM = 4


def holding(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, text): distinct texts that hold a name, by the name's first letters, which are a run of the text's; each distinct name and text is compared once."""
    names = names.select("name").distinct().withColumn("gram", F.left("name", F.lit(GRAM)))
    texts = texts.filter("text is not null").select("text").distinct()
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring(F.col("text"), i, n))))
    return texts.select("text", F.explode(F.array_distinct(runs)).alias("gram")).join(names, "gram").filter(F.contains("text", "name")).select("name", "text")


def missing_public_reexport(g: Graph) -> DataFrame:
    """Called public functions below a package file that no package file above them imports by name. The package files' folders meet the folders above a function in an equality join; names meet the texts that hold them once, whatever the folder."""
    files = g.functions.select("path").union(g.classes.select("path")).union(g.imports.select("path")).distinct()
    packages = files.filter(F.col("path").endswith(INIT)).select(F.expr(f"left(path, length(path) - {len(INIT) + 1})").alias("folder"))
    rows = own(g).filter(~F.col("name").startswith("_") & ~fn.holds(F.col("path"), "/test_", "__init__") & F.col("path").contains("/"))
    rows = rows.join(call_sites(g).filter(~F.col("src_is_dependency")).select(F.col("dst").alias("id")), "id", "left_semi")
    inside = rows.select("id", "name", "path", F.explode(fn.ancestors(F.col("path"))).alias("folder")).join(packages, "folder", "left_semi")
    exported = g.imports.filter(F.col("path").endswith(INIT)).select(F.expr(f"left(path, length(path) - {len(INIT) + 1})").alias("folder"), "module_id", "imported_name")
    exported = exported.join(g.modules.select(F.col("id").alias("module_id"), "full_import_name"), "module_id", "left")
    exported = exported.select("folder", F.explode(F.array("imported_name", "full_import_name")).alias("text")).distinct()
    known = exported.join(holding(inside, exported), "text").select("folder", "name").distinct()
    named = inside.join(known, ["folder", "name"], "left_semi").select("id")
    return offenders("missing_public_reexport", inside.select("id", "name", "path").distinct().join(named, "id", "left_anti"), F.lit(0))


def deep_inheritance(g: Graph, warn: int = 4) -> DataFrame:
    return offenders("deep_inheritance", g.classes.filter("not is_dependency").join(inheritance_depth(g).filter(F.col("depth") >= max(warn, 3)), "id"), F.col("depth"))


# Words by which compliance rules know a function's part, as they must stand in decorators, names or paths.
HANDLER = ("action", "after_request", "api_route", "api_view", "before_request", "delete", "errorhandler", "get", "head", "options", "patch", "post", "put", "route", "websocket")
ROUTED = ("route", "api_view", "router")
DATABASE = ("query", "execute", "find", "save", "delete")
AUTH = ("auth", "permission", "verify_token", "login_required")
LOG = ("log", "logger", "audit_log", "track", "record")
EXTERNAL = ("request", "httpx", "aiohttp", "fetch")
LIMITER = ("rate_limit", "throttle", "limiter")
SENSITIVE = ("password", "secret", "token", "credential", "api_key")
OUTPUT = ("render", "respond", "send", "serialize", "to_json")
SANITISER = ("mask", "redact", "encrypt", "hash", "sanitize")
ADMIN = ("admin", "staff", "superuser")
MUTATION = ("save", "update", "delete", "create", "destroy")
AUDIT = ("log", "audit")
ERROR_HANDLER = ("error_handler", "on_error", "handle_exception", "exception_handler")
ERROR_OUTPUT = ("render", "respond", "send", "return")
SAFE_ERROR = ("safe_error", "sanitize", "mask")
INFRASTRUCTURE = ("deploy", "migrate", "provision", "teardown")
NOT_BUSINESS = ("deploy", "migrate")


def matching(g: Graph, words: tuple[str, ...]) -> DataFrame:
    return g.functions.filter(fn.holds(F.col("name"), *words))


def calling(g: Graph, words: tuple[str, ...], depth: int = 1) -> DataFrame:
    """(id): functions that call, within `depth` calls, one named so."""
    edges = g.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return within(matching(g, words), edges, depth, 1).select("id")


def steps(g: Graph, starts: DataFrame, depth: int) -> DataFrame:
    """(id, at): walks of one to `depth` calls, a row for each walk."""
    level = starts.select("id", F.col("id").alias("at"))
    edges = g.calls.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    found = None
    for _ in range(depth):
        level = level.join(edges, "at").select("id", F.col("next").alias("at"))
        found = level if found is None else found.union(level)
    return found


def handlers(g: Graph, words: tuple[str, ...] = HANDLER) -> DataFrame:
    """Functions of the project that a decorator makes a request handler."""
    return g.functions.filter(fn.any_holds(F.col("decorators"), *words) & ~F.col("is_dependency"))


def with_callee(rule: str, rows: DataFrame, g: Graph, words: tuple[str, ...]) -> DataFrame:
    """A row for each call of a function named so; the metric is its name."""
    callee = matching(g, words).select(F.col("id").alias("dst"), F.col("name").alias("metric"))
    found = rows.join(g.calls.withColumnRenamed("src", "id"), "id").join(callee, "dst")
    return found.select(F.lit(rule).alias("rule"), "id", "name", "path", "metric")


def without_metric(rule: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "id", "name", "path", F.lit(None).cast("string").alias("metric"))


def auth_bypass(g: Graph) -> DataFrame:
    """Handlers that reach the data store within three calls and no authorisation within two; a row for each walk."""
    rows = handlers(g).join(calling(g, AUTH, 2), "id", "left_anti")
    walks = steps(g, rows, 3).join(matching(g, DATABASE).select(F.col("id").alias("at"), F.col("name").alias("metric")), "at")
    return walks.join(rows.select("id", "name", "path"), "id").select(F.lit("auth_bypass").alias("rule"), "id", "name", "path", "metric")


def unlogged_endpoint(g: Graph) -> DataFrame:
    return without_metric("unlogged_endpoint", handlers(g).join(calling(g, LOG, 2), "id", "left_anti"))


def rate_limit_missing(g: Graph) -> DataFrame:
    return with_callee("rate_limit_missing", handlers(g, ROUTED).join(calling(g, LIMITER, 2), "id", "left_anti"), g, EXTERNAL)


def sensitive_data_unprotected(g: Graph) -> DataFrame:
    """Functions that call something sensitive and an output but no sanitiser; a row for each pair of the two."""
    rows = own(g).join(calling(g, SANITISER), "id", "left_anti")
    secret = g.calls.join(matching(g, SENSITIVE).select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("secrets"))
    out = g.calls.join(matching(g, OUTPUT).select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outputs"))
    pairs = rows.join(secret, "id").join(out, "id").withColumn("pair", F.explode(F.sequence(F.lit(1), F.col("secrets") * F.col("outputs"))))
    return without_metric("sensitive_data_unprotected", pairs)


def admin_action_no_audit_trail(g: Graph) -> DataFrame:
    admin = fn.any_holds(F.col("decorators"), *ADMIN) | F.col("path").contains("/admin/")
    return with_callee("admin_action_no_audit_trail", g.functions.filter(admin & ~F.col("is_dependency")).join(calling(g, AUDIT), "id", "left_anti"), g, MUTATION)


def error_handler_leaks_internals(g: Graph) -> DataFrame:
    rows = own(g).filter(fn.holds(F.col("name"), *ERROR_HANDLER)).join(calling(g, SAFE_ERROR), "id", "left_anti")
    return with_callee("error_handler_leaks_internals", rows, g, ERROR_OUTPUT)


def separation_of_duties(g: Graph) -> DataFrame:
    """(rule, path, metric): files outside tests with infrastructure functions and others that call a class; the metric counts both, the latter by distinct name."""
    inside = g.functions.filter(~F.col("path").contains(TEST_PREFIX))
    infra = inside.filter(fn.holds(F.col("name"), *INFRASTRUCTURE)).groupBy("path").agg(F.count("*").alias("infra"))
    business = inside.filter(~fn.holds(F.col("name"), *NOT_BUSINESS)).join(g.class_calls.select(F.col("src").alias("id")), "id", "left_semi").groupBy("path").agg(F.count_distinct("name").alias("business"))
    return infra.join(business, "path").select(F.lit("separation_of_duties").alias("rule"), "path", (F.col("infra") + F.col("business")).alias("metric"))


@dataclass(frozen=True)
class Rule:
    """A rule as data: what finds its offenders, with the thresholds that it takes."""

    id: str
    build: Callable[..., DataFrame]
    severity: str = "warn"  # or hard
    category: str = "complexity"
    thresholds: dict[str, float] = field(default_factory=dict)
    exempt: bool = False  # whether exemptions apply
    library_exempt: bool = False  # left out for libraries, whose users the graph does not hold
    suggestion: str = ""

    @staticmethod
    def from_sql(data: dict) -> Rule:
        """A rule from a mapping with `id` and `query`: SQL over the graph's views that returns name, path and metric; `$name` stands for a threshold."""

        def build(g: Graph, **thresholds: float) -> DataFrame:
            sql = data["query"]
            for name, value in thresholds.items():
                sql = sql.replace(f"${name}", str(value))
            for name in ("functions", "classes", "calls", "imports", "inherits", "methods", "parameters", "modules", "class_calls"):
                getattr(g, name).createOrReplaceTempView(name)
            return g.functions.sparkSession.sql(sql).withColumn("rule", F.lit(data["id"]))

        return Rule(data["id"], build, data.get("severity", "warn"), data.get("category", ""), dict(data.get("thresholds", {})), bool(data.get("exemptions")), bool(data.get("library_exempt")), data.get("suggestion", ""))


def misleading_name(g: Graph, named: vectors.Named, **thresholds: float) -> DataFrame:
    return vectors.misleading_name(named.functions, **thresholds)


def inconsistent_naming(g: Graph, named: vectors.Named, **thresholds: float) -> DataFrame:
    """A row for each pair, at its first function; the metric names the second."""
    pairs = vectors.inconsistent_naming(named.functions, **thresholds)
    other = g.functions.select(F.col("id").alias("b"), F.col("name").alias("other"))
    return pairs.join(other, "b", "left").select(F.col("a").alias("id"), F.concat_ws(" ", F.round("metric", 4), "other").alias("metric"))


def module_content_mismatch(g: Graph, named: vectors.Named, **thresholds: float) -> DataFrame:
    functions = named.functions.select("id", "behaviour").join(g.functions.select("id", "path"), "id")
    return vectors.module_mismatch(functions, named.files, **thresholds)


def suggest_better_name(g: Graph, named: vectors.Named, **thresholds: float) -> DataFrame:
    found = vectors.better_name(named.functions, **thresholds).withColumn("at", F.explode("exemplars"))
    names = found.join(g.functions.select(F.col("id").alias("at"), F.col("name").alias("like")), "at", "left")
    return names.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("like")), ", ").alias("metric"))


def named_vectors(g: Graph, provider=None) -> vectors.Named:  # noqa: ANN001
    """The vectors that naming rules read: what functions do, what they and their files are called."""
    from ..operators import hybrid

    provider = provider or hybrid.hashing_provider
    does = hybrid.embedded(g.functions, hybrid.behaviour_text(), provider).withColumnRenamed("embedding", "behaviour")
    called = hybrid.embedded(g.functions, fn.humanised(F.col("name")), provider).withColumnRenamed("embedding", "naming")
    paths = g.functions.select("path").distinct().withColumn("id", F.xxhash64("path"))
    files = hybrid.embedded(paths, fn.humanised(fn.stem(F.col("path"))), provider).withColumnRenamed("embedding", "naming")
    functions = does.join(called, "id").filter("behaviour is not null and naming is not null")
    return vectors.Named(checkpoint(functions), checkpoint(files.filter("naming is not null").join(paths, "id").select("path", "naming")))


RULES = {
    r.id: r
    for r in (
        Rule("cyclomatic_complexity", cyclomatic_complexity, "warn", "complexity", {"warn": 10}, True, suggestion="{{name}} has a complexity of {{metric_value}}: split it."),
        Rule("function_too_long", function_too_long, "warn", "complexity", {"warn": 50}, True, suggestion="{{name}} has {{metric_value}} lines: split it."),
        Rule("class_too_large", class_too_large, "warn", "complexity", {"warn": 20}, True, suggestion="{{name}} has {{metric_value}} methods: split it."),
        Rule("parameter_count", parameter_count, "warn", "complexity", {"warn": 5}, True, suggestion="{{name}} takes {{metric_value}} parameters: group them."),
        Rule("excessive_fan_out", excessive_fan_out, "warn", "coupling", {"warn": 15}, True, suggestion="{{name}} calls {{metric_value}} functions."),
        Rule("circular_imports", circular_imports, "hard", "coupling", library_exempt=True, suggestion="Break the cycle between the two files."),
        Rule("cross_file_private_access", cross_file_private_access, "warn", "coupling", {}, True, suggestion="{{name}} calls the private {{metric_value}} of another file."),
        Rule("test_import_in_prod", test_import_in_prod, "hard", "coupling", suggestion="{{path}} imports the test module {{metric_value}}."),
        Rule("shallow_pass_through", shallow_pass_through, "warn", "architecture", {"lines": 8, "complexity": 2}, suggestion="{{name}} only passes on."),
        Rule("single_adapter_seam", single_adapter_seam, "warn", "architecture", {"least": 2}, suggestion="{{name}} has {{metric_value}} adapters."),
        Rule("test_reaches_private_seam", test_reaches_private_seam, "warn", "architecture", suggestion="{{name}} tests the private {{metric_value}}."),
        Rule("wide_public_interface", wide_public_interface, "warn", "architecture", {"warn": 12}, suggestion="{{path}} has {{metric_value}} public functions."),
        Rule("unreferenced_public_function", unreferenced_public_function, "warn", "dead_code", {}, True, True, "Nothing calls {{name}}."),
        Rule("unreferenced_public_class", unreferenced_public_class, "warn", "dead_code", {}, True, True, "Nothing uses {{name}}."),
        Rule("missing_docstring", missing_docstring, "warn", "clarity", {}, True, suggestion="{{name}} has no docstring."),
        Rule("missing_public_reexport", missing_public_reexport, "warn", "clarity", {}, True, suggestion="{{name}} is called but its package does not export it."),
        Rule("deep_inheritance", deep_inheritance, "warn", "inheritance", {"warn": 4}, suggestion="{{name}} is {{metric_value}} levels deep."),
        Rule("auth_bypass", auth_bypass, "hard", "compliance", suggestion="{{name}} reaches {{metric_value}} without authorisation."),
        Rule("unlogged_endpoint", unlogged_endpoint, "warn", "compliance", suggestion="{{name}} does not log."),
        Rule("rate_limit_missing", rate_limit_missing, "warn", "compliance", suggestion="{{name}} calls {{metric_value}} without a limit."),
        Rule("sensitive_data_unprotected", sensitive_data_unprotected, "hard", "compliance", suggestion="{{name}} may put out what is secret."),
        Rule("admin_action_no_audit_trail", admin_action_no_audit_trail, "hard", "compliance", suggestion="{{name}} calls {{metric_value}} and leaves no trail."),
        Rule("error_handler_leaks_internals", error_handler_leaks_internals, "warn", "compliance", suggestion="{{name}} may leak through {{metric_value}}."),
        Rule("separation_of_duties", separation_of_duties, "warn", "compliance", suggestion="{{path}} mixes infrastructure and business."),
        Rule("misleading_name", misleading_name, "warn", "naming", {"warn": 0.15}, True, suggestion="{{name}} does not say what it does."),
        Rule("inconsistent_naming", inconsistent_naming, "warn", "naming", {"behaviour_similarity": 0.85, "name_dissimilarity": 0.5}, True, suggestion="{{name}} does what another does by another name: {{metric_value}}."),
        Rule("module_content_mismatch", module_content_mismatch, "warn", "naming", {"warn": 0.3}, True, suggestion="{{path}} holds something else than its name says."),
        Rule("suggest_better_name", suggest_better_name, "warn", "naming", {"self_low": 0.4, "exemplar_high": 0.7, "max_exemplars": 3}, True, suggestion="Name {{name}} like {{metric_value}}."),
    )
}

#: What each preset sets: categories, severities that override a rule's, and rules that are hard.
HARD_STOP = ("circular_imports", "test_import_in_prod", "cross_file_private_access")
PRESETS = {
    "default": {"hard_stop": HARD_STOP},
    "strict": {"hard_stop": (*HARD_STOP, "class_too_large", "cyclomatic_complexity", "excessive_fan_out")},
    "soc2": {"categories": ("coupling", "compliance"), "hard_stop": (*HARD_STOP, "auth_bypass", "sensitive_data_unprotected", "admin_action_no_audit_trail")},
    "minimal": {"categories": ("coupling",), "hard_stop": HARD_STOP},
}


@dataclass(frozen=True)
class Settings:
    """How an audit departs from its rules. What is set here wins over the preset."""

    profile: str = "default"
    categories: tuple[str, ...] = ("all",)
    overrides: dict[str, str] = field(default_factory=dict)  # rule -> off, warn or hard
    hard_stop: tuple[str, ...] = ()
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    library: bool = False
    exempt_paths: tuple[str, ...] = ("**/tests/**", "**/test/**", "**/*_test.*", "**/__pycache__/**", "**/node_modules/**", "**/vendor/**", "**/.venv/**")
    exempt_decorators: tuple[str, ...] = ("pytest.fixture", "app.route", "typer.command", "click.command", "dataclass", "property", "staticmethod", "classmethod", "abstractmethod")


def selected(settings: Settings = Settings(), rules: dict[str, Rule] | None = None) -> list[Rule]:
    """The rules that an audit runs, with the severities and thresholds that hold for it."""
    preset = PRESETS.get(settings.profile, {})
    categories = preset.get("categories", ("all",)) if settings.categories == ("all",) else settings.categories
    hard = {*preset.get("hard_stop", ()), *settings.hard_stop}
    out = []
    for rule in (RULES if rules is None else rules).values():
        override = settings.overrides.get(rule.id)
        if override == "off" or settings.library and rule.library_exempt or "all" not in categories and rule.category not in categories:
            continue
        severity = rule.severity if override is None else "hard" if override in ("hard", "blocker", "critical") else "warn"
        out.append(replace(rule, severity="hard" if rule.id in hard else severity, thresholds=rule.thresholds | settings.thresholds.get(rule.id, {})))
    return out


def spared(g: Graph, rows: DataFrame, settings: Settings) -> DataFrame:
    """Offenders that neither their path nor a decorator exempts."""
    rows = rows.filter(~fn.holds(F.col("path"), *(x for x in map(fn.glob_fragment, settings.exempt_paths) if x)))
    if "id" not in rows.columns or not settings.exempt_decorators:
        return rows
    exempt = g.functions.filter(F.arrays_overlap("decorators", F.array(*map(F.lit, settings.exempt_decorators)))).select("id")
    return rows.join(exempt, "id", "left_anti")


def written(g: Graph, chosen: list[Rule]) -> Graph:
    """The graph with what many rules read each written once."""
    read = ("functions", "classes", "calls", "imports", "class_calls", "methods", "inherits")
    if all(rule.category == "naming" for rule in chosen):
        read = ("functions",)  # all that rules on names read of the graph
    return replace(g, **{name: checkpoint(getattr(g, name)) for name in read})


def offending(g: Graph, rule: Rule, settings: Settings, scope: tuple[str, ...], embeddings: vectors.Named | None) -> DataFrame:
    """(rule, severity, category, name, path, metric, suggestion): the offenders of one rule."""
    rows = rule.build(g, *([embeddings] if rule.category == "naming" else []), **rule.thresholds)
    if rule.id == "circular_imports":
        rows = rows.withColumn("path", F.col("file_a")).withColumn("metric", F.col("file_b"))
    if "path" not in rows.columns and "id" in rows.columns:
        rows = rows.join(g.functions.select("id", "name", "path").drop(*set(rows.columns) - {"id"}), "id", "left")
    if rule.exempt:
        rows = spared(g, rows, settings)
    if scope:
        inside = F.lit(False)
        for one in scope:
            inside |= fn.in_scope(F.col("path"), one)
        rows = rows.filter(inside)
    name = F.col("name") if "name" in rows.columns else F.lit(None)
    metric = F.col("metric") if "metric" in rows.columns else F.col("n") if "n" in rows.columns else F.lit(None)
    rows = rows.select(name.cast("string").alias("name"), "path", metric.cast("string").alias("metric"))
    said = fn.suggestion(F.lit(rule.suggestion), {"name": F.col("name"), "path": F.col("path"), "metric_value": F.col("metric")})
    return rows.select(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"), "name", "path", "metric", said.alias("suggestion"))


def runnable(settings: Settings, embeddings: vectors.Named | None, rules: dict[str, Rule] | None) -> list[Rule]:
    """The selected rules but those on names where there are no vectors."""
    return [r for r in selected(settings, rules) if r.category != "naming" or embeddings is not None]


def findings(g: Graph, settings: Settings = Settings(), scope: tuple[str, ...] = (), embeddings: vectors.Named | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(rule, severity, category, name, path, metric, suggestion): the offenders of all selected rules, within some files or folders if given."""
    g = written(g, selected(settings, rules))
    out = None
    for rule in runnable(settings, embeddings, rules):
        one = offending(g, rule, settings, scope, embeddings)
        out = one if out is None else out.union(one)
    return out


def audit(g: Graph, settings: Settings = Settings(), scope: tuple[str, ...] = (), embeddings: vectors.Named | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(rule, severity, offenders): counts of each rule that was run. Rules without offenders count 0. Each rule is a plan of its own, counted before the next one is made: the driver holds the plan and tasks of one rule, not of all."""
    chosen = runnable(settings, embeddings, rules)
    g = written(g, selected(settings, rules))
    counts = [(r.id, r.severity, offending(g, r, settings, scope, embeddings).count()) for r in chosen]
    return g.functions.sparkSession.createDataFrame(counts, "rule string, severity string, offenders long")


def gate(counted: DataFrame) -> DataFrame:
    """(warn, hard, hard_zero): how many rules of either severity fired, and whether none of the hard ones did."""
    fired = F.col("offenders") > 0
    rows = counted.agg(F.count(F.when(fired & (F.col("severity") == "warn"), 1)).alias("warn"), F.count(F.when(fired & (F.col("severity") == "hard"), 1)).alias("hard"))
    return rows.withColumn("hard_zero", F.col("hard") == 0)


# Names, paths and decorators of the warehouse's functions and classes, made to look like source code.
ADJECTIVES = {"blue": "render", "cold": "on_error", "hot": "get", "large": "log", "new": "migrate", "old": "delete", "red": "token", "small": "sanitize"}
NOUNS = {"anvil": "auth", "bolt": "query", "gear": "fetch", "gizmo": "hash", "plate": "limiter", "ring": "save", "rod": "password", "widget": "view"}


def coded(g: Graph) -> Graph:
    name = F.replace(F.col("name"), F.lit(" "), F.lit("_"))
    for word, code in {**ADJECTIVES, **NOUNS}.items():
        name = F.replace(name, F.lit(word), F.lit(code))
    name = F.when(F.col("id") % 9 == 0, F.concat(F.lit("_"), name)).otherwise(name)

    def moved(path: Column) -> Column:
        folder = F.regexp_replace(path, "[^/]+$", "")
        kinds = F.col("id") % 16
        return F.when(kinds == 3, F.replace(path, F.lit("/src/"), F.lit("/src/tests/"))).when(kinds == 4, F.regexp_replace(path, "([^/]+)$", "test_$1")).when(kinds == 5, F.replace(path, F.lit("/src/"), F.lit("/src/admin/"))).when(kinds == 6, F.concat(folder, F.lit(INIT))).otherwise(path)

    functions = g.functions.withColumn("name", name).withColumn("path", moved(F.col("path")))
    seam = F.when(F.col("id") % 11 == 0, F.concat("name", F.lit("Protocol"))).when(F.col("id") % 11 == 1, F.concat(F.lit("Base"), "name")).when(F.col("id") % 11 == 2, F.concat(F.lit("_"), "name")).otherwise(F.col("name"))
    classes = g.classes.withColumn("name", seam).withColumn("path", F.when(F.col("id") % 17 == 0, F.replace("path", F.lit("/src/"), F.lit("/src/tests/"))).otherwise(F.col("path")))
    parts = functions.select(F.col("id").alias("module_id"), F.col("name").alias("part_name"))
    imports = g.imports.join(parts, "module_id", "left").withColumn("imported_name", F.when(F.col("module_id") % 7 == 3, F.concat(F.lit("test_"), "imported_name")).otherwise(F.coalesce("part_name", "imported_name"))).drop("part_name")
    imports = imports.withColumn("path", F.when(F.col("module_id") % 5 == 0, F.regexp_replace("path", "[^/]+$", INIT)).otherwise(F.col("path")))
    return replace(g, functions=functions, classes=classes, imports=imports)


_OWN = "own AS (SELECT * FROM functions WHERE NOT is_dependency AND NOT contains(path, '/tests/'))"


def _rule(rule: str, rows: str, metric: str) -> str:
    return f"+{_OWN} SELECT '{rule}' AS rule, id, name, path, CAST({metric} AS BIGINT) AS metric FROM {rows}"


def _words(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _decorated(words: tuple[str, ...], of: str = "f") -> str:
    return f"len(list_filter({of}.decorators, lambda d: {_words('d', words)})) > 0"


def _no_call(words: tuple[str, ...], depth: int) -> str:
    two = f" UNION ALL SELECT 1 FROM calls e1 JOIN calls e2 ON e2.src = e1.dst JOIN fx t ON t.id = e2.dst WHERE e1.src = f.id AND {_words('t.name', words)}" if depth == 2 else ""
    return f"f.id NOT IN (SELECT e.src FROM calls e JOIN fx t ON t.id = e.dst WHERE {_words('t.name', words)}{two.replace('SELECT 1', 'SELECT e1.src').replace('WHERE e1.src = f.id AND', 'WHERE')})"


def _nested(column: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


_SITES = "(SELECT c.src, c.dst, s.name AS src_name, s.path AS src_path, s.is_dependency AS src_dep, t.name AS dst_name, t.path AS dst_path FROM calls c JOIN functions s ON s.id = c.src JOIN functions t ON t.id = c.dst)"
#: The coded tables, and calls with both ends.
_CODED = f"""+fx AS (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN '_' ELSE '' END || {_nested("replace(name, ' ', '_')", {**ADJECTIVES, **NOUNS})} AS name,
 CASE id % 16 WHEN 3 THEN replace(path, '/src/', '/src/tests/') WHEN 4 THEN regexp_replace(path, '([^/]*)$', 'test_\\1') WHEN 5 THEN replace(path, '/src/', '/src/admin/') WHEN 6 THEN regexp_replace(path, '[^/]*$', '__init__.py') ELSE path END AS path) FROM functions),
cx AS (SELECT * REPLACE (CASE id % 11 WHEN 0 THEN name || 'Protocol' WHEN 1 THEN 'Base' || name WHEN 2 THEN '_' || name ELSE name END AS name, CASE WHEN id % 17 = 0 THEN replace(path, '/src/', '/src/tests/') ELSE path END AS path) FROM classes),
ix AS (SELECT CASE WHEN module_id % 5 = 0 THEN regexp_replace(imports.path, '[^/]*$', '__init__.py') ELSE imports.path END AS path, module_id, CASE WHEN module_id % 7 = 3 THEN 'test_' || imported_name ELSE coalesce(fx.name, imported_name) END AS imported_name FROM imports LEFT JOIN fx ON fx.id = module_id),
sites AS (SELECT s.id AS id, s.name, s.path, s.is_dependency AS dep, t.id AS dst, t.name AS to_name, t.path AS to_path, t.is_dependency AS to_dep FROM calls c JOIN fx s ON s.id = c.src JOIN fx t ON t.id = c.dst)"""


def _on_coded(rule: str, select: str) -> str:
    return f"{_CODED} SELECT '{rule}' AS rule, {select}"


def _register(name: str, build, sql: str, on_coded: bool = False) -> None:
    def run(g: Graph) -> DataFrame:
        return build(coded(g) if on_coded else g)

    run.__name__ = f"rule_{name}"
    on_graph(sql)(run)


SELECTS: dict[str, str] = {}
for _name, _build, _select in (
    ("cross_file_private_access", cross_file_private_access, "id, name, path, to_name AS metric FROM sites WHERE starts_with(to_name, '_') AND path <> to_path AND NOT dep AND NOT to_dep AND NOT contains(path, '/tests/')"),
    ("test_import_in_prod", test_import_in_prod, "i.path, imported_name AS metric FROM ix i LEFT JOIN modules m ON m.id = i.module_id WHERE NOT contains(i.path, '/tests/') AND NOT contains(i.path, '/test/') AND i.path NOT IN (SELECT path FROM fx WHERE is_dependency) AND (contains(coalesce(m.path, ''), '/tests/') OR contains(coalesce(m.path, ''), '/test/') OR contains(imported_name, 'test_'))"),
    ("single_adapter_seam", single_adapter_seam, "c.id, c.name, c.path, count(DISTINCT i.child) AS metric FROM cx c LEFT JOIN inherits i ON i.parent = c.id WHERE NOT c.is_dependency AND NOT contains(c.path, '/tests/') AND regexp_matches(c.name, '(Protocol|Interface|Port)$|^(Base|Abstract)') GROUP BY ALL HAVING count(DISTINCT i.child) < 2"),
    ("test_reaches_private_seam", test_reaches_private_seam, "id, name, path, to_name AS metric FROM sites WHERE (contains(path, '/tests/') OR contains(path, '/test_')) AND starts_with(to_name, '_') AND NOT contains(to_path, '/tests/') AND NOT contains(to_path, '/test_') AND NOT to_dep"),
    ("unreferenced_public_class", unreferenced_public_class, "id, name, path, 0::BIGINT AS metric FROM cx c WHERE NOT is_dependency AND NOT starts_with(name, '_') AND NOT contains(path, '/tests/') AND id NOT IN (SELECT parent FROM inherits) AND NOT EXISTS (SELECT 1 FROM methods m JOIN sites s ON s.dst = m.function_id WHERE m.class_id = c.id AND s.path <> c.path AND NOT s.dep)"),
    ("missing_docstring", missing_docstring, "id, name, path, 0::BIGINT AS metric FROM fx WHERE NOT is_dependency AND NOT contains(path, '/tests/') AND docstring = '' AND NOT list_contains(decorators, '@overload') AND NOT list_contains(decorators, '@abstractmethod') AND ends_with(path, '.py') AND NOT starts_with(name, '_')"),
    ("missing_public_reexport", missing_public_reexport, """f.id, f.name, f.path, 0::BIGINT AS metric FROM fx f WHERE NOT starts_with(f.name, '_') AND NOT f.is_dependency AND NOT contains(f.path, '/tests/') AND NOT contains(f.path, '/test_') AND NOT contains(f.path, '__init__')
 AND EXISTS (SELECT 1 FROM sites WHERE dst = f.id AND NOT dep)
 AND f.id IN (SELECT g.id FROM fx g JOIN (SELECT path FROM fx UNION SELECT path FROM cx UNION SELECT path FROM ix) u ON ends_with(u.path, '__init__.py') AND starts_with(g.path, replace(u.path, '__init__.py', '')))
 AND f.id NOT IN (SELECT g.id FROM fx g JOIN ix i ON ends_with(i.path, '__init__.py') AND starts_with(g.path, replace(i.path, '__init__.py', '')) JOIN modules m ON m.id = i.module_id WHERE contains(i.imported_name, g.name) OR contains(m.full_import_name, g.name))"""),
    ("auth_bypass", auth_bypass, f"f.id, f.name, f.path, t.name AS metric FROM fx f JOIN (SELECT src, dst AS node FROM calls UNION ALL SELECT a.src, b.dst FROM calls a JOIN calls b ON b.src = a.dst UNION ALL SELECT a.src, c.dst FROM calls a JOIN calls b ON b.src = a.dst JOIN calls c ON c.src = b.dst) w ON w.src = f.id JOIN fx t ON t.id = w.node WHERE {_decorated(HANDLER)} AND {_words('t.name', DATABASE)} AND NOT f.is_dependency AND {_no_call(AUTH, 2)}"),
    ("unlogged_endpoint", unlogged_endpoint, f"f.id, f.name, f.path, NULL::VARCHAR AS metric FROM fx f WHERE {_decorated(HANDLER)} AND NOT f.is_dependency AND {_no_call(LOG, 2)}"),
    ("rate_limit_missing", rate_limit_missing, f"f.id, f.name, f.path, s.to_name AS metric FROM fx f JOIN sites s ON s.id = f.id WHERE {_decorated(ROUTED)} AND {_words('s.to_name', EXTERNAL)} AND NOT f.is_dependency AND {_no_call(LIMITER, 2)}"),
    ("sensitive_data_unprotected", sensitive_data_unprotected, f"f.id, f.name, f.path, NULL::VARCHAR AS metric FROM fx f JOIN sites s ON s.id = f.id JOIN sites o ON o.id = f.id WHERE {_words('s.to_name', SENSITIVE)} AND {_words('o.to_name', OUTPUT)} AND NOT f.is_dependency AND NOT contains(f.path, '/tests/') AND {_no_call(SANITISER, 1)}"),
    ("admin_action_no_audit_trail", admin_action_no_audit_trail, f"f.id, f.name, f.path, s.to_name AS metric FROM fx f JOIN sites s ON s.id = f.id WHERE ({_decorated(ADMIN)} OR contains(f.path, '/admin/')) AND {_words('s.to_name', MUTATION)} AND NOT f.is_dependency AND {_no_call(AUDIT, 1)}"),
    ("error_handler_leaks_internals", error_handler_leaks_internals, f"f.id, f.name, f.path, s.to_name AS metric FROM fx f JOIN sites s ON s.id = f.id WHERE {_words('f.name', ERROR_HANDLER)} AND {_words('s.to_name', ERROR_OUTPUT)} AND NOT f.is_dependency AND NOT contains(f.path, '/tests/') AND {_no_call(SAFE_ERROR, 1)}"),
    ("separation_of_duties", separation_of_duties, f"i.path, i.n + b.n AS metric FROM (SELECT path, count(*) AS n FROM fx WHERE {_words('name', INFRASTRUCTURE)} AND NOT contains(path, '/tests/') GROUP BY path) i JOIN (SELECT path, count(DISTINCT name) AS n FROM fx WHERE NOT {_words('name', NOT_BUSINESS)} AND id IN (SELECT src FROM class_calls) GROUP BY path) b USING (path)"),
):
    SELECTS[_name] = _select
    _register(_name, _build, _on_coded(_name, _select), on_coded=True)

for _name, _build, _sql in (
    ("cyclomatic_complexity", cyclomatic_complexity, _rule("cyclomatic_complexity", "own WHERE complexity > 10", "complexity")),
    ("function_too_long", lambda g: function_too_long(g, 40), _rule("function_too_long", "own WHERE end_line - line_number > 40", "end_line - line_number")),
    ("class_too_large", lambda g: class_too_large(g, 1), "SELECT 'class_too_large' AS rule, c.id, c.name, c.path, count(*) AS metric FROM classes c JOIN methods m ON m.class_id = c.id WHERE NOT c.is_dependency GROUP BY ALL HAVING count(*) > 1"),
    ("parameter_count", parameter_count, _rule("parameter_count", "(SELECT o.id, o.name, o.path, count(*) AS n FROM own o JOIN parameters p ON p.function_id = o.id WHERE NOT starts_with(o.name, '__') GROUP BY ALL HAVING count(*) > 5)", "n")),
    ("excessive_fan_out", lambda g: excessive_fan_out(g, 2), _rule("excessive_fan_out", "(SELECT o.id, o.name, o.path, count(DISTINCT c.dst) AS n FROM own o JOIN calls c ON c.src = o.id GROUP BY ALL HAVING count(DISTINCT c.dst) > 2)", "n")),
    ("circular_imports", circular_imports, f"SELECT DISTINCT a.src_path AS file_a, a.dst_path AS file_b FROM {_SITES} a JOIN {_SITES} b ON b.src_path = a.dst_path AND b.dst_path = a.src_path WHERE a.src_path < a.dst_path"),
    ("shallow_pass_through", lambda g: shallow_pass_through(g, 30, 12), _rule("shallow_pass_through", f"(SELECT o.id, o.name, o.path, s.n FROM own o JOIN (SELECT dst, count(DISTINCT src) AS n FROM {_SITES} WHERE src_path <> dst_path GROUP BY dst HAVING count(DISTINCT src) >= 2) s ON s.dst = o.id WHERE end_line - line_number <= 30 AND complexity <= 12 AND (SELECT count(DISTINCT dst) FROM calls WHERE src = o.id) = 1)", "n")),
    ("wide_public_interface", wide_public_interface, f"+{_OWN} SELECT path, count(DISTINCT id) AS n FROM own WHERE NOT starts_with(name, '_') GROUP BY path HAVING count(DISTINCT id) > 12"),
    ("unreferenced_public_function", unreferenced_public_function, _rule("unreferenced_public_function", "own o WHERE NOT starts_with(name, '_') AND NOT EXISTS (SELECT 1 FROM calls c JOIN functions s ON s.id = c.src WHERE c.dst = o.id AND NOT s.is_dependency)", "0")),
    ("deep_inheritance", deep_inheritance, "+h AS (SELECT DISTINCT child, parent FROM inherits), r AS (SELECT DISTINCT child AS id, 1 AS depth FROM h WHERE parent NOT IN (SELECT child FROM h) UNION SELECT h.child, depth + 1 FROM r JOIN h ON h.parent = r.id WHERE depth < 30) SELECT 'deep_inheritance' AS rule, c.id, c.name, c.path, CAST(max(depth) AS BIGINT) AS metric FROM r JOIN classes c USING (id) WHERE NOT c.is_dependency GROUP BY ALL HAVING max(depth) >= 4"),
):
    _register(_name, _build, _sql)


def health(counted: DataFrame) -> DataFrame:
    """(score, grade): 100 less what each rule's offenders cost; a hard offender bars the best grade."""
    hard = F.col("severity") == "hard"
    cost = F.when(hard, F.least(F.col("offenders") * 8, F.lit(40))).otherwise(F.least(F.col("offenders") * 2, F.lit(15)))
    total = counted.agg(F.greatest(100 - F.sum(cost), F.lit(0)).cast("long").alias("score"), F.max(hard & (F.col("offenders") > 0)).alias("barred"))
    score = F.col("score")
    grade = F.when((score >= 90) & ~F.col("barred"), "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return total.select("score", grade.alias("grade"))


#: All rules of the graph on the coded tables, with a lower bar where none would offend.
AUDITED = Settings(thresholds={"cyclomatic_complexity": {"warn": 18}, "function_too_long": {"warn": 49}, "class_too_large": {"warn": 1}, "excessive_fan_out": {"warn": 2}, "shallow_pass_through": {"lines": 30, "complexity": 12}})


def _audit_sql() -> str:
    """Counts of each rule, from the SQL of the registered rules over the coded tables, with exemptions."""
    spared = "NOT contains(path, 'tests') AND NOT contains(path, 'test') AND NOT contains(path, '_test.') AND NOT contains(path, '__pycache__') AND NOT contains(path, 'node_modules') AND NOT contains(path, 'vendor') AND NOT contains(path, '.venv')"
    mine = "ox AS (SELECT * FROM fx WHERE NOT is_dependency AND NOT contains(path, '/tests/'))"
    rows = {
        "cyclomatic_complexity": "SELECT path FROM ox WHERE complexity > 18",
        "function_too_long": "SELECT path FROM ox WHERE end_line - line_number > 49",
        "class_too_large": "SELECT c.path FROM cx c JOIN methods m ON m.class_id = c.id WHERE NOT c.is_dependency GROUP BY c.id, c.path HAVING count(*) > 1",
        "parameter_count": "SELECT o.path FROM ox o JOIN parameters p ON p.function_id = o.id WHERE NOT starts_with(o.name, '__') GROUP BY o.id, o.path HAVING count(*) > 5",
        "excessive_fan_out": "SELECT o.path FROM ox o JOIN calls c ON c.src = o.id GROUP BY o.id, o.path HAVING count(DISTINCT c.dst) > 2",
        "circular_imports": "SELECT DISTINCT a.path, a.to_path FROM sites a JOIN sites b ON b.path = a.to_path AND b.to_path = a.path WHERE a.path < a.to_path",
        "shallow_pass_through": "SELECT o.path FROM ox o JOIN (SELECT dst, count(DISTINCT id) AS n FROM sites WHERE path <> to_path GROUP BY dst HAVING count(DISTINCT id) >= 2) s ON s.dst = o.id WHERE end_line - line_number <= 30 AND complexity <= 12 AND o.id IN (SELECT src FROM calls GROUP BY src HAVING count(DISTINCT dst) = 1)",
        "wide_public_interface": "SELECT path FROM ox WHERE NOT starts_with(name, '_') GROUP BY path HAVING count(DISTINCT id) > 12",
        "unreferenced_public_function": "SELECT path FROM ox o WHERE NOT starts_with(name, '_') AND id NOT IN (SELECT dst FROM sites WHERE NOT dep)",
        "deep_inheritance": "SELECT c.path FROM (SELECT id FROM r GROUP BY id HAVING max(depth) >= 4) JOIN cx c USING (id) WHERE NOT c.is_dependency",
    }
    for name in SELECTS:
        rows[name] = f"SELECT {SELECTS[name]}"
    chosen = selected(AUDITED)
    depth = "h AS (SELECT DISTINCT child, parent FROM inherits), r AS (SELECT DISTINCT child AS id, 1 AS depth FROM h WHERE parent NOT IN (SELECT child FROM h) UNION SELECT h.child, depth + 1 FROM r JOIN h ON h.parent = r.id WHERE depth < 30)"
    counts = " UNION ALL ".join(f"SELECT '{r.id}' AS rule, '{r.severity}' AS severity, (SELECT count(*) FROM ({rows[r.id]}) z{' WHERE ' + spared if r.exempt else ''}) AS offenders" for r in chosen if r.category != "naming")
    return f"{_CODED}, {mine}, {depth}, counted AS ({counts})"


_COUNTS = _audit_sql()


@on_graph(f"{_COUNTS} SELECT * FROM counted")
def audit_counts(g: Graph) -> DataFrame:
    return audit(coded(g), AUDITED)


@on_graph(f"{_COUNTS} SELECT count(*) FILTER (severity = 'warn' AND offenders > 0) AS warn, count(*) FILTER (severity = 'hard' AND offenders > 0) AS hard, count(*) FILTER (severity = 'hard' AND offenders > 0) = 0 AS hard_zero FROM counted")
def audit_gate(g: Graph) -> DataFrame:
    return gate(audit(coded(g), AUDITED))


@on_graph(f"""{_COUNTS}, s AS (SELECT greatest(100 - sum(CASE severity WHEN 'hard' THEN least(offenders * 8, 40) ELSE least(offenders * 2, 15) END), 0) AS score, bool_or(severity = 'hard' AND offenders > 0) AS barred FROM counted)
SELECT CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 AND NOT barred THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score(g: Graph) -> DataFrame:
    return health(audit(coded(g), AUDITED))


PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def calibration(rows: DataFrame, current: int) -> DataFrame:
    """(q, value, threshold, violations): percentiles of a rule's metric, the rounded-up threshold each suggests and how many rows exceed it; q 0 is the current threshold."""
    found = rows.agg(F.percentile("metric", F.array(*map(F.lit, PERCENTILES))).alias("v")).select(F.posexplode("v").alias("k", "value"))
    found = found.select(F.element_at(F.array(*map(F.lit, PERCENTILES)), F.col("k") + 1).alias("q"), "value", F.ceil("value").cast("long").alias("threshold"))
    found = found.union(found.sparkSession.range(1).select(F.lit(0.0), F.lit(float(current)), F.lit(current).cast("long")))
    # counts by the number of thresholds that a metric exceeds, in one pass: at most eight of them
    limits = F.broadcast(found.agg(F.array_sort(F.collect_list("threshold")).alias("limits")))
    exceeded = rows.select("metric").crossJoin(limits).groupBy(F.expr("size(filter(limits, x -> x < metric))").alias("k")).agg(F.count("*").alias("n"))
    ranked = found.withColumn("place", F.row_number().over(Window.orderBy("threshold", "q")))
    return ranked.join(F.broadcast(exceeded.agg(F.collect_list(F.struct("k", "n")).alias("counts"))), F.lit(True)).select("q", "value", "threshold", F.expr("aggregate(filter(counts, c -> c.k >= (place + 0)), 0L, (a, c) -> a + c.n)").alias("violations"))


@on_graph(f"""+{_OWN}, q AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q, unnest(quantile_cont(complexity::DOUBLE, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS value FROM own WHERE complexity > 0),
t AS (SELECT q, value, CAST(ceil(value) AS BIGINT) AS threshold FROM q UNION ALL SELECT 0, 10, 10)
SELECT q, value, threshold, (SELECT count(*) FROM own WHERE complexity > 0 AND complexity > threshold) AS violations FROM t""")
def audit_calibration(g: Graph) -> DataFrame:
    return calibration(cyclomatic_complexity(g, 0), 10)


@on_graph(f"+{_OWN} SELECT id, name, path, CAST(complexity AS BIGINT) AS metric FROM own WHERE complexity > 10 AND contains(path, '/brand_13/') ORDER BY metric DESC, id LIMIT 20")
def audit_scope(g: Graph) -> DataFrame:
    rows = cyclomatic_complexity(g).filter(fn.in_scope(F.col("path"), "brand_13"))
    return top(rows.select("id", "name", "path", "metric"), 20, F.desc("metric"), "id")


#: Thresholds at which the warehouse's vectors have offenders.
NAMING = {"misleading_name": {"warn": -0.1}, "inconsistent_naming": {"behaviour_similarity": 0.3, "name_dissimilarity": 0.0}, "module_content_mismatch": {"warn": 0.0}, "suggest_better_name": {"self_low": 0.0, "exemplar_high": 0.1, "behaviour": 0.2}}


def warehouse_vectors(spark: SparkSession, sf_dir: str, g: Graph) -> vectors.Named:
    """Vectors by the ids of functions; a file's name has the vector of its first function's."""
    rows = vectors.with_names(spark, sf_dir).join(g.functions.select("id"), "id", "left_semi")
    files = g.functions.join(rows, "id").groupBy("path").agg(F.min_by("naming", "id").alias("naming"))
    return vectors.Named(rows, files)


_NAMED = f"""{vectors._UNITS}, f AS (SELECT p_partkey AS id, '/src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '.py' AS path FROM part), k AS (SELECT * FROM u WHERE vec_id IN (SELECT id FROM f)), n AS (SELECT k.*, path FROM k JOIN f ON f.id = k.vec_id),
m AS (SELECT path, arg_min(naming, vec_id) AS naming FROM n GROUP BY path),
c AS (SELECT path, list(x ORDER BY i) AS mean FROM (SELECT path, i, avg(v) AS x FROM (SELECT path, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings e JOIN f ON f.id = e.vec_id) GROUP BY path, i) GROUP BY path),
s AS (SELECT *, list_inner_product(behaviour, naming) AS own FROM k)"""


@on_tables(f"""WITH {_NAMED} SELECT 'misleading_name' AS rule, 'warn' AS severity, count(*) AS offenders FROM s JOIN f ON f.id = s.vec_id WHERE own < -0.1
UNION ALL SELECT 'inconsistent_naming', 'warn', count(*) FROM k a JOIN k b ON a.vec_id < b.vec_id WHERE list_inner_product(a.behaviour, b.behaviour) >= 0.3 AND list_inner_product(a.naming, b.naming) < 0.0
UNION ALL SELECT 'module_content_mismatch', 'warn', count(*) FROM m JOIN c USING (path) WHERE list_cosine_similarity(naming, mean) < 0.0
UNION ALL SELECT 'suggest_better_name', 'warn', count(DISTINCT a.vec_id) FROM s a JOIN s b ON a.own < 0.0 AND b.own > 0.1 AND list_inner_product(a.behaviour, b.behaviour) > 0.2 JOIN f ON f.id = a.vec_id""")
def audit_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naming rules through the registry, as any audit that is given vectors runs them."""
    g = load(spark, sf_dir)
    return audit(g, Settings(categories=("naming",), thresholds=NAMING, exempt_paths=(), exempt_decorators=()), embeddings=warehouse_vectors(spark, sf_dir, g))

"""Scans of source trees: which files count, and in which language they are."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..registry import on_tables

#: Extension -> language. Fixed values.
LANGUAGES = {
    "py": "python", "ipynb": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescriptjsx", "go": "go", "rs": "rust", "c": "c", "h": "cpp", "cpp": "cpp", "hpp": "cpp", "hh": "cpp",
    "java": "java", "rb": "ruby", "cs": "csharp", "php": "php", "kt": "kotlin", "scala": "scala", "sc": "scala", "swift": "swift", "hs": "haskell", "dart": "dart", "pl": "perl", "pm": "perl", "ex": "elixir", "exs": "elixir",
}
# Files that carry structure though no parser reads them, by extension, name and beginning of a name.
STRUCTURAL = ("proto", "graphql", "gql", "prisma", "sql")
NAMES = (
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "requirements-dev.txt", "Pipfile", "Pipfile.lock", "package.json", "tsconfig.json", "Cargo.toml", "go.mod", "go.sum", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle",
    "settings.gradle.kts", "Gemfile", "Gemfile.lock", "composer.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "GNUmakefile", "CMakeLists.txt", "Taskfile.yml", "Taskfile.yaml", "justfile", "Justfile", ".eslintrc",
    ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", ".prettierrc", ".prettierrc.js", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.yaml", "ruff.toml", ".ruff.toml", "mypy.ini", ".mypy.ini",
    "pyrightconfig.json", ".flake8", ".rubocop.yml", ".golangci.yml", ".golangci.yaml",
)
PREFIXES = ("tsconfig.", "requirements-", "Dockerfile.", "docker-compose.")


def language(path: Column) -> Column:
    """The language of a path by its extension, null if none is known."""
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.regexp_extract(fn.basename(path), r"\.([^.]+)$", 1)))


def pattern_regex(pattern: str) -> str:
    """One ignore pattern as an expression on relative paths."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    body = "".join(
        ".*/" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part) if not part.startswith("[") else fnmatch.translate(part).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
        for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^]]+\]|[^*?\[]+|\[", body)
    )
    return ("^" if anchored else "(?:^|/)") + body + ("/" if pattern.endswith("/") else "(?:/|$)")


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns leave a path out; a later pattern wins, `!` takes back."""
    out = F.lit(False)
    for pattern in patterns:
        pattern = pattern.strip()
        if not pattern or pattern.startswith("#"):
            continue
        back = pattern.startswith("!")
        out = F.when(relative.rlike(pattern_regex(pattern.lstrip("!"))), F.lit(not back)).otherwise(out)
    return out


def code_or_structural(path: Column) -> Column:
    """Whether a parser reads a file, or its name says that it shapes the project."""
    name = fn.basename(path)
    kept = F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*LANGUAGES, *STRUCTURAL) | name.isin(*NAMES)
    for prefix in PREFIXES:
        kept |= name.startswith(prefix)
    return kept


def scan(spark: SparkSession, root: str, patterns: list[str] = (), code_only: bool = True) -> DataFrame:
    """(path, relative, language, text) of the files below root; empty files, which hold nothing, are not listed.

    Paths are listed and filtered first; contents are read of the files that are left.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root.removeprefix("file:").rstrip("/") + "/"
    relative = F.element_at(F.split(F.regexp_replace("path", "^file:/*", "/"), re.escape(base)), -1)
    listed = listed.withColumn("relative", relative).filter((F.col("length") > 0) & ~fn.under(F.concat(F.lit("/"), F.lower("relative"))) & ~ignored(F.col("relative"), list(patterns)))
    if code_only:
        listed = listed.filter(code_or_structural(F.col("path")))
    rows = listed.select("path", "relative", "length")
    wanted = rows.select("path").distinct()
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # a listing of names only decides which folders are opened at all
    folders = [r.folder for r in wanted.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().limit(MOST_FOLDERS + 1).collect()]
    found = content.load(root) if len(folders) > MOST_FOLDERS else spark.read.format("binaryFile").load(folders) if folders else content.load(root)
    return found.select("path", "content").join(rows, "path").select("path", "relative", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text"))


#: Folders that a scan opens one by one; beyond that it opens all and joins.
MOST_FOLDERS = 2000


def main_language(paths: DataFrame) -> DataFrame:
    """(language, files) of the language most files are in; of equals the first by name."""
    counted = paths.select(language(F.col("path")).alias("language")).filter("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    return counted.agg(F.min_by("language", F.struct(F.negate("files"), "language")).alias("language"), F.max("files").alias("files"))


_EXTENSIONS = ("py", "rs", "go", "ts", "sql", "md", "tsx")
_PATHS = "SELECT '/src/' || url_host || '/f' || page_id || '.' || ext AS path FROM (SELECT page_id, split_part(url, '/', 3) AS url_host, ['py', 'rs', 'go', 'ts', 'sql', 'md', 'tsx'][page_id % 7 + 1] AS ext FROM pages)"


def paths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of files made of the web pages' hosts and numbers."""
    extension = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 7 + 1).cast("int"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("/src/"), host, F.lit("/f"), F.col("page_id").cast("string"), F.lit("."), extension).alias("path"))


@on_tables(f"SELECT CASE regexp_extract(path, '[.]([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescriptjsx' END AS language, count(*) AS files FROM ({_PATHS}) GROUP BY 1")
def language_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths_of(spark, sf_dir).groupBy(language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


@on_tables(f"SELECT path FROM ({_PATHS}) WHERE NOT ends_with(path, '.md') AND NOT (ends_with(path, '.sql') AND NOT regexp_matches(path, '/f[0-9]*1[.]sql$')) AND NOT regexp_matches(path, '/m[.][^/]*/')")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths_of(spark, sf_dir)
    relative = F.expr("substring(path, 6)")
    return rows.filter(code_or_structural(F.col("path")) & ~ignored(relative, ["*.sql", "!*1.sql", "m.*/"])).select("path")

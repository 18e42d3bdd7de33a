"""Scalar expressions on names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories whose files are left out of reports.
IGNORED = ("node_modules", "venv", ".venv", "dist", "build", "target", "__pycache__", ".git")


def humanised(name: Column) -> Column:
    """`getHTTPUserById` and `get_http_user` as words."""
    name = F.regexp_replace(F.regexp_replace(name, "_+", " "), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def under(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    """Whether a directory of the path has one of these names, whichever separator it uses."""
    found = F.lit(False)
    for name in names:
        found |= path.contains(f"/{name}/") | path.contains(f"\\{name}\\")
    return found


def is_test_path(path: Column) -> Column:
    return basename(path).rlike(r"^test_|_test\.py$") | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("tests")))


def in_scope(path: Column, scope: str) -> Column:
    """The path is the scope, ends in it, or holds it as whole segments."""
    scope = scope.strip("/").removeprefix("./")
    return (path == scope) | path.endswith(f"/{scope}") | path.startswith(f"{scope}/") | path.contains(f"/{scope}/")


def ancestors(path: Column) -> Column:
    """Directories above the path, nearest last, without the root."""
    parts = F.split(F.ltrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9_-]+", "-"), F.lit("-"))


def property_text(value: Column, most: int = 4096) -> Column:
    return F.left(value, F.lit(most))


def suggestion(template: Column, values: dict[str, Column]) -> Column:
    """Fills `{{name}}`; what stays unknown goes."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{{{name}}}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(template, r"\{\{[^}]*\}\}", "")


def has_name(name: Column, *parts: str) -> Column:
    """The name holds one of the parts, whatever its case."""
    found = F.lit(False)
    for part in parts:
        found |= F.lower(name).contains(part)
    return found


def holds(text: Column, *parts: str) -> Column:
    """The text contains one of the parts, as they are written."""
    found = F.lit(False)
    for part in parts:
        found |= text.contains(part)
    return F.coalesce(found, F.lit(False))


def any_holds(texts: Column, *parts: str) -> Column:
    """One of a list of texts contains one of the parts."""
    return F.coalesce(F.exists(texts, lambda x: holds(x, *parts)), F.lit(False))


def glob_fragment(pattern: str) -> str:
    """What a path must contain to match a glob of folders: the pattern without its stars."""
    return pattern.replace("**/", "").replace("/**", "").replace("*", "")

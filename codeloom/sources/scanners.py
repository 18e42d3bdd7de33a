"""Sources in other languages: functions, classes, imports and calls by patterns of lines.

No grammar is at hand, so these find declarations, not scopes: names and lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_C_CALL = r"\b([A-Za-z_]\w*)\s*\("
_BRACE = r"^\s*(?:[\w:<>,*&\[\]~?]+\s+)+\**(\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|throws\s+[\w., ]+|\s)*\{"
#: language -> patterns of functions, classes, imports. Group 1 is the name.
PATTERNS: dict[str, tuple[str, str, str]] = {
    "c": (_BRACE, r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'),
    "cpp": (_BRACE, r"^\s*(?:class|struct|union|enum(?:\s+class)?)\s+(\w+)", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'),
    "csharp": (_BRACE, r"\b(?:class|interface|struct|enum|record)\s+(\w+)", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    "java": (_BRACE, r"\b(?:class|interface|enum|record|@interface)\s+(\w+)", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "dart": (_BRACE, r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(\w+)", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    "javascript": (r"(?:\bfunction\s*\*?\s*(\w+)\s*\(|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>|\w+\s*=>))", r"\bclass\s+(\w+)", r"(?:\bfrom\s+|^\s*import\s+|\brequire\s*\(\s*)['\"]([^'\"]+)['\"]"),
    "go": (r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", r"^\s*type\s+(\w+)\s+(?:struct|interface)\b", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'),
    "rust": (r"\bfn\s+(\w+)", r"\b(?:struct|enum|trait|union)\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "kotlin": (r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)\s*\(", r"\b(?:class|interface|object)\s+(\w+)", r"^\s*import\s+([\w.*]+)"),
    "scala": (r"\bdef\s+(\w+)", r"\b(?:class|trait|object)\s+(\w+)", r"^\s*import\s+([\w.{}, ]+)"),
    "swift": (r"\bfunc\s+(\w+)", r"\b(?:class|struct|enum|protocol|actor)\s+(\w+)", r"^\s*import\s+(\w+)"),
    "php": (r"\bfunction\s+&?(\w+)\s*\(", r"\b(?:class|interface|trait)\s+(\w+)", r"^\s*use\s+([\w\\]+)"),
    "ruby": (r"^\s*def\s+(?:self\.)?(\w+[?!=]?)", r"^\s*(?:class|module)\s+([\w:]+)", r"^\s*(?:require|require_relative|include)\s+['\"]?([\w:/.]+)"),
    "perl": (r"^\s*sub\s+(\w+)", r"^\s*package\s+([\w:]+)", r"^\s*(?:use|require)\s+([\w:]+)"),
    "haskell": (r"^([a-z]\w*)\s*::", r"^\s*(?:data|newtype|class|type)\s+(\w+)", r"^\s*import\s+(?:qualified\s+)?([\w.]+)"),
    "elixir": (r"^\s*defp?\s+(\w+[?!]?)", r"^\s*defmodule\s+([\w.]+)", r"^\s*(?:alias|import|use|require)\s+([\w.]+)"),
}
PATTERNS["typescript"] = PATTERNS["typescriptjsx"] = (PATTERNS["javascript"][0], r"\b(?:class|interface|enum)\s+(\w+)", PATTERNS["javascript"][2])
COMMENTS = {"ruby": r"#.*", "perl": r"#.*", "elixir": r"#.*", "haskell": r"--.*"}
#: Words that stand before a bracket and are no calls.
NO_CALLS = frozenset("if for while switch catch return sizeof function fn func def fun when match else do try async await new throw in and or not unless elif until foreach synchronized using lock fixed sub".split())
SCHEMA = "path string, language string, kind string, name string, line_number long"


def scan_text(language: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of what a source declares and calls."""
    if language not in PATTERNS:
        return []
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S) if language not in COMMENTS else text
    comment = COMMENTS.get(language, r"(?<!:)//.*")
    found = []
    patterns = [(kind, re.compile(p)) for kind, p in zip(("function", "class", "import"), PATTERNS[language], strict=True)]
    call = re.compile(_C_CALL)
    for number, line in enumerate(text.split("\n"), 1):
        line = re.sub(comment, "", line)
        declared = set()
        for kind, pattern in patterns:
            for m in pattern.finditer(line):
                name = next(x for x in m.groups() if x)
                if kind == "function" and name in NO_CALLS:
                    continue
                declared.add(name)
                found.append((kind, name, number))
        found += [("call", m[1], number) for m in call.finditer(line) if m[1] not in NO_CALLS and m[1] not in declared]
    return found


def scan_sources(files: DataFrame) -> DataFrame:
    """Elements of files (path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, lang, *x) for p, lang, t in zip(batch["path"], batch["language"], batch["text"], strict=True) for x in scan_text(lang or "", t or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)

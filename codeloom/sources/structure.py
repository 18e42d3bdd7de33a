"""Structure of sources in eighteen languages: declarations, scopes, arguments, bases, complexity, calls.

A file becomes rows of tokens by one pattern (strings and comments are tokens too), and
what a parser would keep on a stack is kept in windows over them: the depth of a token
is a running sum, the k-th opening of a depth belongs with its k-th closing, the scope
around a token is at each depth the block last opened there. Nothing here reads a file
token by token in Python; a file's tokens are sorted, not held: its text is cut into
pieces of PIECE tokens first, and only a piece's tokens are an array.

Blocks are braces, or words with `end` (Ruby, Elixir), or for Haskell the lines up to the
next one that begins at the margin. Templates count as strings, code inside them is not
read; regular-expression literals are not known as such. Unbalanced sources give what
can be matched: a block that is never closed ends with its file. Null or empty texts
and unknown languages give no rows; rows of one path are read as one file each time it
is there once, so paths must be distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import checkpoint
from ..registry import on_tables

WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
OPERATORS = r"::|->|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\?:|\+\+|--|\+=|-=|\*=|/=|:="
TEXT = r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''
TRIPLE = r'"""[\s\S]*?(?:"""|\z)'
SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"


def pattern(comments: str, strings: str = TEXT, word: str = WORD) -> str:
    return "|".join((comments, strings, word, r"\d[\p{L}\p{N}_.]*", OPERATORS, r"\n[ \t]*", r"[^\s]"))


#: How each family of languages writes comments, strings and words.
PATTERNS = {
    "slash": pattern(SLASHES, f"{TRIPLE}|{TEXT}"),
    "script": pattern(SLASHES, TEXT + r"|`(?:[^`\\]|\\.)*+`"),
    "go": pattern(SLASHES, r"`[^`]*`|" + TEXT),
    "rust": pattern(SLASHES, r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\[^u\n]|\\u\{\w+\})'|'\w+"),
    "php": pattern(r"#(?!\[)[^\n]*|" + SLASHES, word=r"\$?" + WORD),
    "ruby": pattern(r"=begin\b[\s\S]*?\n=end|#[^\n]*", word=r"[@$]{0,2}[\p{L}_][\p{L}\p{N}_]*[?!]?"),
    "elixir": pattern(r"#[^\n]*", TRIPLE + "|" + TEXT, r"@?[\p{L}_][\p{L}\p{N}_]*[?!]?(?::(?!:))?"),
    "perl": pattern(r"#[^\n]*", TEXT, r"[$@%&]#?\w+|" + WORD),
    "haskell": pattern(r"--[^\n]*|\{-[\s\S]*?-\}", r'"(?:[^"\\]|\\.)*+"', r"[\p{L}_][\p{L}\p{N}_']*"),
}
#: Tokens and blanks of a piece of a text. Every character is of one of the two, so pieces leave nothing out and end where a token does.
PIECE = 2000


@dataclass(frozen=True)
class Language:
    """What tells declarations, scopes and decisions of a language."""

    family: str = "slash"
    functions: tuple[str, ...] = ()  # words before a function's name
    behind: tuple[str, ...] = ()  # what follows the brackets of a function that no word announces
    classes: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()  # what stands before base classes
    types: str = ""  # before or behind the name
    decisions: tuple[str, ...] = ()
    binary: bool = False  # whether all operators between two operands are decisions
    abstract: bool = False  # whether a typed function may end with a semicolon
    ends: str = "brace"
    first_arg: bool = False  # an argument's name is its first word (Go, Ruby, Elixir)


LOOPS = ("if", "for", "while")
C_DECISIONS = (*LOOPS, "do", "switch", "case", "?")
#: Words of each language. Decisions are those that the language's own complexity counts, or for languages without one: branches, loops, cases, handlers and short-circuit operators.
LANGUAGES = {
    "c": Language(behind=("{",), classes=("struct", "union", "enum"), types="before", decisions=(*C_DECISIONS, "goto"), binary=True),
    "cpp": Language(behind=("{", "const", "noexcept", "override", "final", "->", ":", "try"), classes=("class", "struct", "union", "enum"), bases=(":",), types="before", decisions=(*LOOPS, "switch", "case", "catch", "?", "&&", "||")),
    "csharp": Language(behind=("{", "=>", "where", ":"), classes=("class", "interface", "struct", "enum", "record"), bases=(":",), types="before", decisions=(*LOOPS, "foreach", "case", "catch", "?", "&&", "||", "??"), abstract=True),
    "java": Language(behind=("{", "throws"), classes=("class", "interface", "enum", "record"), bases=("extends", "implements"), types="before", decisions=(*LOOPS, "case", "catch", "?", "&&", "||"), abstract=True),
    "dart": Language(family="script", behind=("{", "=>", "async", "sync", ":"), classes=("class", "mixin", "enum", "extension"), bases=("extends", "implements", "with"), types="before", decisions=(*LOOPS, "do", "switch", "case", "?", "&&", "||", "catch"), abstract=True),
    "javascript": Language(family="script", functions=("function",), behind=("{",), classes=("class",), bases=("extends",), decisions=(*C_DECISIONS, "catch"), binary=True),
    "typescript": Language(family="script", functions=("function",), behind=("{", ":"), classes=("class", "interface", "enum"), bases=("extends", "implements"), types="behind", decisions=(*C_DECISIONS, "catch"), binary=True),
    "go": Language(family="go", functions=("func",), classes=("type",), types="behind", decisions=("if", "for", "case", "select", "&&", "||"), first_arg=True),
    "rust": Language(family="rust", functions=("fn",), classes=("struct", "enum", "trait", "union"), bases=(":",), types="behind", decisions=(*LOOPS, "loop", "=>", "&&", "||")),
    "kotlin": Language(functions=("fun",), classes=("class", "interface", "object"), bases=(":",), types="behind", decisions=(*LOOPS, "when", "catch", "->", "&&", "||", "?:")),
    "scala": Language(functions=("def",), classes=("class", "trait", "object"), bases=("extends", "with"), types="behind", decisions=(*LOOPS, "case", "catch", "&&", "||")),
    "swift": Language(functions=("func", "init"), classes=("class", "struct", "enum", "protocol", "actor", "extension"), bases=(":",), types="behind", decisions=(*LOOPS, "guard", "case", "catch", "?", "&&", "||", "??")),
    "php": Language(family="php", functions=("function", "fn"), classes=("class", "interface", "trait", "enum"), bases=("extends", "implements"), decisions=(*LOOPS, "foreach", "elseif", "case", "catch", "?", "&&", "||", "??")),
    "perl": Language(family="perl", functions=("sub",), classes=("package",), decisions=(*LOOPS, "unless", "foreach", "until", "?", "&&", "||", "and", "or")),
    "ruby": Language(family="ruby", functions=("def",), classes=("class", "module"), bases=("<",), decisions=("if", "elsif", "unless", "case", "when", "while", "until", "for", "rescue", "ensure", "and", "or", "&&", "||", "?"), ends="end", first_arg=True),
    "elixir": Language(family="elixir", functions=("def", "defp", "defmacro"), classes=("defmodule", "defprotocol", "defimpl"), decisions=("if", "unless", "case", "cond", "with", "for", "rescue", "->", "and", "or", "&&", "||"), ends="do", first_arg=True),
    "haskell": Language(family="haskell", classes=("data", "newtype", "class", "type"), decisions=("if", "case", "|", "&&", "||"), ends="margin"),
}
LANGUAGES["typescriptjsx"] = LANGUAGES["typescript"]
#: Words that stand before brackets or names and declare nothing.
RESERVED = ("if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "try", "new", "throw", "await", "in", "is", "as", "and", "or", "not", "unless", "elif", "elsif", "until", "foreach", "synchronized", "using", "when", "match", "case", "defer", "delete", "typeof", "yield", "import", "package", "public", "private", "protected", "static", "final", "const", "let", "var", "val", "void", "super", "this", "self", "extends", "implements", "instanceof", "guard", "with", "function", "func", "fun", "fn", "def", "sub", "class", "constructor", "where", "throws", "override", "async", "export", "default", "goto", "break", "continue", "my", "our", "local")
#: Of these, words that may still be a method's own name or type.
TYPES_TOO = ("void", "var", "val", "let", "const", "final", "auto")
OPERANDS = r"^[\p{L}\p{N}_$@'\")\]]"


def per_language(language: Column, value) -> Column:  # noqa: ANN001
    """A value of each language, by its name."""
    out = F.lit(None)
    for name, spec in LANGUAGES.items():
        found = value(spec)
        if found is not None:
            out = F.when(language == name, found).otherwise(out)
    return out


def one_of(column: Column, values: tuple[str, ...]) -> Column:
    return column.isin(*values) if values else F.lit(False)


def by_file(*more: str) -> Window:
    return Window.partitionBy("path", *more).orderBy("pos")


def from_end(*more: str) -> Window:
    """What follows a token, read backwards: a frame that ends with the file is gone through anew for each row, one that begins with it once."""
    return Window.partitionBy("path", *more).orderBy(F.desc("pos"))


UP_TO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def tokens(files: DataFrame) -> DataFrame:
    """(path, language, pos, token, line, first, depth, level, opens, closes, inside, ...): the code of files (path, language, text), a row a token."""
    lang = F.col("language")
    cut = split = F.lit(None).cast("array<string>")
    for family, regex in PATTERNS.items():
        known = one_of(lang, tuple(n for n, s in LANGUAGES.items() if s.family == family))
        cut = F.when(known, F.regexp_extract_all("text", F.lit(f"(?:{regex}|\\s){{1,{PIECE}}}+"), F.lit(0))).otherwise(cut)
        split = F.when(known, F.regexp_extract_all("piece", F.lit(regex), F.lit(0))).otherwise(split)
    pieces = files.filter(F.col("text").isNotNull()).select("path", "language", F.posexplode(cut).alias("nth", "piece"))
    rows = pieces.select("path", "language", "nth", F.posexplode(split).alias("at", "token")).select("path", "language", (F.col("nth") * PIECE + F.col("at")).alias("pos"), "token")
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n")))
    rows = rows.withColumn("line", (1 + F.coalesce(F.sum(breaks).over(by_file().rowsBetween(*BEFORE)), F.lit(0))).cast("long"))
    before = F.lag("token").over(by_file())
    rows = rows.withColumn("margin", before.isNull() | (before == "\n")).withColumn("first", F.col("margin") | before.rlike(r"^(\n|;)"))
    comment = F.when(lang.isin("ruby", "elixir", "perl"), F.col("token").rlike(r"^(#|=begin\b)")).when(lang == "haskell", F.col("token").rlike(r"^(--|\{-)")).when(lang == "php", F.col("token").rlike(r"^(//|/\*|#.)")).otherwise(F.col("token").rlike(r"^(//|/\*)"))
    rows = rows.filter(~F.col("token").startswith("\n") & ~comment).withColumn("pos", F.row_number().over(by_file()))
    rows = rows.withColumn("token", F.when(F.col("token").rlike("^[\"`]|^'.+'$"), "''").otherwise(F.col("token")))
    t = F.col("token")
    near = {f"n{k}": F.lead("token", k).over(by_file()) for k in range(1, 8)} | {f"p{k}": F.lag("token", k).over(by_file()) for k in range(1, 6)}
    rows = rows.withColumns(near)
    word_loop = F.max(F.when(t.isin("while", "until", "for") & F.col("first"), F.col("line"))).over(by_file().rowsBetween(*BEFORE)) == F.col("line")
    starts = F.col("first") | F.col("p1").isin("=", "(", "[", ",", "then", "do", "else", "{", "|", "return", "&&", "||", "<<", "+=")
    ruby = (t.isin("def", "class", "module", "begin", "case") & ~F.coalesce(F.col("p1").isin(".", ":", "::"), F.lit(False))) | (t.isin("if", "unless", "while", "until", "for") & starts) | ((t == "do") & ~F.coalesce(word_loop, F.lit(False)))
    elixir = t.isin("do", "fn")
    by_word = per_language(lang, lambda s: s.ends)
    opens = F.when(by_word == "end", ruby & ~F.coalesce((t == "class") & (F.col("n1") == "<"), F.lit(False)) | (t == "class") & (F.col("n1") == "<")).when(by_word == "do", elixir).when(by_word == "margin", F.lit(False)).otherwise(t == "{")
    closes = F.when(by_word.isin("end", "do"), t == "end").when(by_word == "margin", F.lit(False)).otherwise(t == "}")
    rows = rows.withColumns({"opens": opens, "closes": closes, "up": t.isin("(", "["), "down": t.isin(")", "]")})
    running = by_file().rowsBetween(*UP_TO)
    rows = rows.withColumns({"depth": F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(running), "inside": F.sum(F.col("up").cast("int") - F.col("down").cast("int")).over(running) - F.col("up").cast("int")})
    operand = F.col("p1").rlike(OPERANDS) & ~F.coalesce(F.col("p1").isin(*RESERVED), F.lit(False))
    binary = per_language(lang, lambda s: F.lit(s.binary)) & operand & t.isin("+", "-", "*", "/", "%", "<", ">", "<=", ">=", "==", "===", "!=", "!==", "&&", "||", "??", "&", "|", "^", "instanceof", "in")
    decides = per_language(lang, lambda s: one_of(t, s.decisions)) & ~F.coalesce((t == "?") & (F.col("n1").isin(":", ".", ",", ")", ">", "=") | F.col("n1").isNull()), F.lit(False)) & ~F.coalesce(F.col("p1").isin(".", "?."), F.lit(False))
    rows = rows.withColumn("decisions", F.sum((F.coalesce(decides, F.lit(False)) | F.coalesce(binary, F.lit(False))).cast("int")).over(running))
    return rows.withColumns({"above": F.lag("line").over(by_file()), "sofar": F.coalesce(F.lag("decisions").over(by_file()), F.lit(0))})


def with_stops(rows: DataFrame) -> DataFrame:
    """Adds where, at the same depth of brackets, the next brace, semicolon, sign or declaring word stands, and the next line begins."""
    lang, t = F.col("language"), F.col("token")
    words = per_language(lang, lambda s: one_of(t, (*s.functions, *s.classes)) if s.ends == "brace" else one_of(t, ("do", "do:")) if s.ends == "do" else None)
    stop = t.isin("{", "}", ";", "=", "=>") | F.coalesce(words, F.lit(False))
    following = from_end("inside").rowsBetween(*BEFORE)
    at = F.struct("pos", "token", "line")
    return rows.withColumns({
        "stop": F.last(F.when(stop, at), ignorenulls=True).over(following),
        "next_line": F.last(F.when(F.col("first"), F.struct("pos", F.col("above").alias("line"), F.col("sofar").alias("decisions"))), ignorenulls=True).over(following),
        "last_stop": F.max(F.when(stop, F.col("pos"))).over(by_file("inside").rowsBetween(*BEFORE)),
    })


def matched(rows: DataFrame, opens: str, closes: str, level: Column) -> DataFrame:
    """(path, open, shut, shut_line, shut_decisions, level): the k-th opening of a level with its k-th closing; one that is never closed ends with the file."""
    some = rows.filter(F.col(opens) | F.col(closes)).select("path", "pos", "line", "decisions", opens, level.alias("level"), F.col("n1").alias("after"), "stop", "next_line")
    some = some.withColumn("k", F.row_number().over(by_file("level", opens)))
    left = some.filter(opens).select("path", "level", "k", F.col("pos").alias("open"))
    right = some.filter(f"not {opens}").select("path", "level", "k", F.struct("pos", "line", "decisions", "after", "stop", "next_line").alias("shut"))
    ends = rows.groupBy("path").agg(F.max(F.struct("pos", "line", "decisions")).alias("end"))
    return left.join(right, ["path", "level", "k"], "left").join(ends, "path").select("path", "open", "level", F.coalesce("shut.pos", "end.pos").alias("shut"), F.coalesce("shut.line", "end.line").alias("shut_line"), F.coalesce("shut.decisions", "end.decisions").alias("shut_decisions"), "shut.after", F.col("shut.stop").alias("stop_behind"), F.col("shut.next_line").alias("next_line_behind"))


@dataclass
class Structure:
    """Tables of a set of files."""

    tokens: DataFrame
    blocks: DataFrame  # path, open, shut, ...
    declarations: DataFrame  # path, language, kind, name, pos, line_number, end_line, complexity, body (its block), args, bases, context, class_context
    calls: DataFrame  # path, language, name, full_name, receiver, line_number, pos, context, class_context


IS_WORD = r"^[\p{L}_$@]"


def word(c: Column) -> Column:
    return c.rlike(IS_WORD)


def declared(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """(path, language, kind, name, pos, line_number, head, owner, shape): head: the bracket of its arguments, shape: how its body follows."""
    t, lang = F.col("token"), F.col("language")
    n = [None, *(F.col(f"n{k}") for k in range(1, 8))]
    is_function = F.coalesce(per_language(lang, lambda s: one_of(t, s.functions)), F.lit(False)) & ~F.coalesce(F.col("p1").isin(".", "?.", "new"), F.lit(False))
    impl = (lang == "rust") & (t == "impl")
    is_class = F.coalesce(impl | per_language(lang, lambda s: one_of(t, s.classes)), F.lit(False)) & ~F.coalesce(F.col("p1").isin(".", "::", "enum"), F.lit(False))
    receiver = F.when((lang == "go") & (n[1] == "("), F.when(n[3] == "*", F.struct(n[4].alias("owner"), n[6].alias("name"))).otherwise(F.struct(n[3].alias("owner"), n[5].alias("name"))))
    plain = F.when(t == "init", F.lit("init")).when(n[1].isin("*", "&"), n[2]).when((n[1] == "<") & (n[3] == ">"), n[4]).when(n[2].isin(".") & word(n[3]), n[3]).when(word(n[1]), n[1])
    class_name = F.when(impl & (n[2] == "for"), n[3]).when(n[1].isin("class", "struct"), n[2]).when(lang == "elixir", F.when(n[2] == ".", F.concat(n[1], F.lit("."), n[3])).otherwise(n[1])).when(word(n[1]) & ~n[1].isin("extends", "of"), n[1])
    keyword = rows.filter(is_function | is_class).select("path", "language", F.when(impl, "impl").when(is_class, "class").otherwise("function").alias("kind"), F.when(is_class, class_name).otherwise(F.coalesce(receiver["name"], plain)).alias("name"), "pos", F.col("line").alias("line_number"), receiver["owner"].alias("owner"), "stop", "next_line", "n2", "n3", "depth", "decisions", "opens", "inside")
    keyword = keyword.filter(F.col("name").isNotNull() & ((lang != "go") | (F.col("kind") == "function") | F.col("n2").isin("struct", "interface")))
    # C and C++ name a structure's type without declaring it
    keyword = keyword.filter((F.col("kind") == "function") | ~lang.isin("c", "cpp") | (F.col("stop.token") == "{"))
    # functions that their brackets tell
    reserved = t.isin(*RESERVED)
    typed = F.coalesce((word(F.col("p1")) & (~F.col("p1").isin(*RESERVED) | F.col("p1").isin(*TYPES_TOO))) | F.col("p1").isin(">", "]", "*", "?"), F.lit(False))
    shut = brackets.select("path", (F.col("open") - 1).alias("pos"), "after", "stop_behind", "next_line_behind")
    named = rows.filter(word(t) & (n[1] == "(") & (~reserved | (t == "constructor"))).withColumn("typed", typed).filter(~F.coalesce(F.col("p1").isin(".", "?.", "new", "->", "return", "throw", "await", "else", *(w for s in LANGUAGES.values() for w in s.functions)), F.lit(False)))
    initialiser = (lang == "cpp") & ((F.col("p1") == ",") | ((F.col("p1") == ":") & ~F.col("p2").isin("public", "private", "protected")))
    named = named.filter(~F.coalesce(initialiser, F.lit(False))).join(shut, ["path", "pos"])
    member = F.when((lang == "cpp") & (F.col("p1") == "::"), F.col("p2"))
    body = F.coalesce(per_language(lang, lambda s: one_of(F.col("after"), s.behind)), F.lit(False)) & ((F.col("after") == "{") | F.col("stop_behind.token").isin("{", "=>"))
    abstract = F.coalesce(per_language(lang, lambda s: F.lit(s.abstract)), F.lit(False)) & F.col("typed") & (F.col("after") == ";")
    named = named.filter(body | abstract)
    named = named.select("path", "language", F.lit("function").alias("kind"), F.col("token").alias("name"), "pos", F.col("line").alias("line_number"), member.alias("owner"), F.col("stop_behind").alias("stop"), F.col("next_line_behind").alias("next_line"), "n2", "n3", "depth", "decisions", "opens", "inside")
    # functions that are values: name = (...) => and name = function
    script = lang.isin("javascript", "typescript", "typescriptjsx")
    late = F.coalesce((n[2] == "async").cast("int"), F.lit(0))
    what, then = F.when(late == 1, n[3]).otherwise(n[2]), F.when(late == 1, n[4]).otherwise(n[3])
    open_ = F.col("pos") + 2 + late + F.when(what == "function", F.when(then == "(", 1).otherwise(2)).otherwise(0)
    value = rows.filter(script & word(t) & n[1].isin("=", ":") & (what.isin("(", "function") | (then == "=>"))).withColumns({"what": what, "open": open_})
    value = value.join(brackets.select("path", "open", "after", "stop_behind", "next_line_behind"), ["path", "open"], "left")
    arrow = (F.col("after") == "=>") | (F.col("after") == ":") & (F.col("stop_behind.token") == "=>")
    value = value.filter((F.col("what") == "function") | ~what.isin("(") | F.coalesce(arrow, F.lit(False)))
    bracketed = F.col("what").isin("(", "function")
    # x => ...: the sign stands three words on, what it stops at is found from there
    lone = F.struct((F.col("pos") + 3 + late).alias("pos"), F.lit("=>").alias("token"), F.col("line").alias("line"))
    values = value.select("path", "language", F.lit("function").alias("kind"), F.col("token").alias("name"), "pos", F.col("line").alias("line_number"), F.lit(None).cast("string").alias("owner"), F.when(bracketed, F.col("stop_behind")).otherwise(lone).alias("stop"), F.when(bracketed, F.col("next_line_behind")).otherwise(F.col("next_line")).alias("next_line"), "n2", "n3", "depth", "decisions", "opens", "inside", F.when(bracketed, F.col("open")).alias("given"), F.when(~bracketed, F.col("what")).alias("only"))
    none = {"given": F.lit(None).cast("int"), "only": F.lit(None).cast("string")}
    keyword, named = keyword.withColumns(none), named.withColumns(none).withColumn("given", F.col("pos") + 1)
    values = values.join(named.select("path", "pos"), ["path", "pos"], "left_anti")
    return keyword.unionByName(named).unionByName(values)


def chains(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, pos, level, block): for items (path, pos, depth) the blocks around them, each level once."""
    asked = items.select("path", "pos", F.explode(F.expr("CASE WHEN depth > 0 THEN sequence(1L, cast(depth AS long)) ELSE array() END")).alias("level"), F.lit(None).cast("int").alias("block"))
    opened = rows.filter("opens").select("path", "pos", F.col("depth").alias("level"), F.col("pos").alias("block"))
    both = asked.withColumn("ask", F.lit(True)).union(opened.withColumn("ask", F.lit(False)))
    last = F.last("block", ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("pos", F.col("ask").desc()).rowsBetween(*UP_TO))
    return both.withColumn("block", last).filter("ask and block is not null").select("path", "pos", "level", "block").distinct()


def margin_declarations(rows: DataFrame) -> DataFrame:
    """Haskell: functions by their signatures and equations at the margin, up to the next declaration of another name there; types by their words."""
    t, n1, n2 = F.col("token"), F.col("n1"), F.col("n2")
    words_ = LANGUAGES["haskell"].classes
    top = rows.filter((F.col("language") == "haskell") & F.col("margin") & word(t))
    kind = F.when(t.isin(*words_), "class").when(~t.isin("import", "module", "instance", "deriving", "infixl", "infixr", "infix", "default", "where"), "function").otherwise("other")
    name = F.when(kind == "class", n1).otherwise(t)
    top = top.withColumns({"kind": kind, "name": name, "signature": n1 == "::"})
    changed = F.coalesce((F.lag("name").over(by_file()) != F.col("name")) | (F.lag("kind").over(by_file()) != F.col("kind")), F.lit(True))
    top = top.withColumn("k", F.sum(changed.cast("int")).over(by_file().rowsBetween(*UP_TO)))
    groups = top.groupBy("path", "language", "kind", "name", "k").agg(F.min("pos").alias("pos"), F.min("line").alias("line_number"), F.min_by("sofar", "pos").alias("sofar"))
    following = Window.partitionBy("path").orderBy("pos")
    ends = rows.groupBy("path").agg(F.max(F.struct("pos", "line", "decisions")).alias("end"))
    nexts = top.select("path", "k", F.struct((F.col("pos") - 1).alias("pos"), F.col("above").alias("line"), F.col("sofar").alias("decisions")).alias("stop")).groupBy("path", "k").agg(F.min("stop").alias("stop"))
    out = groups.withColumn("next_k", F.lead("k").over(following)).join(nexts.select("path", F.col("k").alias("next_k"), "stop"), ["path", "next_k"], "left").join(ends, "path")
    end = F.coalesce("stop", "end")
    return out.filter("kind <> 'other'").select("path", "language", "kind", "name", "pos", "line_number", end["pos"].alias("end_pos"), end["line"].alias("end_line"), (1 + end["decisions"] - F.col("sofar")).alias("complexity"))


def structure(files: DataFrame) -> Structure:
    """The structure of files (path, language, text)."""
    rows = checkpoint(with_stops(tokens(files)))
    level = F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1)
    blocks = checkpoint(matched(rows, "opens", "closes", level))
    brackets = checkpoint(matched(rows.filter("up or down"), "up", "down", F.col("inside")))
    found = declared(rows, brackets)
    lang = F.col("language")
    ends = per_language(lang, lambda s: F.lit(s.ends))
    # The bracket of the arguments and what follows it
    heads = brackets.select("path", F.col("open").alias("head"), F.col("shut").alias("head_shut"), F.col("shut_decisions").alias("head_decisions"), "stop_behind", "next_line_behind")
    first_bracket = rows.filter("token = '('").select("path", "inside", "pos")
    asked = found.select("path", "inside", "pos", F.lit(True).alias("ask"), F.col("name"))
    both = asked.unionByName(first_bracket.withColumn("ask", F.lit(False)).withColumn("name", F.lit(None).cast("string")))
    nth = F.when(~F.col("ask"), F.col("pos"))
    later = Window.partitionBy("path", "inside").orderBy(F.desc("pos"), F.desc("ask")).rowsBetween(*BEFORE)
    opened = both.withColumn("head", F.last(nth, ignorenulls=True).over(later)).filter("ask").select("path", "pos", "name", "head")
    found = found.join(opened, ["path", "pos", "name"])
    # A method of Go has its receiver in brackets of its own
    receivers = brackets.select("path", F.col("open").alias("head"), F.col("shut").alias("receiver_shut"))
    of_go = F.col("owner").isNotNull() & (lang == "go")
    found = found.join(receivers, ["path", "head"], "left").withColumn("head", F.coalesce("given", F.when(of_go, F.col("receiver_shut") + 2).otherwise(F.col("head")))).drop("receiver_shut")
    before_stop = F.col("stop").isNull() | (F.col("head") < F.col("stop.pos")) | F.col("given").isNotNull()
    found = found.withColumn("head", F.when((F.col("kind") == "function") & F.col("only").isNull() & before_stop, F.col("head"))).join(heads, ["path", "head"], "left")
    stop = F.when(F.col("head_shut").isNotNull(), F.col("stop_behind")).otherwise(F.col("stop"))
    line_end = F.when(F.col("head_shut").isNotNull(), F.col("next_line_behind")).otherwise(F.col("next_line"))
    body = F.when(ends == "end", F.when(F.col("opens"), F.col("pos"))).when(ends == "do", F.when(stop["token"] == "do", stop["pos"])).otherwise(F.when(stop["token"].isin("{"), stop["pos"]))
    # the block behind `=` or `=>`, if it begins there
    after = rows.select("path", F.col("pos").alias("sign"), F.col("n1").alias("behind"), F.lead("pos").over(by_file()).alias("behind_pos")).filter("behind = '{'")
    found = found.withColumns({"sign": F.when(stop["token"].isin("=", "=>"), stop["pos"]), "body": body, "stop_": stop, "line_end": line_end})
    found = found.join(after, ["path", "sign"], "left").withColumn("body", F.coalesce("body", "behind_pos"))
    shut = blocks.select("path", F.col("open").alias("body"), F.col("shut").alias("body_shut"), "shut_line", "shut_decisions")
    found = found.join(shut, ["path", "body"], "left")
    last = rows.groupBy("path").agg(F.max(F.struct("pos", "line", "decisions")).alias("last"))
    found = found.join(last, "path")
    short = F.when(F.col("line_end").isNotNull(), F.struct((F.col("line_end.pos") - 1).alias("pos"), F.col("line_end.line").alias("line"), F.col("line_end.decisions").alias("decisions"))).otherwise(F.col("last"))
    is_function = F.col("kind") == "function"
    end = F.when(F.col("body_shut").isNotNull(), F.struct(F.col("body_shut").alias("pos"), F.col("shut_line").alias("line"), F.col("shut_decisions").alias("decisions"))).otherwise(short)
    found = found.withColumns({"end_pos": end["pos"], "end_line": end["line"], "complexity": F.when(is_function, 1 + end["decisions"] - F.coalesce("head_decisions", "decisions"))})
    found = found.select("path", "language", "kind", "name", "pos", "line_number", "end_pos", "end_line", "complexity", "body", "head", "head_shut", "owner", "depth", "opens", "inside", "only")
    margin = margin_declarations(rows).withColumns({"body": F.lit(None).cast("int"), "head": F.lit(None).cast("int"), "head_shut": F.lit(None).cast("int"), "owner": F.lit(None).cast("string"), "depth": F.lit(0).cast("long"), "opens": F.lit(False), "inside": F.lit(0).cast("long"), "only": F.lit(None).cast("string")})
    margin = margin.withColumn("complexity", F.when(F.col("kind") == "function", F.col("complexity")))
    found = checkpoint(found.filter("language <> 'haskell'").unionByName(margin.select(*found.columns)).dropDuplicates(["path", "pos", "kind"]))
    calls = called(rows, found)
    # What is around a declaration or a call
    items = found.select("path", "pos", (F.col("depth") - F.col("opens").cast("int")).alias("depth")).union(calls.select("path", "pos", "depth"))
    around = chains(items, rows).join(found.filter("body is not null").select("path", F.col("body").alias("block"), F.col("name").alias("outer"), F.col("kind").alias("outer_kind"), F.col("pos").alias("outer_pos")), ["path", "block"]).filter("outer_pos <> pos")
    of_class = F.col("outer_kind").isin("class", "impl")
    context = around.groupBy("path", "pos").agg(F.max_by("outer", "level").alias("context"), F.max_by("outer_kind", "level").alias("context_kind"), F.max_by(F.when(of_class, F.col("outer")), F.when(of_class, F.col("level"))).alias("class_context"))
    declarations = found.join(context, ["path", "pos"], "left").withColumn("class_context", F.coalesce("owner", "class_context")).withColumn("context", F.coalesce("owner", "context"))
    declarations = declarations.join(arguments(rows, found), ["path", "pos"], "left").join(base_classes(rows, found), ["path", "pos"], "left")
    declarations = declarations.withColumns({"args": F.when(F.col("kind") == "function", F.coalesce("args", F.when(F.col("only").isNotNull(), F.array("only")), F.array().cast("array<string>"))), "bases": F.when(F.col("kind") == "class", F.coalesce("bases", F.array().cast("array<string>")))})
    # a package of Perl lasts until the next one
    package = F.last(F.when((lang == "perl") & (F.col("kind") == "class"), F.col("name")), ignorenulls=True).over(by_file().rowsBetween(*BEFORE))
    declarations = declarations.withColumn("class_context", F.coalesce("class_context", F.when(F.col("kind") == "function", package))).filter("kind <> 'impl'")
    return Structure(rows, blocks, checkpoint(declarations), calls.join(context, ["path", "pos"], "left"))


def called(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, language, name, full_name, receiver, line_number, pos, depth): a word before a bracket that declares nothing."""
    t = F.col("token")
    dot = F.col("p1").isin(".", "->", "::", "?.") & word(F.col("p2"))
    deeper = dot & F.col("p3").isin(".", "->", "::", "?.") & F.col("p4").isin("this", "self", "$this")
    rows = rows.filter(word(t) & (F.col("n1") == "(") & (~t.isin(*RESERVED) | F.coalesce(F.col("p1") == ".", F.lit(False))))
    rows = rows.filter(~F.coalesce(F.col("p1").isin(*(w for s in LANGUAGES.values() for w in (*s.functions, *s.classes))), F.lit(False)))
    typed = per_language(F.col("language"), lambda s: F.lit(s.types == "before")) & ~F.col("first") & word(F.col("p1")) & (~F.col("p1").isin(*RESERVED) | F.col("p1").isin(*TYPES_TOO))
    rows = rows.filter(~F.coalesce(typed, F.lit(False)))
    receiver = F.when(dot, F.col("p2"))
    full = F.when(deeper, F.concat_ws(".", "p4", "p2", "token")).when(dot, F.concat_ws(".", "p2", "token")).otherwise(t)
    rows = rows.select("path", "language", F.col("token").alias("name"), full.alias("full_name"), receiver.alias("receiver"), F.col("line").alias("line_number"), "pos", F.col("depth"))
    return rows.join(found.select("path", "pos").union(found.filter("head is not null").select("path", F.col("head") - 1)), ["path", "pos"], "left_anti")


def inner_tokens(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens directly within brackets: groups (path, head, pos) with the tokens of each."""
    # an opening bracket stands at its outer level, what it holds one further in
    inner = rows.select("path", F.col("inside").alias("level"), "pos", "token", "n1", "p1", F.lit(None).cast("int").alias("of")).union(rows.filter("up").select("path", (F.col("inside") + 1).alias("level"), "pos", "token", "n1", "p1", F.col("pos").alias("of")))
    last = F.last("of", ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("pos", F.col("of").isNull().desc()).rowsBetween(*UP_TO))
    inner = inner.withColumn("mark", F.col("of").isNotNull()).withColumn("of", last).filter("not mark and of is not null").select("path", F.col("of").alias("head"), F.col("pos").alias("at"), "token", "n1", "p1")
    return inner.join(groups, ["path", "head"])


def arguments(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, pos, args): the names between the brackets of a function, cut at commas outside angle brackets."""
    heads = found.filter("kind = 'function' and head is not null").select("path", "head", "head_shut", "pos", "language")
    inner = inner_tokens(rows, heads).filter("at < head_shut")
    ordered = Window.partitionBy("path", "pos").orderBy("at")
    angle = F.when(F.col("token") == "<", 1).when(F.col("token") == ">", -1).otherwise(0)
    inner = inner.withColumn("angle", F.sum(angle).over(ordered.rowsBetween(*UP_TO)))
    inner = inner.withColumn("k", F.sum(((F.col("token") == ",") & (F.col("angle") == 0)).cast("int")).over(ordered.rowsBetween(*UP_TO)))
    part = Window.partitionBy("path", "pos", "k").orderBy("at")
    past = F.max(F.col("token").isin(":", "?:", "=", "[", "|").cast("int")).over(part.rowsBetween(*UP_TO))
    names = inner.withColumn("past", past).filter((F.col("past") == 0) & word(F.col("token")) & (F.col("angle") == 0) & ~F.col("token").isin("const", "final", "mut", "val", "var", "void", "readonly", "private", "public", "protected", "required", "inout", "out", "ref", "unsigned", "struct", "ptr"))
    first = per_language(F.col("language"), lambda s: F.lit(s.first_arg))
    args = names.groupBy("path", "pos", "k", "language").agg(F.min_by("token", "at").alias("first_word"), F.max_by("token", "at").alias("last_word")).withColumn("arg", F.when(first, F.col("first_word")).otherwise(F.col("last_word")))
    return args.groupBy("path", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "arg"))), lambda x: x["arg"]).alias("args"))


def base_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, pos, bases): the last parts of the names behind a class and its sign or words of bases, up to its body."""
    classes = found.filter("kind = 'class'").select("path", "inside", "pos", "language", "line_number", F.lit(True).alias("is_class"))
    marked = rows.select("path", "inside", "pos", "token", "n1", "p1", "line", "language", "last_stop").join(classes.select("path", "pos", "is_class"), ["path", "pos"], "left")
    by_inside = by_file("inside").rowsBetween(*BEFORE)
    marked = marked.withColumn("of", F.max(F.when(F.col("is_class"), F.col("pos"))).over(by_inside)).withColumn("of_line", F.max(F.when(F.col("is_class"), F.col("line"))).over(by_inside))
    one_line = per_language(F.col("language"), lambda s: F.lit(s.ends != "brace"))
    head = marked.filter("of is not null and (last_stop is null or last_stop <= of)").filter(~one_line | (F.col("line") == F.col("of_line"))).filter(~F.col("token").isin("{", "}", ";", "="))
    ordered = Window.partitionBy("path", "of").orderBy("pos")
    angle = F.when(F.col("token") == "<", 1).when(F.col("token") == ">", -1).otherwise(0)
    signs = F.coalesce(per_language(F.col("language"), lambda s: one_of(F.col("token"), s.bases)), F.lit(False))
    head = head.withColumn("angle", F.when(F.col("language") == "ruby", F.lit(0)).otherwise(F.sum(angle).over(ordered.rowsBetween(*UP_TO))))
    head = head.withColumn("behind", F.max(signs.cast("int")).over(ordered.rowsBetween(*BEFORE)))
    named = head.filter((F.col("behind") == 1) & (F.col("angle") == 0) & word(F.col("token")) & ~F.coalesce(F.col("n1").isin(".", "::"), F.lit(False)) & ~F.col("token").isin("extends", "implements", "with", "public", "private", "protected", "virtual", "where", "by", "permits"))
    return named.groupBy("path", F.col("of").alias("pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("bases"))


# Types of receivers


def typed_names(s: Structure) -> DataFrame:
    """(path, block, name, type, pos): variables, fields and arguments whose type is declared or made by a constructor, and the block in which each holds (0: the file)."""
    t, lang = F.col("token"), F.col("language")
    n1, n2, n3, p1, p2, p3, p4 = (F.col(x) for x in ("n1", "n2", "n3", "p1", "p2", "p3", "p4"))
    style = per_language(lang, lambda s: F.lit(s.types))
    plain = word(p1) & ~p1.isin(*RESERVED)
    before = F.when(n1.isin("=", ";", ",", ")", ":"), F.when(plain, p1).when((p1 == ">") & (p3 == "<") & word(p4), p4).when(p1.isin("*", "&") & word(p2) & ~p2.isin(*RESERVED), p2))
    behind = F.when((n1 == ":") & word(n2), n2)
    go = F.when(p1.isin("var", "(", ","), F.when(word(n1), n1).when((n1 == "*") & word(n2), n2))
    made = F.when(n1.isin("=", ":="), F.when(n2 == "new", n3).when(n2.rlike(r"^\p{Lu}") & n3.isin("(", "{"), n2))
    kind = F.coalesce(F.when(style == "before", before).when(lang == "go", go).when(style == "behind", behind), made)
    found = s.tokens.filter(word(t) & ~t.isin(*RESERVED)).withColumn("type", kind).filter(F.col("type").isNotNull() & ~F.col("type").isin(*RESERVED)).select("path", "pos", "token", "type", "depth")
    heads = s.declarations.filter("head is not null and body is not null").select("path", "head", "head_shut", "body")
    # an argument belongs to the function whose brackets were opened last, if they are still open
    both = found.select("path", "pos", "token", "type", "depth", F.lit(None).cast("int").alias("shut"), F.lit(None).cast("int").alias("body")).union(heads.select("path", "head", F.lit(None), F.lit(None), F.lit(None), "head_shut", "body"))
    head = F.last(F.when(F.col("shut").isNotNull(), F.struct("shut", "body")), ignorenulls=True).over(by_file().rowsBetween(*UP_TO))
    found = both.withColumn("given", head).filter("token is not null").withColumn("given", F.when(F.col("given.shut") > F.col("pos"), F.col("given.body")))
    inner = chains(found.filter("given is null"), s.tokens).groupBy("path", "pos").agg(F.max_by("block", "level").alias("inner"))
    return found.join(inner, ["path", "pos"], "left").select("path", F.coalesce("given", "inner", F.lit(0)).alias("block"), F.col("token").alias("name"), "type", "pos")


def receiver_types(s: Structure) -> DataFrame:
    """The calls of s with `receiver_type`: the type of the receiver's nearest declaration, of the innermost block around the call that has one. In functions only what is declared before counts."""
    asked = s.calls.filter("receiver is not null").select("path", "pos", "depth", "receiver")
    around = chains(asked, s.tokens).union(asked.select("path", "pos", F.lit(0).alias("level"), F.lit(0).alias("block")))
    around = around.join(asked.select("path", "pos", "receiver"), ["path", "pos"])
    classes = s.declarations.filter("kind = 'class' and body is not null").select("path", F.col("body").alias("block"), F.lit(True).alias("of_class"))
    names = typed_names(s).join(classes, ["path", "block"], "left").select("path", "block", F.col("name").alias("receiver"), "type", F.col("pos").alias("declared"), F.coalesce("of_class", F.col("block") == 0).alias("anywhere"))
    hits = around.join(names, ["path", "block", "receiver"]).filter("anywhere or declared < pos")
    best = hits.groupBy("path", "pos").agg(F.max_by("type", F.struct("level", "declared")).alias("receiver_type"))
    return s.calls.join(best, ["path", "pos"], "left")


def elements(files: DataFrame, s: Structure) -> DataFrame:
    """What the resolution of calls and bases reads: a row an element, calls with the types of their receivers."""
    from .scanners import PATTERNS as LINES

    declared_ = s.declarations.select("path", "kind", "name", "line_number", "end_line", "complexity", "context", "class_context", "args", "bases")
    calls = receiver_types(s).select("path", F.lit("call").alias("kind"), "name", "line_number", "context", "class_context", "full_name", "receiver_type")
    found = F.lit(None).cast("array<string>")
    for language, (_, _, line) in LINES.items():
        found = F.when(F.col("language") == language, F.regexp_extract_all("text", F.lit("(?m)" + line), F.lit(1))).otherwise(found)
    imports = files.select("path", F.explode(found).alias("full_name")).select("path", F.lit("import").alias("kind"), F.element_at(F.split("full_name", r"[./:\\\\]+"), -1).alias("name"), "full_name", F.lit(None).cast("string").alias("alias"))
    return declared_.unionByName(calls, allowMissingColumns=True).unionByName(imports, allowMissingColumns=True)


# Modules of Ruby


def inclusions(s: Structure) -> DataFrame:
    """(path, name, module, how, pos): modules that a class or module includes, extends itself with or prepends."""
    rows = s.tokens.filter((F.col("language") == "ruby") & F.col("token").isin("include", "extend", "prepend") & F.col("first") & word(F.col("n1")))
    module = F.when(F.col("n2") == "::", F.col("n3")).otherwise(F.col("n1"))
    rows = rows.select("path", "pos", "depth", F.col("token").alias("how"), module.alias("module"))
    owners = s.declarations.filter("kind = 'class' and body is not null").select("path", F.col("body").alias("block"), "name")
    inner = chains(rows, s.tokens).join(owners, ["path", "block"]).groupBy("path", "pos").agg(F.max_by("name", "level").alias("name"))
    return rows.join(inner, ["path", "pos"]).select("path", "name", "module", "how", "pos")


def ancestors(parents: DataFrame, mixed: DataFrame) -> DataFrame:
    """(name, ancestor, place): in which order a class looks methods up.

    parents (name, parent); mixed (name, module, how, nth): of the same name the nth.
    Prepended modules come first, the last one foremost, then the class, then included
    ones, the last one foremost, then its parent's order; a module that comes up again
    later stays there alone, as a parent that has it makes a repeated include void.
    Names are expanded a level at a time; one that is its own ancestor is not expanded
    again.
    """
    rank = F.when(F.col("how") == "prepend", 0).otherwise(2)
    steps = mixed.filter("how <> 'extend'").select("name", F.col("module").alias("next"), rank.alias("rank"), (-F.col("nth")).cast("long").alias("turn"))
    steps = checkpoint(steps.union(parents.select("name", "parent", F.lit(3), F.lit(0).cast("long"))).distinct())
    at = checkpoint(steps.select("name").union(steps.select("next")).distinct().select("name", F.col("name").alias("ancestor"), F.array().cast("array<struct<rank:int,turn:bigint>>").alias("way"), F.array("name").alias("seen")))
    every = at
    while True:
        onward = at.join(steps.select(F.col("name").alias("ancestor"), "next", "rank", "turn"), "ancestor").filter(~F.expr("array_contains(seen, next)"))
        at = checkpoint(onward.select("name", F.col("next").alias("ancestor"), F.concat("way", F.array(F.struct("rank", "turn"))).alias("way"), F.concat("seen", F.array("next")).alias("seen")))
        if at.isEmpty():
            break
        every = every.union(at)
    # itself stands between what is prepended and what is included
    placed = every.select("name", "ancestor", F.concat("way", F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).cast("long").alias("turn")))).alias("way"))
    last = placed.groupBy("name", "ancestor").agg(F.max("way").alias("way"))
    return last.select("name", "ancestor", F.row_number().over(Window.partitionBy("name").orderBy("way")).alias("place"))


def looked_up(order: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, method, owner): which ancestor a class takes each method from. methods (name, method)."""
    found = order.join(methods.select(F.col("name").alias("ancestor"), "method"), "ancestor")
    return found.groupBy("name", "method").agg(F.min_by("ancestor", "place").alias("owner"))


# Queries: sources made of the warehouse's rows.


def java_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text): a class a nation, with a method a customer that calls a worker's; and the workers' files."""
    one = '  int f%d(int a, String b) {\n    // { not code\n    if (a > 1 && b != "}") { return helper.g%d(a); }\n    return a;\n  }\n'
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.format_string(one, x["c_custkey"], x["c_custkey"] % 3)), "")
    head = F.format_string("import w.W;\npublic class N%d extends Base {\n  private W%d helper;\n", "c_nationkey", F.col("c_nationkey") % 3)
    files = rows.select(F.format_string("/src/N%d.java", "c_nationkey").alias("path"), F.concat(head, body, F.lit("}\n")).alias("text"))
    workers = rows.select((F.col("c_nationkey") % 3).alias("k")).distinct().select(F.format_string("/src/w/W%d.java", "k").alias("path"), F.format_string("class W%d {\n  int g0(int a) { return a; }\n  int g1(int a) { return a; }\n  int g2(int a) { return a; }\n}\n", "k").alias("text"))
    return files.union(workers).select("path", F.lit("java").alias("language"), "text")


_METHODS = "SELECT '/src/N' || c_nationkey || '.java' AS path, 'N' || c_nationkey AS class_context, c_custkey, c_nationkey % 3 AS w, CAST(4 + 5 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS BIGINT) AS line FROM customer"


@on_tables(f"""WITH m AS ({_METHODS}) SELECT path, 'function' AS kind, 'f' || c_custkey AS name, line AS line_number, line + 4 AS end_line, CAST(3 AS BIGINT) AS complexity, 'a,b' AS args, '' AS bases, class_context FROM m
UNION ALL SELECT path, 'class', class_context, 2, max(line) + 5, NULL, '', 'Base', NULL FROM m GROUP BY path, class_context
UNION ALL SELECT '/src/w/W' || w || '.java', 'class', 'W' || w, 1, 5, NULL, '', '', NULL FROM m GROUP BY w
UNION ALL SELECT '/src/w/W' || w || '.java', 'function', 'g' || k, 2 + k, 2 + k, 1, 'a', '', 'W' || w FROM m, range(3) r(k) GROUP BY w, k""")
def java_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure(java_of(spark, sf_dir)).declarations
    return found.select("path", "kind", "name", "line_number", F.col("end_line").cast("long").alias("end_line"), F.col("complexity").cast("long").alias("complexity"), F.array_join(F.coalesce("args", F.array().cast("array<string>")), ",").alias("args"), F.array_join(F.coalesce("bases", F.array().cast("array<string>")), ",").alias("bases"), "class_context")


@on_tables(f"""WITH m AS ({_METHODS}) SELECT path, 'g' || c_custkey % 3 AS name, line + 2 AS line_number, 'f' || c_custkey AS context, 'W' || w AS receiver_type, '/src/w/W' || w || '.java' AS target, 'type' AS how FROM m""")
def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the type of their receiver resolves."""
    from .python_code import symbol_index
    from .resolution import resolve_calls

    files = checkpoint(java_of(spark, sf_dir))
    found = checkpoint(elements(files, structure(files)).withColumn("alias", F.col("alias").cast("string")))
    resolved = resolve_calls(found, symbol_index(found))
    return resolved.join(found.filter("kind = 'call'").select("path", "line_number", "name", "receiver_type"), ["path", "line_number", "name"]).select("path", "name", "line_number", "context", "receiver_type", "target", "how")


def ruby_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text): a module a region, a class a nation that includes those of its region and of the next one and prepends a common one; every third class has the one before it as its parent."""
    parent = F.when(F.col("n_nationkey") % 3 == 2, F.format_string(" < N%d", F.col("n_nationkey") - 1)).otherwise("")
    text = F.concat(F.format_string("class N%d", "n_nationkey"), parent, F.format_string("\n  include R%d\n  include R%d\n  prepend Top\n  def own; if true then 1 end; end\n  def m%d(a)\n    a\n  end\nend\n", "n_regionkey", (F.col("n_regionkey") + 1) % 5, F.col("n_nationkey") % 5))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string("/lib/n%d.rb", "n_nationkey").alias("path"), text.alias("text"))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.format_string("/lib/r%d.rb", "r_regionkey").alias("path"), F.format_string("module R%d\n  def m%d(a) # include No\n    a\n  end\nend\n", "r_regionkey", "r_regionkey").alias("text"))
    return nations.union(regions).select("path", F.lit("ruby").alias("language"), "text")


@on_tables("""SELECT 'N' || n_nationkey AS name, 'R' || n_regionkey AS module, 'include' AS how, CAST(1 AS BIGINT) AS nth FROM nation UNION ALL SELECT 'N' || n_nationkey, 'R' || (n_regionkey + 1) % 5, 'include', 2 FROM nation UNION ALL SELECT 'N' || n_nationkey, 'Top', 'prepend', 3 FROM nation""")
def ruby_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inclusions(structure(ruby_of(spark, sf_dir)))
    return found.select("name", "module", "how", F.row_number().over(Window.partitionBy("name").orderBy("path", "pos")).cast("long").alias("nth"))


@on_tables("""WITH n AS (SELECT 'N' || n_nationkey AS name, n_nationkey AS k, n_regionkey AS r, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey - 1 END AS p FROM nation),
own AS (SELECT name, name AS start, 0 AS level, r FROM n UNION ALL SELECT a.name, b.name, 1, b.r FROM n a JOIN n b ON b.k = a.p),
x AS (SELECT name, unnest([start, 'R' || (r + 1) % 5, 'R' || r, 'Top']) AS ancestor, level * 10 + unnest([1, 2, 3, 0]) AS place FROM own),
y AS (SELECT name, ancestor, max(place) AS place FROM x GROUP BY ALL),
z AS (SELECT name, ancestor, row_number() OVER (PARTITION BY name ORDER BY place) AS place FROM y)
SELECT name, ancestor, place FROM z UNION ALL SELECT DISTINCT ancestor, ancestor, 1 FROM z WHERE ancestor[1] IN ('R', 'T')""")
def ruby_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = structure(ruby_of(spark, sf_dir))
    mixed = inclusions(s).select("name", "module", "how", F.row_number().over(Window.partitionBy("name").orderBy("path", "pos")).alias("nth"))
    parents = s.declarations.filter("kind = 'class'").select("name", F.explode("bases").alias("parent"))
    return ancestors(parents, mixed).select("name", "ancestor", F.col("place").cast("long").alias("place"))

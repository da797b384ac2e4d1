"""Per-file facts: everything the analyses need to know about one file.

``facts`` is a single projection over ``files``: path facts plus the signals an
analysis asks for.  A full report writes the projection with all signals once
and then never touches file contents again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.sketch import bucket

C = F.col

MANIFESTS = sorted(
    {
        *R.FRAMEWORK_MANIFESTS, *R.README_NAMES, *R.COMPOSE_FILES, "package.json", "setup.py",
        "Makefile", "go.mod", "Cargo.toml", "Gemfile", ".gitignore", ".env", ".env.example",
    }
)


def identify(files: DataFrame) -> DataFrame:
    """Path facts and normalised content."""
    carriage = F.contains("content", F.lit("\r"))
    content = F.when(carriage, F.regexp_replace("content", "\r\n?", "\n")).otherwise(C("content"))
    suffix = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    return (
        files.withColumn("content", content)
        .withColumn("lowered", F.lower("content"))
        .withColumn("parts", F.split("path", "/"))
        .withColumn("name", F.substring_index("path", "/", -1))
        .withColumn("suffix", suffix)
        .withColumn("suffix_lower", F.lower("suffix"))
        .withColumn("stem", F.expr("left(name, length(name) - length(suffix))"))
        .withColumn("depth", F.size("parts"))
        .withColumn("top_dir", F.when(C("depth") > 1, F.substring_index("path", "/", 1)))
    )


def outside_pruned_dirs() -> Column:
    skipped = ", ".join(map(T.quoted, R.SKIP_DIRS))
    return F.expr(f"not exists(slice(parts, 1, depth - 1), d -> d in ({skipped}) or startswith(d, '.'))")


def not_binary() -> Column:
    return ~T.is_in("suffix_lower", R.BINARY_SUFFIXES)


def within_size(limit: int = R.MAX_SIZE_BYTES) -> Column:
    return C("size_bytes") <= limit


def scannable() -> Column:
    skipped = ", ".join(map(T.quoted, R.SCAN_SKIP_DIRS))
    return F.expr(f"not arrays_overlap(parts, array({skipped}))")


# --- imports and comments -------------------------------------------------------


def python_imports(content: Column) -> Column:
    """Distinct first components of imported modules; leading dots are dropped."""

    def names(statement: Column) -> Column:
        source = T.find(statement, r"^\s*from\s+\.*([\w.]*)")
        listed = F.regexp_replace(statement, r"^\s*import\s+", "")
        return F.when(T.has(statement, r"^\s*from\s"), F.array(source)).otherwise(F.split(listed, r"\s*,\s*"))

    modules = F.flatten(F.transform(T.find_all(content, R.PY_IMPORT, 0), names))
    tops = F.transform(modules, lambda m: F.substring_index(m, ".", 1))
    found = F.array_distinct(F.filter(tops, lambda m: m != ""))
    return F.when(F.contains(content, F.lit("import")), found).otherwise(T.empty("string"))


def script_imports(content: Column) -> Column:
    """Distinct module specifiers that are not relative."""
    statements = T.find_all(content, R.JS_IMPORT, 0)
    specifiers = F.transform(statements, lambda s: T.find(s, r"""['"]([@\w/.-]+)['"]\)?$"""))
    found = F.array_distinct(F.filter(specifiers, lambda s: (s != "") & ~F.startswith(s, F.lit("."))))
    wanted = F.contains(content, F.lit("import")) | F.contains(content, F.lit("require("))
    return F.when(wanted, found).otherwise(T.empty("string"))


def todos(content: Column) -> Column:
    hits = F.filter(
        T.numbered_lines(content), lambda s: F.contains(s["text"], F.lit("#")) & T.has(s["text"], R.TODO)
    )
    rows = F.transform(
        hits,
        lambda s: F.struct(
            s["line"].alias("line"),
            F.upper(T.find(s["text"], R.TODO, 1)).alias("kind"),
            T.strip(T.find(s["text"], R.TODO, 2)).alias("text"),
        ),
    )
    kind = "array<struct<line:int,kind:string,text:string>>"
    # lines are told apart only in a text that has a match at all
    some = F.contains(content, F.lit("#")) & T.has(content, R.TODO_MARK)
    return F.when(some, rows.cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))


def secret_lines(content: Column) -> Column:
    """First matching rule per line, unless the line looks like a reference to the environment."""
    some = "|".join(f"(?:{p})" for _, p in R.LINE_SECRETS)
    safe = "|".join(R.SAFE_LINE)
    hits = F.filter(T.numbered_lines(content), lambda s: T.has(s["text"], some) & ~T.has(s["text"], safe))

    def row(s: Column) -> Column:
        rule = F.coalesce(*(F.when(T.has(s["text"], p), F.lit(n)) for n, p in R.LINE_SECRETS))
        return F.struct(
            s["line"].alias("line"),
            rule.alias("rule"),
            T.strip(s["text"]).alias("snippet"),
        )

    kind = "array<struct<line:int,rule:string,snippet:string>>"
    rows = F.filter(F.transform(hits, row), lambda s: s["rule"].isNotNull()).cast(kind)
    found = T.holds_any(C("lowered"), R.LINE_SECRET_NEEDS) & T.has(content, some)
    return F.when(found, rows).otherwise(F.expr(f"cast(array() as {kind})"))


# --- frameworks -------------------------------------------------------------------

PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>"


def framework_hint(content: Column) -> Column:
    """The framework that a manifest names, wherever in the repository it lies."""
    lines = (R.PY_FRAMEWORK_LINE.replace("{marker}", re.escape(m)) for m in R.PY_FRAMEWORKS)
    python = F.coalesce(*(F.when(T.has(content, p), F.lit(m)) for m, p in zip(R.PY_FRAMEWORKS, lines)))
    package = F.from_json(content, PACKAGE_JSON)
    names = F.concat(*(F.coalesce(F.map_keys(package[s]), T.empty("string")) for s in ("dependencies", "devDependencies")))
    script = F.coalesce(*(F.when(F.array_contains(names, dep), F.lit(fw)) for fw, dep in R.JS_FRAMEWORKS))
    return F.when(T.is_in("name", R.FRAMEWORK_MANIFESTS), python).when(C("name") == "package.json", script)


# --- security ----------------------------------------------------------------------


def holds_any(pattern: str, needles: list[str]) -> Column:
    """Cheap test a match depends on; ``lowered`` is the content in lower case."""
    text = C("lowered") if pattern.startswith("(?i)") else C("content")
    return T.holds_any(text, needles)


def file_secrets(content: Column) -> Column:
    kind = "array<struct<severity:string,line:int,description:string>>"

    def rule(name: str, pattern: str, severity: str) -> Column:
        found = F.transform(
            T.matches_with_lines(content, pattern),
            lambda m: F.struct(
                F.lit(severity).alias("severity"),
                m["line"].alias("line"),
                F.concat(F.lit(f"Potential {name} detected: "), m["match"]).alias("description"),
            ),
        )
        needed = holds_any(pattern, R.SECRET_NEEDS[name])
        return F.when(needed, found.cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))

    return F.concat(*(rule(*r) for r in R.FILE_SECRETS))


def sql_strings(content: Column) -> Column:
    kind = "array<struct<line:int,description:string>>"

    def rule(pattern: str, needed: list[str]) -> Column:
        found = F.transform(
            T.matches_with_lines(content, pattern),
            lambda m: F.struct(
                m["line"].alias("line"),
                F.concat(F.lit("Potential SQL injection via string formatting: "), m["match"]).alias("description"),
            ),
        )
        return F.when(T.holds_any(C("lowered"), needed), found.cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))

    # every match holds a quote and a keyword
    possible = T.holds_any(content, ["'", '"']) & T.holds_any(C("lowered"), R.SQL_WORDS)
    every = F.concat(*(rule(*r) for r in R.SQL_INJECTION))
    return F.when(possible, every).otherwise(F.expr(f"cast(array() as {kind})"))


def auth_name(content: Column) -> Column:
    return F.coalesce(
        *(F.when(holds_any(p, R.AUTH_NEEDS[n]) & T.has(content, p), F.lit(n)) for n, p in R.AUTH_PATTERNS)
    )


def notices(content: Column) -> Column:
    """Every notice of a license that is worded as known, and every identifier line."""
    kind = "array<struct<line:int,license:string>>"

    def rule(license: str, pattern: str) -> Column:
        return F.transform(T.matches_with_lines(content, pattern), lambda m: F.struct(m["line"], F.lit(license))).cast(kind)

    named = F.transform(
        T.matches_with_lines(content, R.SPDX_NOTICE),
        lambda m: F.struct(m["line"], T.strip(F.regexp_replace(m["match"], "^[^:]*:", ""))),
    ).cast(kind)
    worded = T.holds_any(C("lowered"), ["licen", "subject to the terms"])
    found = F.concat(named, *(rule(*r) for r in R.LICENSE_NOTICES))
    return F.when(worded, found).otherwise(F.expr(f"cast(array() as {kind})"))


# --- API ---------------------------------------------------------------------------------


def zipped(content: Column, pattern: str, fields: list[str]) -> Column:
    """One struct per match with the groups 1.. as named strings."""
    groups = [T.find_all(content, pattern, i + 1) for i in range(len(fields))]
    return F.arrays_zip(*groups).cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")


def endpoint(method: Column, path: Column) -> Column:
    return F.struct(method.alias("method"), path.alias("route"))


ENDPOINTS = "struct<method:string,route:string>"


def when_any(content: Column, needle: str, value: Column, ddl: str) -> Column:
    return F.when(F.contains(content, F.lit(needle)), value.cast(f"array<{ddl}>")).otherwise(T.empty(ddl))


def flask_routes(content: Column) -> Column:
    def methods(r: Column) -> Column:
        named = F.transform(
            F.split(r["methods"], ",", -1), lambda m: F.upper(T.strip(T.strip(m), "\"'"))
        )
        listed = F.filter(named, lambda m: m != "")
        chosen = F.when(r["methods"] == "", F.array(F.lit("GET"))).otherwise(listed)
        return F.transform(chosen, lambda m: endpoint(m, r["path"]))

    rows = F.flatten(F.transform(zipped(content, R.FLASK_ROUTE, ["path", "methods"]), methods))
    return when_any(content, ".route(", rows, ENDPOINTS)


def fastapi_routes(content: Column) -> Column:
    found = zipped(content, R.FASTAPI_ROUTE, ["method", "path"])
    rows = F.transform(found, lambda r: endpoint(F.upper(r["method"]), r["path"]))
    return when_any(content, "@", rows, ENDPOINTS)


def django_routes(content: Column) -> Column:
    plain = F.transform(
        T.find_all(content, R.DJANGO_PATH, 1),
        lambda p: endpoint(F.lit("GET"), F.concat(F.lit("/"), T.lstrip(p, "/"))),
    )
    regexed = F.transform(
        T.find_all(content, R.DJANGO_RE_PATH, 1),
        lambda p: endpoint(
            F.lit("GET"), F.concat(F.lit("/"), T.rstrip(T.lstrip(T.lstrip(p, "/"), "^"), "$"))
        ),
    )
    return when_any(content, "path(", F.concat(plain, regexed), ENDPOINTS)


def express_routes(content: Column) -> Column:
    found = zipped(content, R.EXPRESS_ROUTE, ["method", "path"])
    rows = F.transform(found, lambda r: endpoint(F.upper(r["method"]), r["path"]))
    return rows.cast(f"array<{ENDPOINTS}>")


def next_page_routes(content: Column) -> Column:
    """Methods compared with in the handler, then unseen ones of the Allow header; GET if none."""
    compared = T.find_all(content, R.NEXT_METHOD, 1)
    allowed = T.find_all(T.find(content, R.NEXT_ALLOW, 1), r"""['"]([A-Z]+)['"]""", 1)
    fresh = F.array_distinct(F.filter(allowed, lambda m: ~F.array_contains(compared, m)))
    found = F.concat(compared, fresh)
    methods = F.when(F.size(found) == 0, F.array(F.lit("GET"))).otherwise(found)
    tail = F.regexp_replace(F.substring("path", len("pages/api/") + 1, 1 << 30), r"\.[jt]sx?$", "")
    tail = F.regexp_replace(tail, r"(^|/)index$", "")
    route = F.concat(F.lit("/api/"), F.regexp_replace(tail, r"\[([^\]]+)\]", "{$1}"))
    rows = F.transform(methods, lambda m: endpoint(m, route))
    inside = F.startswith("path", F.lit("pages/api/")) & T.is_in("suffix", R.JS_SUFFIXES)
    return F.when(inside, rows.cast(f"array<{ENDPOINTS}>")).otherwise(T.empty(ENDPOINTS))


def next_app_routes() -> Column:
    folder = F.expr("array_join(slice(parts, 3, greatest(depth - 3, 0)), '/')")
    row = F.array(endpoint(F.lit("GET"), F.concat(F.lit("/api/"), folder)))
    inside = (
        F.startswith("path", F.lit("app/api/"))
        & F.startswith("name", F.lit("route."))
        & C("suffix").isin(".js", ".ts")
    )
    return F.when(inside, row.cast(f"array<{ENDPOINTS}>")).otherwise(T.empty(ENDPOINTS))


COMMANDS = "struct<command:string,description:string>"


def click_commands(content: Column) -> Column:
    def row(r: Column) -> Column:
        named = F.when(r["explicit"] != "", r["explicit"]).otherwise(r["function"])
        summary = F.substring_index(T.strip(r["doc"]), "\n", 1)
        return F.struct(named.alias("command"), F.when(summary != "", summary).alias("description"))

    rows = F.transform(zipped(content, R.CLICK_COMMAND, ["explicit", "function", "doc"]), row)
    return when_any(content, ".command(", rows, COMMANDS)


def argparse_commands(content: Column) -> Column:
    rows = F.transform(
        zipped(content, R.ARGPARSE_PARSER, ["command", "help"]),
        lambda r: F.struct(r["command"], F.when(r["help"] != "", r["help"])),
    )
    return when_any(content, "add_parser(", rows, COMMANDS)


# --- conventions ------------------------------------------------------------------------------


# lines of one file, told apart by how they begin and end
TAB_LINE, FOUR_LINE, TWO_LINE = r"(?m)^\t", r"(?m)^    ", r"(?m)^  (?! )"
CODE_LINE = r"(?m)^[ \t\r]*+(?!//)[^\n]"
CLOSED_LINE = r"(?m)^[ \t\r]*+(?!//)[^\n]*;[ \t\r]*$"


def style_counts(content: Column) -> Column:
    """Counts the convention votes need from one source file."""
    return T.let(T.plain_breaks(content), lambda lined: style_struct(content, lined))


def style_struct(content: Column, lined: Column) -> Column:
    script = T.is_in("suffix", R.JS_SUFFIXES)

    def matches(pattern: str, *needles: str) -> Column:
        return T.count_of(content, pattern, list(needles))

    def in_lines(pattern: str, *needles: str) -> Column:
        return T.count_of(lined, pattern, list(needles) or None)

    def chars(char: str) -> Column:
        return F.length(content) - F.length(F.replace(content, F.lit(char), F.lit("")))

    def in_script(count: Column) -> Column:
        return F.when(script, count).otherwise(0)

    def by_language(python: str, js: str) -> Column:
        needles = ["import", "from", "require"]
        return (
            F.when(C("suffix") == ".py", matches(python, *needles)).when(script, matches(js, *needles)).otherwise(0)
        )

    return F.struct(
        matches(R.SNAKE_FUNCTION, "def").alias("snake"),
        (matches(R.CAMEL_FUNCTION, "function") + matches(R.CAMEL_VARIABLE, "const", "let", "var")).alias("camel"),
        matches(R.PASCAL_CLASS, "class").alias("pascal"),
        in_lines(TAB_LINE, "\t").alias("tabs"),
        in_lines(FOUR_LINE, "    ").alias("four"),
        in_lines(TWO_LINE, "  ").alias("two"),
        in_script(chars("'")).alias("singles"),
        in_script(chars('"')).alias("doubles"),
        in_script(in_lines(CLOSED_LINE, ";")).alias("semi"),
        in_script(in_lines(CODE_LINE)).alias("code_lines"),
        by_language(R.PY_RELATIVE_IMPORT, R.JS_RELATIVE_IMPORT).alias("relative"),
        by_language(R.PY_ABSOLUTE_IMPORT, R.JS_ABSOLUTE_IMPORT).alias("absolute"),
        (matches(R.TRY_EXCEPT, "try") + matches(R.TRY_CATCH, "try")).alias("tries"),
        matches(R.RESULT_TYPE, "Result<", ".unwrap()", ".expect(").alias("results"),
        matches(R.ERROR_FIRST, "err").alias("error_first"),
    )


def is_convention_source() -> Column:
    lowered = F.lower("name")
    parent = F.lower(F.coalesce(F.expr("get(parts, depth - 2)"), F.lit("")))
    return (
        scannable()
        & T.is_in("suffix", R.CONVENTION_SUFFIXES)
        & ~F.contains(lowered, F.lit("test"))
        & ~F.contains(lowered, F.lit("spec"))
        & ~parent.isin("tests", "__tests__")
    )


# --- the projection -----------------------------------------------------------------------------


@cache
def signals() -> dict[str, Callable[[], Column]]:
    """Extractions an analysis can ask for, by column name."""
    from . import exports  # which reads facts itself

    content = C("content")
    nothing = T.empty
    scan, python, script = scannable(), C("suffix") == ".py", T.is_in("suffix", R.JS_SUFFIXES)
    paged = F.array_contains("parts", F.lit("pages")) & F.array_contains("parts", F.lit("api"))
    trimmed = T.strip(content)

    def only(test: Column, value: Column, ddl: str) -> Column:
        return F.when(test, value).otherwise(nothing(ddl))

    return {
        # of the root only: at most one file of each name in a repository
        "manifest": lambda: F.when((C("depth") == 1) & T.is_in("name", MANIFESTS), content),
        # what nested manifests are read for as well
        "framework_hint": lambda: framework_hint(content),
        "imports": lambda: F.when(T.is_in("suffix", R.PY_GRAPH_SUFFIXES), python_imports(content))
        .when(T.is_in("suffix", R.JS_GRAPH_SUFFIXES), script_imports(content))
        .otherwise(nothing("string")),
        "todos": lambda: only(
            T.is_in("suffix", R.CODE_SUFFIXES), todos(content), "struct<line:int,kind:string,text:string>"
        ),
        "symbols": lambda: F.when(python, exports.python_symbols(content))
        .when(script, exports.script_symbols(content))
        .otherwise(nothing(exports.SYMBOL)),
        "links": lambda: F.when(python, exports.python_links(content))
        .when(script, exports.script_links(content))
        .otherwise(nothing(exports.LINK)),
        "line_secrets": lambda: secret_lines(content),
        "line_buckets": lambda: only(
            T.is_in("suffix", R.CODE_SUFFIXES), F.transform(T.split_lines(content), lambda s: bucket(F.length(s))), "int"
        ),
        "opens_with_docstring": lambda: python
        & (F.startswith(trimmed, F.lit('"""')) | F.startswith(trimmed, F.lit("'''"))),
        "has_docstring": lambda: F.contains(content, F.lit('"""')) | F.contains(content, F.lit("'''")),
        "reads_env": lambda: F.when(
            T.is_in("suffix", R.GLOSSARY_SUFFIXES), T.has(content, R.ENV_REFERENCE)
        ).otherwise(False),
        "terms": lambda: only(
            T.is_in("suffix", R.GLOSSARY_SUFFIXES),
            zipped(content, R.GLOSSARY_TERM, ["term", "meaning"]),
            "struct<term:string,meaning:string>",
        ),
        "style": lambda: F.when(is_convention_source(), style_counts(content)),
        "flask": lambda: only(python & scan, flask_routes(content), ENDPOINTS),
        "fastapi": lambda: only(python & scan, fastapi_routes(content), ENDPOINTS),
        "django": lambda: only((C("name") == "urls.py") & scan, django_routes(content), ENDPOINTS),
        "express": lambda: only(script & scan & ~paged, express_routes(content), ENDPOINTS),
        "next_pages": lambda: only(scan, next_page_routes(content), ENDPOINTS),
        "next_app": next_app_routes,
        "click": lambda: only(python & scan, click_commands(content), COMMANDS),
        "argparse": lambda: only(python & scan, argparse_commands(content), COMMANDS),
        "secrets": lambda: only(
            scan, file_secrets(content), "struct<severity:string,line:int,description:string>"
        ),
        "notices": lambda: only(scan, notices(content), "struct<line:int,license:string>"),
        "sql_strings": lambda: only(
            scan & T.is_in("suffix", R.SQL_SUFFIXES), sql_strings(content), "struct<line:int,description:string>"
        ),
        "auth": lambda: F.when(scan & C("suffix").isin(".py", ".js"), auth_name(content)),
        "env_names": lambda: F.when(python & scan, T.find_all(content, R.PY_ENV, 1))
        .when(C("suffix").isin(".js", ".ts") & scan, T.find_all(content, R.JS_ENV, 1))
        .otherwise(nothing("string")),
    }


@cache
def signal(name: str) -> Column:
    return signals()[name]()


def with_implied(names) -> list[str]:
    """Names of signals with those that come along: manifests are also read for the framework they name."""
    return [*names, *(["framework_hint"] if "manifest" in names and "framework_hint" not in names else [])]


def facts(files: DataFrame, *names: str, max_size: int | None = None) -> DataFrame:
    """One row per file with path facts and the named signals; file contents are left behind.

    The walk leaves out files above ``max_size`` bytes, if that is given.
    """
    small = F.lit(True) if max_size is None else within_size(max_size)
    columns = {
        "line_count": T.line_count(C("content")),
        "walkable": outside_pruned_dirs() & not_binary() & small,
        "scannable": scannable(),
        **{name: signal(name) for name in with_implied(names) or signals()},
    }
    return identify(files).withColumns(columns).drop("content", "lowered")


# --- scopes ------------------------------------------------------------------------------------------


def ignore_rules(files: DataFrame) -> DataFrame:
    """One regular expression per repository with rules in its root .gitignore.

    A rule is a shell glob whose star also crosses slashes.
    """
    rules = F.filter(
        F.transform(T.split_lines(C("content")), lambda s: T.strip(s)),
        lambda s: (s != "") & ~F.startswith(s, F.lit("#")),
    )

    def to_regex(rule: Column) -> Column:
        glob = T.lstrip(rule, "/")
        glob = F.regexp_replace(glob, r"([\\.+^$(){}|])", r"\\$1")
        glob = F.regexp_replace(glob, r"\[!", "[\x02")
        # a bracket without a partner is an ordinary character
        glob = F.regexp_replace(glob, r"\[(?![^\[\]]+\])", r"\\[")
        glob = F.regexp_replace(glob, "\x02", "^")
        return F.replace(F.replace(glob, F.lit("*"), F.lit("[^\n]*")), F.lit("?"), F.lit("[^\n]"))

    joined = F.array_join(F.transform(rules, to_regex), "|")
    return (
        identify(files.where(C("path") == ".gitignore"))
        .select("repo", F.concat(F.lit("(?dm)^(?:"), joined, F.lit(")$")).alias("pattern"))
        .where("pattern <> '(?dm)^(?:)$'")
    )


def mark_ignored(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored``: whether the path, a folder of it or its name matches a rule of the repository.

    A rule may match a single component, the path, or the path of any folder
    above; all these candidates are put on lines of one text and tested at once
    (by a function that keeps its last pattern compiled; rows of a repository
    mostly follow each other).
    """
    prefixes = F.transform("parts", lambda _, i: F.array_join(F.slice("parts", F.lit(1), i + 1), "/"))
    candidates = F.array_join(F.concat("parts", prefixes), "\n")
    joined = rows.join(rules.select("repo", "pattern"), "repo", "left")
    return joined.withColumn("ignored", F.coalesce(F.regexp_instr(candidates, C("pattern")) > 0, F.lit(False))).drop("pattern")


def drop_ignored(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return mark_ignored(rows, rules).where("not ignored").drop("ignored")


def with_walked(all_facts: DataFrame, rules: DataFrame) -> DataFrame:
    """All files, with a column that tells whether the walk keeps them."""
    marked = mark_ignored(all_facts, rules)
    return marked.withColumn("walked", C("walkable") & ~C("ignored")).drop("ignored")


def walked(all_facts: DataFrame, rules: DataFrame) -> DataFrame:
    """The files most analyses look at: source-like and not ignored.

    ``rules`` is a written table, so Spark knows its size and broadcasts it when
    it is below the session's threshold; then nothing is shuffled here.
    """
    return drop_ignored(all_facts.where("walkable"), rules).withColumn("walked", F.lit(True))

"""Coding conventions, voted on by the source files of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.sketch import quantiles, sketch
from ..functions.scale import first_rows, merge_on
from .facts import is_convention_source
from .manifests import repos

C = F.col


def sources(facts: DataFrame, *signals: str) -> DataFrame:
    return facts.where(is_convention_source()).select("repo", "path", "parts", "stem", "suffix", *signals)


def convention_sample(facts: DataFrame, limit: int = R.CONVENTION_SAMPLE) -> DataFrame:
    """The first source files of each repository: a report of examples, not the voters."""
    return first_rows(sources(facts), ["repo"], [F.asc("parts")], limit, "rank").select("repo", "rank", "path")


def for_every_repo(facts: DataFrame, rows: DataFrame) -> DataFrame:
    return repos(facts).join(rows, "repo", "left")


def indent() -> Column:
    tabs, two, four = C("style.tabs"), C("style.two"), C("style.four")
    return F.when((tabs > four) & (tabs > two), "tabs").when(four > two, "4").when(two > 0, "2")


def quotes() -> Column:
    singles, doubles = C("style.singles"), C("style.doubles")
    return F.when(singles > doubles, "single").when(doubles > singles, "double")


def indent_per_file(facts: DataFrame) -> DataFrame:
    return sources(facts, "style").select(
        "repo",
        "path",
        C("style.tabs").cast("bigint").alias("tab_lines"),
        C("style.two").cast("bigint").alias("two_space_lines"),
        C("style.four").cast("bigint").alias("four_space_lines"),
        indent().alias("indent"),
    )


def tally(vote: Column, choices: list[str], name: str) -> list[Column]:
    """Number of votes and first voter of each choice."""
    columns = []
    for choice in choices:
        columns.append(F.count_if(vote == choice).alias(f"{name}_{choice}"))
        columns.append(F.min(F.when(vote == choice, C("parts"))).alias(f"{name}_{choice}_seen"))
    return columns


def winner(choices: list[str], name: str) -> Column:
    """Choice with most votes; of equals the one seen first; null without votes."""
    rows = [
        F.when(
            C(f"{name}_{c}") > 0,
            F.struct((-C(f"{name}_{c}")).alias("votes"), C(f"{name}_{c}_seen").alias("seen"), F.lit(c).alias("choice")),
        )
        for c in choices
    ]
    return F.array_min(F.array(*rows))


INDENTS, QUOTES = ["tabs", "4", "2"], ["single", "double"]


def votes(facts: DataFrame) -> DataFrame:
    """All votes of the source files, in one partial aggregation."""
    script = T.is_in("suffix", R.JS_SUFFIXES)
    snake_file = F.contains("stem", F.lit("_")) & (C("stem") == F.lower("stem"))
    ending = C("style.semi") > C("style.code_lines") - C("style.semi")
    sums = ["snake", "camel", "pascal", "relative", "absolute", "tries", "results", "error_first"]
    return sources(facts, "style").groupBy("repo").agg(
        *(F.sum(f"style.{c}").alias(c) for c in sums),
        F.count_if(C("suffix") == ".py").alias("py_files"),
        F.count_if(script).alias("js_files"),
        F.count_if(snake_file).alias("snake_files"),
        F.count_if(F.contains("stem", F.lit("-"))).alias("kebab_files"),
        F.count_if(script & ending).alias("semi_files"),
        F.count_if(script & ~ending).alias("no_semi_files"),
        *tally(indent(), INDENTS, "indent"),
        *tally(quotes(), QUOTES, "quote"),
    )


def naming_columns() -> list[Column]:
    py, js = C("py_files") > 0, C("js_files") > 0
    return [
        F.when(py & js, "mixed").when(py, "snake_case").when(js, "camelCase").alias("variables"),
        F.when((C("snake") > 0) | (C("camel") > 0), F.when(C("snake") >= C("camel"), "snake_case").otherwise("camelCase")).alias(
            "functions"
        ),
        F.when(C("pascal") > 0, "PascalCase").alias("classes"),
        F.when(C("snake_files") > C("kebab_files"), "snake_case")
        .when(C("kebab_files") > C("snake_files"), "kebab-case")
        .alias("files"),
    ]


def indent_columns() -> list[Column]:
    choice = winner(INDENTS, "indent")["choice"]
    return [
        F.when(choice == "tabs", "tabs").when(choice.isNotNull(), "spaces").alias("indent_style"),
        F.when(choice != "tabs", choice).try_cast("int").alias("indent_width"),
    ]


def quote_column() -> Column:
    return winner(QUOTES, "quote")["choice"].alias("quotes")


def semicolon_column() -> Column:
    return F.when(C("js_files") > 0, C("semi_files") >= C("no_semi_files")).alias("semicolons")


def import_column() -> Column:
    relative, absolute = F.coalesce("relative", F.lit(0)), F.coalesce("absolute", F.lit(0))
    ratio = relative.cast("double") / F.when(relative + absolute > 0, relative + absolute)
    return (
        F.when(ratio.isNull(), "unknown")
        .when(ratio > 0.7, "relative")
        .when(ratio < 0.3, "absolute")
        .otherwise("mixed")
        .alias("import_style")
    )


def error_column() -> Column:
    tries, results, first = (F.coalesce(c, F.lit(0)) for c in ("tries", "results", "error_first"))
    return (
        F.when((tries >= results) & (tries >= first), "try-catch")
        .when(results >= first, "result-type")
        .otherwise("error-first")
        .alias("error_handling")
    )


def consistency_column() -> Column:
    total = sum((C(f"indent_{c}") for c in INDENTS[1:]), C(f"indent_{INDENTS[0]}"))
    leading = (-winner(INDENTS, "indent")["votes"]).cast("double")
    away = 1.0 - leading / F.when(total > 0, total)
    score = F.when(away.isNotNull(), F.greatest((100 - away * 100).cast("int"), F.lit(0)))
    return F.coalesce(score, F.lit(100)).alias("consistency_score")


def voted(facts: DataFrame) -> DataFrame:
    return for_every_repo(facts, votes(facts))


def naming_style(facts: DataFrame) -> DataFrame:
    return voted(facts).select("repo", *naming_columns())


def indent_style(facts: DataFrame) -> DataFrame:
    return voted(facts).select("repo", *indent_columns())


def quote_style(facts: DataFrame) -> DataFrame:
    return voted(facts).select("repo", quote_column())


def semicolon_style(facts: DataFrame) -> DataFrame:
    return voted(facts).select("repo", semicolon_column())


def import_style(facts: DataFrame) -> DataFrame:
    counted = [F.coalesce(c, F.lit(0)).alias(f"{c}_imports") for c in ("relative", "absolute")]
    return voted(facts).select("repo", *counted, import_column())


def error_handling(facts: DataFrame) -> DataFrame:
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tries", "results", "error_first")]
    return voted(facts).select("repo", *counted, error_column())


def consistency_score(facts: DataFrame) -> DataFrame:
    return voted(facts).select("repo", consistency_column())


def layout_columns() -> list[Column]:
    """Where tests lie, as switches per repository; no file is left out."""

    def seen(pattern: str, name: str) -> Column:
        return F.coalesce(F.bool_or(T.has(C("path"), pattern)), F.lit(False)).alias(name)

    return [
        seen(r"^tests?/", "tests_apart"),
        seen(r"(^|/)__tests__(/|$)", "tests_jest"),
        seen(r"\.(test|spec)\.js$", "tests_beside"),
    ]


def layout_column() -> Column:
    apart, jest, beside = C("tests_apart"), C("tests_jest"), C("tests_beside")
    return (
        F.when(apart & ~jest & ~beside, "separate-dir")
        .when(~apart & (beside | jest), "co-located")
        .when(apart, "mixed")
        .otherwise("unknown")
        .alias("test_pattern")
    )


def test_pattern(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(*layout_columns()).select("repo", layout_column())


def commit_format(commits: DataFrame, last: int | None = None) -> DataFrame:
    """The style of commit subjects; of the newest ``last`` commits only, if that is given."""
    rows = commits.select("repo", "committed_at", "commit_id", "subject")
    if last is not None:
        rows = first_rows(rows, ["repo"], [F.desc("committed_at"), F.desc("commit_id")], last, "rank")
    counted = rows.groupBy("repo").agg(
        F.count_if(T.has(C("subject"), R.CONVENTIONAL_SUBJECT)).alias("conventional"),
        F.count(F.lit(1)).alias("subjects"),
    )
    style = F.when(C("conventional") * 2 > C("subjects"), "conventional-commits").otherwise("freeform")
    return counted.select("repo", "conventional", "subjects", style.alias("commit_format"))


def linter_columns() -> list[Column]:
    place = F.array_position(F.expr(f"array({', '.join(map(T.quoted, R.LINTER_FILES))})"), C("path"))
    return [F.min(F.when(place > 0, place)).cast("int").alias("linter_place")]


def linter_column() -> Column:
    names = F.expr(f"array({', '.join(map(T.quoted, R.LINTER_FILES))})")
    return F.get(names, C("linter_place") - 1).alias("linter_config")


def linter_config(facts: DataFrame) -> DataFrame:
    return facts.groupBy("repo").agg(*linter_columns()).select("repo", linter_column())


def report_columns() -> list[Column]:
    return [
        *naming_columns(), *indent_columns(), quote_column(), semicolon_column(), import_column(),
        error_column(), layout_column(), C("commit_format"), linter_column(), consistency_column(),
    ]


def convention_report(facts: DataFrame, commits: DataFrame) -> DataFrame:
    layout = facts.groupBy("repo").agg(*layout_columns(), *linter_columns())
    rows = merge_on("repo", layout, [votes(facts), commit_format(commits)])
    return rows.select("repo", *report_columns())


def line_length(tree: DataFrame) -> DataFrame:
    """How long the lines of a repository's code are, and the usual limit that nearly all of them keep to.

    From a sketch of the lengths: exact below 256 characters, above too large by less than one part in 128.
    """
    lines = T.explode_kept(tree.select("repo", "line_buckets"), "line_buckets", "b")
    shares = {"p50": 0.5, "p95": 0.95, "p99": R.LINE_SHARE, "longest": 1.0}
    found = quantiles(sketch(lines, ["repo"], C("b")), ["repo"], shares)
    limit = F.lit(None).cast("bigint")
    for bound in reversed(R.LINE_LIMITS):
        limit = F.when(C("p99") <= bound, F.lit(bound).cast("bigint")).otherwise(limit)
    return found.select("repo", C("count").alias("lines"), *shares, limit.alias("line_limit"))

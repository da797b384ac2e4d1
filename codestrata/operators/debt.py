"""Technical debt: seven dimensions, hotspots, score and advice.  Higher is worse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import first_rows

C = F.col
WEIGHTS = R.DEBT_WEIGHTS


def fixed(value: Column, digits: int) -> Column:
    """Decimal text of a double, rounded half to even on its exact value."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def share(part: str, whole: str) -> Column:
    return C(part).cast("double") / F.when(C(whole) > 0, C(whole))


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(100))


def todo_comments(tree: DataFrame) -> DataFrame:
    hits = T.explode_kept(tree.where(T.is_in("suffix", R.CODE_SUFFIXES)).select("repo", "path", "todos"), "todos", "t")
    return hits.select("repo", "path", "t.line", "t.kind", "t.text")


def secret_lines(tree: DataFrame) -> DataFrame:
    hits = T.explode_kept(tree.select("repo", "path", "line_secrets"), "line_secrets", "s")
    return hits.select("repo", "path", "s.line", "s.rule", "s.snippet")


def count_columns() -> list[Column]:
    """Everything the dimensions count, as aggregates per repository."""
    code = C("walked") & T.is_in("suffix", R.CODE_SUFFIXES)
    lowered = F.lower("path")
    tested = F.contains(lowered, F.lit("test")) | F.contains(lowered, F.lit("spec"))
    python = C("walked") & (C("suffix") == ".py")
    return [
        F.sum(F.when(code, F.size("todos")).otherwise(0)).cast("bigint").alias("todo_count"),
        F.sum(F.when(code, C("line_count")).otherwise(0)).alias("code_lines"),
        F.count_if(code).alias("code_files"),
        F.count_if(code & tested).alias("test_files"),
        F.count_if(code & ~tested).alias("source_files"),
        F.count_if(code & (C("line_count") > R.COMPLEX_LINES)).alias("complex_files"),
        F.count_if(python).alias("python_files"),
        F.count_if(python & ~C("opens_with_docstring")).alias("undocumented_files"),
    ]


def counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("repo").agg(*count_columns())


def text_of(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def todo_score() -> tuple[Column, Column]:
    density = C("todo_count") / F.when(C("code_lines") > 0, C("code_lines") / 1000.0)
    detail = text_of(
        "%d TODO/FIXME/HACK comments across %d lines (%s per 1000 lines)",
        C("todo_count"), C("code_lines"), fixed(density, 1),
    )
    score = F.least((density * 10).cast("bigint"), F.lit(100)).cast("int")
    return (
        F.when(C("code_lines") > 0, score).otherwise(0),
        F.when(C("code_lines") > 0, detail).otherwise(R.NO_SOURCE),
    )


def test_score() -> tuple[Column, Column]:
    ratio = share("test_files", "source_files")
    score = F.greatest(F.least(((1 - ratio * 2) * 100).cast("bigint"), F.lit(100)), F.lit(0)).cast("int")
    detail = text_of(
        "%d test files vs %d source files (ratio: %s)", C("test_files"), C("source_files"), fixed(ratio, 2)
    )
    return (
        F.when(C("source_files") > 0, score).otherwise(0),
        F.when(C("source_files") > 0, detail).otherwise(R.NO_SOURCE),
    )


def complexity_score() -> tuple[Column, Column]:
    score = F.least((share("complex_files", "code_files") * 200).cast("int"), F.lit(100))
    score = F.when(C("code_files") > 0, score).otherwise(0)  # least() would skip a null
    some = text_of(f"%d files exceed {R.COMPLEX_LINES} lines.", C("complex_files"))
    none = F.lit(f"No files exceed {R.COMPLEX_LINES} lines.")
    return score, F.when(C("complex_files") > 0, some).otherwise(none)


def documentation_score() -> tuple[Column, Column]:
    ratio = share("undocumented_files", "python_files")
    detail = text_of(
        "%d/%d Python files lack module docstrings (%s%%)",
        C("undocumented_files"), C("python_files"), fixed(ratio * 100, 0),
    )
    return (
        F.when(C("python_files") > 0, F.least((ratio * 100).cast("int"), F.lit(100))).otherwise(0),
        F.when(C("python_files") > 0, detail).otherwise(R.NO_PYTHON),
    )


def dead_score() -> tuple[Column, Column]:
    ratio = share("dead_files", "python_files")
    detail = text_of(
        "%d/%d Python files have no imports from internal modules.", C("dead_files"), C("python_files")
    )
    return (
        F.when(C("python_files") > 0, clamp((ratio - 0.5) * 200)).otherwise(0),
        F.when(C("python_files") > 0, detail).otherwise(R.NO_PYTHON),
    )


def scored(rows: DataFrame, name: str, parts: tuple[Column, Column], *keep: str) -> DataFrame:
    score, detail = parts
    return rows.select("repo", *keep, score.alias("score"), detail.alias("detail"))


def todo_density(tree: DataFrame) -> DataFrame:
    return scored(counts(tree), "todo_density", todo_score(), "todo_count", "code_lines")


def test_ratio(tree: DataFrame) -> DataFrame:
    return scored(counts(tree), "test_coverage", test_score(), "test_files", "source_files")


def complexity(tree: DataFrame) -> DataFrame:
    return scored(counts(tree), "complexity", complexity_score(), "complex_files", "code_files")


def documentation_gap(tree: DataFrame) -> DataFrame:
    return scored(counts(tree), "documentation", documentation_score(), "undocumented_files", "python_files")


def hotspots(tree: DataFrame) -> DataFrame:
    """The ten longest files over the threshold."""
    long = tree.where(T.is_in("suffix", R.CODE_SUFFIXES) & (C("line_count") > R.COMPLEX_LINES)).select(
        "repo", "path", "parts", "line_count"
    )
    order = [F.desc("line_count"), F.asc("parts")]
    score = ((C("line_count") - R.COMPLEX_LINES) / 50.0 + 50).cast("bigint")
    reason = text_of(f"File has %d lines (threshold: {R.COMPLEX_LINES})", C("line_count"))
    return first_rows(long, ["repo"], order, 10, "rank").select(
        "repo", "rank", "path", reason.alias("reason"), F.least(score, F.lit(100)).cast("int").alias("score")
    )


def dead_modules(tree: DataFrame) -> DataFrame:
    """Python files that no Python file of the repository imports by name."""
    python = tree.where(C("suffix") == ".py")
    owners = python.groupBy("repo", C("stem").alias("module")).agg(F.max_by("path", "parts").alias("path"))
    used = T.explode_kept(python.select("repo", "imports"), "imports", "module").select("repo", "module").distinct()
    referenced = owners.join(used, ["repo", "module"], "left_semi").select("repo", "path")
    candidates = python.where((C("stem") != "__init__") & ~F.startswith("name", F.lit("test_"))).select("repo", "path")
    return candidates.join(referenced, ["repo", "path"], "left_anti")


def dead_counts(tree: DataFrame) -> DataFrame:
    return dead_modules(tree).groupBy("repo").agg(F.count(F.lit(1)).alias("dead_files"))


def with_dead(tree: DataFrame) -> DataFrame:
    return counts(tree).join(dead_counts(tree), "repo", "left").fillna(0, ["dead_files"])


def dead_code(tree: DataFrame) -> DataFrame:
    return scored(with_dead(tree), "dead_code", dead_score(), "dead_files", "python_files")


def dimension_columns() -> list[tuple[str, Column, Column]]:
    constant = lambda text: (F.lit(0), F.lit(text))
    parts = {
        "todo_density": todo_score(),
        "code_staleness": constant(R.STALENESS_DETAIL),
        "test_coverage": test_score(),
        "complexity": complexity_score(),
        "dependency_freshness": constant(R.FRESHNESS_DETAIL),
        "documentation": documentation_score(),
        "dead_code": dead_score(),
    }
    return [(name, *parts[name]) for name in WEIGHTS]


def dimensions_of(counted: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("dimension"),
            score.cast("int").alias("score"),
            F.lit(WEIGHTS[name]).alias("weight"),
            detail.alias("detail"),
        )
        for i, (name, score, detail) in enumerate(dimension_columns())
    ]
    return counted.select("repo", F.inline(F.array(*rows)))


def debt_dimensions(tree: DataFrame) -> DataFrame:
    return dimensions_of(with_dead(tree))


def ladder(value: Column, steps: list[tuple[int, str]], last: str, rising: bool) -> Column:
    """Label of the first bound that a value keeps to."""
    choice = None
    for bound, label in steps:
        test = value >= bound if rising else value <= bound
        choice = F.when(test, label) if choice is None else choice.when(test, label)
    return choice.otherwise(last)


def overall_of(dimensions: list[tuple[str, Column, Column]]) -> Column:
    """Weighted sum, added up in the order of the dimensions."""
    terms = [score.cast("double") * F.lit(WEIGHTS[name]) for name, score, _ in dimensions]
    return clamp(reduce(lambda a, b: a + b, terms))


def grade_of(score: Column) -> Column:
    return ladder(score, R.DEBT_GRADES, "F", rising=False)


def debt_score(tree: DataFrame) -> DataFrame:
    overall = with_dead(tree).select("repo", overall_of(dimension_columns()).alias("score"))
    return overall.withColumn("grade", grade_of(C("score")))


def advice_of() -> Column:
    """array<struct<rank, dimension, recommendation>>: the worst five dimensions, where above twenty.

    Seven dimensions are sorted inside the row; equal scores keep their order.
    """
    rows = []
    for i, (name, score, detail) in enumerate(dimension_columns()):
        before, after = R.DEBT_ADVICE.get(name, (None, None))
        text = F.concat(F.lit(before), detail, F.lit(after)) if before else F.lit(None).cast("string")
        place = (-score).cast("int")
        rows.append(
            F.struct(place.alias("place"), F.lit(i).alias("at"), F.lit(name).alias("dimension"), text.alias("text"))
        )
    worst = F.slice(F.array_sort(F.array(*rows)), 1, 5)
    ranked = F.transform(
        worst,
        lambda d, i: F.struct(
            (i + 1).alias("rank"), d["dimension"].alias("dimension"), d["text"].alias("recommendation"),
            d["place"].alias("place"),
        ),
    )
    return F.filter(ranked, lambda d: (d["place"] < -20) & d["recommendation"].isNotNull())


def debt_recommendations(tree: DataFrame) -> DataFrame:
    rows = with_dead(tree).select("repo", F.explode(advice_of()).alias("a"))
    return rows.select("repo", "a.rank", "a.dimension", "a.recommendation")


def debt_chart_rows(tree: DataFrame) -> DataFrame:
    return debt_dimensions(tree).select(
        "repo",
        "position",
        F.initcap(F.replace("dimension", F.lit("_"), F.lit(" "))).alias("label"),
        "score",
        ladder(C("score"), R.DEBT_COLOURS, R.WORST_COLOUR, rising=False).alias("colour"),
    )

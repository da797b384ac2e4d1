"""HTTP routes and command-line commands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col
# columns of the facts in the order in which routes are listed
ROUTE_KINDS = ["flask", "fastapi", "django", "express", "next_pages", "next_app"]
COMMAND_KINDS = ["click", "argparse"]


def routes(facts: DataFrame, kind: str) -> DataFrame:
    hits = T.explode_kept(facts.select("repo", "path", kind), kind, "r")
    return hits.select("repo", C("path").alias("handler_file"), "r.method", "r.route")


def commands(facts: DataFrame, kind: str) -> DataFrame:
    hits = T.explode_kept(facts.select("repo", "path", kind), kind, "c")
    return hits.select("repo", C("path").alias("handler_file"), "c.command", "c.description")


def tagged(facts: DataFrame, kinds: list[str]) -> Column:
    """All rows of several kinds as one array, each with its kind."""

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("row")))

    return F.concat(*map(of_kind, kinds))


def endpoints(facts: DataFrame) -> DataFrame:
    """Every route of every kind, from one pass over the files."""
    rows = facts.select("repo", "path", tagged(facts, ROUTE_KINDS).alias("all"))
    hits = T.explode_kept(rows, "all", "r")
    return hits.select("repo", "r.kind", C("path").alias("handler_file"), "r.row.method", "r.row.route")


def cli_commands(facts: DataFrame) -> DataFrame:
    rows = facts.select("repo", "path", tagged(facts, COMMAND_KINDS).alias("all"))
    hits = T.explode_kept(rows, "all", "c")
    return hits.select("repo", "c.kind", C("path").alias("handler_file"), "c.row.command", "c.row.description")


def total_size(kinds: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.size(k) for k in kinds))


def route_columns() -> list[Column]:
    """Routes, and routes in files without any docstring quotes; counted file by file, so no join is needed."""
    routes = total_size(ROUTE_KINDS)
    return [
        F.sum(routes).cast("bigint").alias("total_routes"),
        F.sum(F.when(~C("has_docstring"), routes).otherwise(0)).cast("bigint").alias("undocumented_routes"),
    ]


def command_columns() -> list[Column]:
    return [
        F.sum(total_size(COMMAND_KINDS)).cast("bigint").alias("total_commands"),
        F.bool_or(C("path").isin("setup.py", "pyproject.toml")).alias("packaged"),
    ]


def undocumented_routes(facts: DataFrame) -> DataFrame:
    return facts.groupBy("repo").agg(*route_columns())


def report_columns() -> list[Column]:
    http, cli = C("total_routes") > 0, C("total_commands") > 0
    kind = F.when(http & cli, "mixed").when(cli, "cli").when(http, "rest").when(C("packaged"), "library").otherwise("rest")
    return [kind.alias("api_type"), C("total_routes"), C("total_commands"), C("undocumented_routes")]


def api_report(facts: DataFrame) -> DataFrame:
    return facts.groupBy("repo").agg(*route_columns(), *command_columns()).select("repo", *report_columns())

"""All per-repository counts, switches and root texts that several reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api, architecture, conventions, debt, onboarding, security
from .manifests import is_root_file, root_columns

C = F.col
SIGNALS = [
    *api.ROUTE_KINDS, *api.COMMAND_KINDS, "manifest", "imports", "todos", "opens_with_docstring", "has_docstring",
    "secrets", "sql_strings", "style", "reads_env", "auth",
]


def profile(every: DataFrame) -> DataFrame:
    """All counts and switches of a repository, from one pass over its facts."""
    entries = F.count_if(C("walked") & architecture.is_entry_point()).alias("entry_point_count")
    return every.groupBy("repo").agg(
        F.count_if("walked").alias("total_files"),
        F.sum(F.when(C("walked"), C("line_count")).otherwise(0)).alias("total_lines"),
        entries,
        *architecture.kind_columns()[:2],
        *onboarding.presence_columns(),
        *debt.count_columns(),
        *api.route_columns(),
        *api.command_columns(),
        *security.finding_columns(),
        *conventions.layout_columns(),
        *conventions.linter_columns(),
    )


def texts(every: DataFrame) -> DataFrame:
    """Root manifests, frameworks and the authentication pattern, from the few files that show them."""
    telling = is_root_file() | architecture.has_framework_file() | C("auth").isNotNull()
    return every.where(telling).groupBy("repo").agg(
        *root_columns(), *architecture.framework_columns(), security.auth_column()
    )

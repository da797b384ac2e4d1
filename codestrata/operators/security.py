"""Secrets, injection risks, exposed files and ports, and the risk they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .manifests import repos, roots, there

C = F.col
FINDING = ["repo", "severity", "category", "file", "line", "description"]


def finding(repo_rows: DataFrame, severity: str, category: str, description: str) -> DataFrame:
    return repo_rows.select(
        "repo",
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(".env").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(description).alias("description"),
    )


def secret_findings(facts: DataFrame) -> DataFrame:
    hits = T.explode_kept(facts.select("repo", "path", "secrets"), "secrets", "s")
    return hits.select(
        "repo", "s.severity", F.lit("hardcoded-secret").alias("category"), C("path").alias("file"),
        "s.line", "s.description",
    )


def sql_injection(facts: DataFrame) -> DataFrame:
    hits = T.explode_kept(facts.select("repo", "path", "sql_strings"), "sql_strings", "s")
    return hits.select(
        "repo", F.lit("medium").alias("severity"), F.lit("sql-injection").alias("category"),
        C("path").alias("file"), "s.line", "s.description",
    )


def source_findings(facts: DataFrame) -> DataFrame:
    """Secrets and injection risks together, from one pass over the files."""
    secrets = F.transform(
        "secrets",
        lambda s: F.struct(
            s["severity"].alias("severity"), F.lit("hardcoded-secret").alias("category"),
            s["line"].alias("line"), s["description"].alias("description"),
        ),
    )
    sql = F.transform(
        "sql_strings",
        lambda s: F.struct(
            F.lit("medium").alias("severity"), F.lit("sql-injection").alias("category"),
            s["line"].alias("line"), s["description"].alias("description"),
        ),
    )
    hits = T.explode_kept(facts.select("repo", "path", F.concat(secrets, sql).alias("all")), "all", "f")
    return hits.select("repo", "f.severity", "f.category", C("path").alias("file"), "f.line", "f.description")


def unprotected_env() -> Column:
    ignored = F.contains(F.coalesce("gitignore", F.lit("")), F.lit(".env"))
    return there("env") & ~ignored


def env_exposed(facts: DataFrame) -> DataFrame:
    return finding(roots(facts).where(unprotected_env()), "high", "env-file-exposed", R.ENV_EXPOSED)


def env_history_repos(commit_files: DataFrame) -> DataFrame:
    return commit_files.where(F.endswith("path", F.lit(".env"))).select("repo").distinct()


def env_in_history(facts: DataFrame, commit_files: DataFrame) -> DataFrame:
    touched = repos(facts).join(env_history_repos(commit_files), "repo", "left_semi")
    return finding(touched, "critical", "env-file-in-git", R.ENV_IN_GIT)


def ports() -> Column:
    """Distinct ports of the compose files of one repository."""

    def in_file(content: Column) -> Column:
        number = lambda s: s.try_cast("bigint")
        pairs = F.concat(
            F.transform(T.find_all(content, R.PORT_PAIR, 1), number),
            F.transform(T.find_all(content, R.PORT_PAIR, 2), number),
        )
        bare = F.transform(T.find_all(content, R.BARE_PORT, 1), number)
        return F.concat(pairs, F.filter(bare, lambda p: p.between(1, 65535)))

    texts = [F.coalesce(f"compose_{i}", F.lit("")) for i in range(1, 5)]
    return F.array_sort(F.array_distinct(F.concat(*map(in_file, texts))))


def exposed_ports(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", F.explode(ports()).alias("port")).where("port is not null")


def auth_column() -> Column:
    """Pattern of the first Python file that shows one, else of the first JavaScript file."""
    order = F.struct((C("suffix") == ".js").alias("script"), C("parts"))
    return F.min_by("auth", F.when(C("auth").isNotNull(), order)).alias("auth_pattern")


def auth_pattern(facts: DataFrame) -> DataFrame:
    found = facts.where("auth is not null").groupBy("repo").agg(auth_column())
    return repos(facts).join(found, "repo", "left")


def security_findings(facts: DataFrame, commit_files: DataFrame) -> DataFrame:
    return (
        source_findings(facts)
        .unionByName(env_exposed(facts))
        .unionByName(env_in_history(facts, commit_files))
    )


def finding_columns() -> list[Column]:
    return [
        F.sum(F.size("secrets")).cast("bigint").alias("secrets_found"),
        F.sum(F.size("sql_strings")).cast("bigint").alias("sql_found"),
    ]


def security_flags(facts: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Counts and switches per repository that risk and advice depend on."""
    counted = facts.groupBy("repo").agg(*finding_columns())
    exposed = roots(facts).select("repo", unprotected_env().alias("env_exposed"), ports().alias("ports"))
    history = env_history_repos(commit_files).withColumn("env_in_history", F.lit(True))
    return counted.join(exposed, "repo").join(history, "repo", "left").fillna(False, ["env_in_history"])


def risk_of() -> Column:
    env = C("env_exposed") | C("env_in_history")
    return (
        F.when(C("secrets_found") > 0, "critical")
        .when(env, "high")
        .when(C("sql_found") > 0, "medium")
        .otherwise("low")
    )


def risk_level(facts: DataFrame, commit_files: DataFrame) -> DataFrame:
    flags = security_flags(facts, commit_files)
    return flags.select("repo", "secrets_found", risk_of().alias("risk_level"))


def advice() -> Column:
    """array<string> of the advice that applies, in its fixed order."""
    served = F.arrays_overlap("ports", F.array(F.lit(80).cast("bigint"), F.lit(8080).cast("bigint")))
    tests = [
        C("secrets_found") > 0,
        C("env_exposed") | C("env_in_history"),
        C("sql_found") > 0,
        C("auth_pattern").isNull(),
        F.coalesce(served, F.lit(False)),
    ]
    given = F.array(*(F.when(t, F.lit(text)) for t, text in zip(tests, R.SECURITY_ADVICE)))
    given = F.filter(given, lambda x: x.isNotNull())
    return F.when(F.size(given) == 0, F.array(F.lit(R.SECURITY_ADVICE[-1]))).otherwise(given)


def security_recommendations(facts: DataFrame, commit_files: DataFrame) -> DataFrame:
    flags = security_flags(facts, commit_files).join(auth_pattern(facts), "repo")
    return flags.select("repo", F.posexplode(advice()).alias("position", "recommendation"))

"""Health scores per analysis and their colours.  Higher is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import merge_on
from .conventions import consistency_column, votes
from .debt import dead_counts, debt_score, dimension_columns, grade_of, ladder, overall_of
from .dependencies import dependency_counts
from .dependencies import risk_of as dependency_risk_of
from .manifests import complete
from .onboarding import setup_steps_of
from .profile import profile, texts
from .security import env_history_repos, risk_of, unprotected_env
from .setup import prerequisites_of

C = F.col
LABELS = {
    "tech_debt": "Tech Debt", "architecture": "Architecture", "dependencies": "Dependencies",
    "conventions": "Conventions", "api": "API", "security": "Security", "onboarding": "Onboarding",
    "setup": "Setup",
}


def health_grade(score: Column) -> Column:
    return ladder(score, R.HEALTH_GRADES, "F", rising=True)


def score_colour(score: Column) -> Column:
    return ladder(score, R.SCORE_COLOURS, R.WORST_COLOUR, rising=True)


def badge_colour(grade: str) -> Column:
    return F.coalesce(T.lookup(R.BADGE_COLOURS, f"upper({grade})"), F.lit(R.UNKNOWN_BADGE))


def security_health(level: str) -> Column:
    return F.coalesce(T.lookup(R.SECURITY_SCORE, level), F.lit(50))


def api_health() -> Column:
    documented = 1 - C("undocumented_routes").cast("double") / F.greatest("total_routes", F.lit(1))
    return F.when(C("total_routes") > 0, (documented * 100).cast("int")).otherwise(100)


def score_table(every: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Inputs of the scorecard, one row per repository, from facts that know which files the walk keeps."""
    tree = every.where("walked")
    statuses = dependency_counts(every)
    history = env_history_repos(commit_files).withColumn("env_in_history", F.lit(True))
    parts = [texts(every), dead_counts(tree), statuses, votes(every), history]
    rows = complete(merge_on("repo", profile(every), parts))
    zero = {"dead_files": 0, "total_deps": 0, "outdated_count": 0, "env_in_history": False}
    rows = rows.fillna(zero).withColumn("env_exposed", unprotected_env())
    overall = overall_of(dimension_columns())
    scored = rows.select(
        "repo",
        (100 - overall).alias("tech_debt"),
        grade_of(overall).alias("debt_grade"),
        F.lit(R.ARCHITECTURE_SCORE).alias("architecture"),
        (100 - dependency_risk_of()).alias("dependencies"),
        consistency_column().alias("conventions"),
        api_health().alias("api"),
        risk_of().alias("risk_level"),
        F.when(F.size(setup_steps_of()) > 0, 80).otherwise(50).alias("onboarding"),
        F.when(F.size(prerequisites_of()) > 0, 80).otherwise(50).alias("setup"),
    )
    return scored.withColumn("security", security_health("risk_level"))


def scorecard(table: DataFrame) -> DataFrame:
    rows = []
    for i, (key, label) in enumerate(LABELS.items()):
        score = C(key).cast("int")
        grade = C("debt_grade") if key == "tech_debt" else health_grade(score)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("position"), F.lit(key).alias("analysis"), F.lit(label).alias("label"),
                score.alias("score"), grade.alias("grade"), score_colour(score).alias("colour"),
            )
        )
    return table.select("repo", F.inline(F.array(*rows))).where("score is not null")


def overall_health(table: DataFrame) -> DataFrame:
    scores = scorecard(table).groupBy("repo").agg(F.floor(F.avg("score")).cast("int").alias("overall"))
    return scores.select("repo", "overall", health_grade(C("overall")).alias("overall_grade"))


def score_band(tree: DataFrame) -> DataFrame:
    """Both colour scales and the badge colour for the debt score of each repository."""
    debt = debt_score(tree)
    return debt.select(
        "repo",
        "score",
        "grade",
        ladder(C("score"), R.DEBT_COLOURS, R.WORST_COLOUR, rising=False).alias("debt_colour"),
        score_colour(100 - C("score")).alias("health_colour"),
        badge_colour("grade").alias("badge_colour"),
    )

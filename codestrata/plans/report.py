"""The full report: eight nested sections per repository, and its long lists as rows.

Sections hold scalars and lists with a bound (top twenty, one repository's root
manifests, ...).  Lists without a bound - findings, routes, import edges - are
rows of ``report_items``, so no repository's list is ever gathered in one place.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import scale
from ..functions.scale import kept, merge_on, stage
from ..operators import api, architecture, conventions, debt, dependencies, facts, history
from ..operators import languages, onboarding, security, setup
from ..operators.manifests import complete
from ..operators.profile import profile, texts
from ..sources.corpus import Corpus
from ..sources.snapshots import REPORTS, SECTION_TYPES, read_snapshots, write_snapshot

C = F.col
ANALYSES = ["arch", "debt", "onboarding", "deps", "conventions", "api", "security", "setup"]
SECTIONS = {
    "arch": "architecture", "debt": "tech_debt", "onboarding": "onboarding", "deps": "dependencies",
    "conventions": "conventions", "api": "api", "security": "security", "setup": "setup",
}


def staged_facts(corpus: Corpus, *signals: str) -> DataFrame:
    """Signals of all files (all of them by default) and whether the walk keeps the file, written once."""
    return stage(facts.with_walked(facts.facts(corpus.files, *signals), corpus.rules), "facts")


def listed(rows: DataFrame, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Bounded list per repository, in order."""
    value = C(columns[0]) if len(columns) == 1 else F.struct(*columns)
    item = F.struct(*order, value.alias("item"))
    gathered = rows.groupBy("repo").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return gathered.select("repo", C("rows")["item"].alias(name))


def mapped(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return rows.groupBy("repo").agg(F.map_from_entries(pairs).alias(name))


def counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))


def debt_columns() -> list[Column]:
    dims = debt.dimension_columns()

    def entry(name: str, score: Column, detail: Column) -> Column:
        value = F.struct(score.cast("int").alias("score"), F.lit(debt.WEIGHTS[name]).alias("weight"), detail.alias("detail"))
        return F.struct(F.lit(name), value)

    overall = debt.overall_of(dims)
    return [
        overall.alias("overall_score"),
        debt.grade_of(overall).alias("grade"),
        F.map_from_entries(F.array(*(entry(*d) for d in dims))).alias("dimensions"),
        C("hotspots"),
        debt.advice_of()["recommendation"].alias("recommendations"),
    ]


def security_columns() -> list[Column]:
    in_git = F.when(C("env_exposed") | C("env_in_history"), F.array(F.lit(".env")))
    return [
        security.risk_of().alias("risk_level"),
        C("secrets_found"),
        C("sql_found"),
        in_git.alias("env_files_in_git"),
        C("ports").alias("exposed_ports"),
        C("auth_pattern"),
        security.advice().alias("recommendations"),
    ]


def setup_columns() -> list[Column]:
    step = F.struct(*(F.lit(x).alias(n) for n, x in zip(("description", "command"), R.DATABASE_STEP)))
    return [
        setup.prerequisites_of().alias("prerequisites"),
        setup.install_steps_of().alias("install_steps"),
        F.when(setup.database_of(), step).alias("database_setup"),
        setup.build_command_of().alias("build_command"),
        setup.run_commands_of().alias("run_commands"),
        setup.test_command_of().alias("test_command"),
        setup.common_issues_of().alias("common_issues"),
    ]


def report_over(every: DataFrame, commits: DataFrame, commit_files: DataFrame, analyses=None) -> DataFrame:
    """Report rows from staged facts; sections that are not asked for are null and not computed."""
    unknown = set(analyses or []) - set(ANALYSES)
    if unknown:
        raise ValueError(f"unknown analyses: {sorted(unknown)}")
    run = set(analyses or ANALYSES)
    if "onboarding" in run:
        run.add("arch")

    tree = every.where("walked")
    key_columns = ["path", "role", "importance_score"]

    def breakdown() -> DataFrame:
        return languages.language_breakdown(tree)

    def arch_parts() -> list[DataFrame]:
        edges = architecture.import_edges(tree)
        keys = architecture.key_files(tree, edges)
        return [
            architecture.structure_pattern(tree),
            counted(edges, "edge_count"),
            mapped(breakdown(), "language", "percentage", "language_breakdown"),
            listed(keys, ["rank"], key_columns, "key_files"),
        ]

    def debt_parts() -> list[DataFrame]:
        return [debt.dead_counts(tree), listed(debt.hotspots(tree), ["rank"], ["path", "reason", "score"], "hotspots")]

    def onboarding_parts() -> list[DataFrame]:
        people = history.top_contributors(commits)
        return [
            *onboarding.overview_parts(breakdown(), architecture.entry_points(tree), architecture.layers(tree)),
            listed(people, ["rank"], ["name", "email", "recent_commits"], "top_contributors"),
            mapped(onboarding.first_terms(tree), "term", "meaning", "glossary"),
        ]

    def dependency_parts() -> list[DataFrame]:
        deps = dependencies.dependencies(every)
        statuses = dependencies.count_statuses(deps)
        return [statuses, listed(deps, ["position"], ["name", "current_version", "license", "status"], "deps")]

    parts = {
        "arch": arch_parts,
        "debt": debt_parts,
        "onboarding": onboarding_parts,
        "deps": dependency_parts,
        "conventions": lambda: [conventions.votes(every), conventions.commit_format(commits)],
        "security": lambda: [security.env_history_repos(commit_files).withColumn("env_in_history", F.lit(True))],
    }
    chosen = [part for analysis, build in parts.items() if analysis in run for part in build()]
    rows = complete(merge_on("repo", profile(every), [texts(every), history.head_commit(commits), *chosen]))
    zero = {"edge_count": 0, "dead_files": 0, "total_deps": 0, "outdated_count": 0, "env_in_history": False}
    rows = rows.fillna({c: v for c, v in zero.items() if c in rows.columns})
    rows = rows.withColumn("framework", architecture.framework_of())
    rows = rows.withColumn("project_type", architecture.project_type_of(C("framework")))
    if "security" in run:
        rows = rows.withColumns({"env_exposed": security.unprotected_env(), "ports": security.ports()})

    def arch_columns() -> list[Column]:
        names = [
            "project_type", "framework", "structure_pattern", "key_files", "language_breakdown", "total_files",
            "total_lines", "entry_point_count", "edge_count",
        ]
        return [C(n) for n in names]

    def onboarding_columns() -> list[Column]:
        return [
            onboarding.project_summary().alias("project_summary"),
            onboarding.overview_of().alias("architecture_overview"),
            F.slice("key_files", 1, 10).alias("key_files"),
            onboarding.setup_steps_of().alias("setup_steps"),
            onboarding.test_commands_of().alias("test_commands"),
            C("top_contributors"),
            onboarding.gotchas_of().alias("gotchas"),
            C("glossary"),
        ]

    def dependency_columns() -> list[Column]:
        return [
            dependencies.manager_of().alias("package_manager"),
            C("total_deps"),
            C("total_deps").alias("direct_deps"),
            C("outdated_count"),
            F.lit(0).alias("vulnerability_count"),
            dependencies.risk_of().alias("risk_score"),
            C("deps"),
        ]

    columns = {
        "arch": arch_columns, "debt": debt_columns, "onboarding": onboarding_columns, "deps": dependency_columns,
        "conventions": conventions.report_columns, "api": api.report_columns, "security": security_columns,
        "setup": setup_columns,
    }
    shown = []
    for analysis in ANALYSES:
        if analysis in run:
            shown.append(F.struct(*columns[analysis]()).alias(SECTIONS[analysis]))
        else:
            shown.append(F.lit(None).cast(SECTION_TYPES[SECTIONS[analysis]]).alias(SECTIONS[analysis]))
    return rows.select("repo", "head_commit", *shown)


# what each section is made of, besides paths
SIGNALS: dict[str, tuple[str, ...]] = {
    "arch": ("manifest", "imports"),
    "debt": ("manifest", "imports", "todos", "opens_with_docstring"),
    "onboarding": ("manifest", "imports", "reads_env", "terms"),
    "deps": ("manifest",),
    "conventions": ("manifest", "style"),
    "api": (*api.ROUTE_KINDS, *api.COMMAND_KINDS, "has_docstring", "manifest"),
    "security": ("manifest", "secrets", "sql_strings", "auth"),
    "setup": ("manifest", "reads_env", "env_names"),
}


def facts_for(corpus: Corpus, analyses, lists: list[str] = ()) -> DataFrame:
    """Facts with the signals of the analyses and lists only; the other signals are null columns that were never extracted."""
    kinds = kept(corpus.files.sparkSession, "signal types", lambda: {f.name: f.dataType for f in facts.facts(corpus.files).schema})
    chosen = {s for a in analyses or ANALYSES for s in SIGNALS.get(a, ())} | {s for name in lists for s in LISTS[name][1]}
    wanted = facts.with_implied(sorted(chosen))
    rows = staged_facts(corpus, *wanted)
    return rows.withColumns({s: F.lit(None).cast(kinds[s]) for s in facts.signals() if s not in wanted})


def full_report(corpus: Corpus, analyses=None) -> DataFrame:
    return report_over(facts_for(corpus, analyses), corpus.commits, corpus.commit_files, analyses)


# lists without a bound: section, name, and the signals of files they are made of
LISTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "entry_points": ("architecture", ("manifest",)),
    "layers": ("architecture", ("manifest",)),
    "internal_deps": ("architecture", ("manifest", "imports")),
    "scored_files": ("architecture", ("manifest", "imports")),
    "endpoints": ("api", tuple(api.ROUTE_KINDS)),
    "cli_commands": ("api", tuple(api.COMMAND_KINDS)),
    "findings": ("security", ("manifest", "secrets", "sql_strings")),
    "env_vars": ("setup", ("manifest", "env_names")),
}
SHOWN = [name for name in LISTS if name != "scored_files"]


def items_over(every: DataFrame, commit_files: DataFrame, names: list[str]) -> DataFrame:
    """Every element of the lists without a bound: repo, section, list and the element as JSON."""
    tree = every.where("walked")
    tables = {
        "entry_points": lambda: architecture.entry_points(tree),
        "layers": lambda: architecture.layers(tree),
        "internal_deps": lambda: architecture.import_edges(tree),
        "scored_files": lambda: architecture.scored_files(tree).drop("parts"),
        "endpoints": lambda: api.endpoints(every),
        "cli_commands": lambda: api.cli_commands(every),
        "findings": lambda: security.security_findings(every, commit_files),
        "env_vars": lambda: setup.env_vars(every),
    }
    rows = []
    for name in names:
        analysis, table = LISTS[name][0], tables[name]()
        fields = sorted(c for c in table.columns if c != "repo")
        item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        rows.append(
            table.select("repo", F.lit(analysis).alias("section"), F.lit(name).alias("list"), item.alias("item"))
        )
    result = rows[0]
    for more in rows[1:]:
        result = result.unionByName(more)
    return result


def report_items(corpus: Corpus, names: list[str] | None = None) -> DataFrame:
    """Elements of the named lists, by default all that a report shows; only their signals are extracted."""
    chosen = names or SHOWN
    signals = sorted({s for name in chosen for s in LISTS[name][1]})
    return items_over(staged_facts(corpus, *signals), corpus.commit_files, chosen)


def new_folder(spark: SparkSession) -> str:
    return scale.new_folder(spark, "snapshots")


def written(corpus: Corpus, snapshot_id: str) -> str:
    """Folder of a freshly written snapshot."""
    folder = new_folder(corpus.files.sparkSession)
    write_snapshot(full_report(corpus), folder, snapshot_id, datetime(2026, 1, 1))
    return folder


def write_for_diff(corpora: dict[str, Corpus], folder: str) -> str:
    """Snapshots of several states with what a comparison reads: debt reports, findings and scored files.

    The files of a state are read once for all three.
    """
    lists = ["findings", "scored_files"]
    for snapshot_id, corpus in corpora.items():
        every = facts_for(corpus, ["debt"], lists)
        report = report_over(every, corpus.commits, corpus.commit_files, ["debt"])
        items = items_over(every, corpus.commit_files, lists)
        write_snapshot(report, folder, snapshot_id, generated_at(snapshot_id), items)
    return folder


#: When the states of the derived corpus were reported, as days after the first.
STATES = {"now": 0, "later": 7, "third": 21, "fourth": 28, "fifth": 60}


def generated_at(snapshot_id: str) -> datetime:
    return datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(days=STATES.get(snapshot_id, 0))


def write_debt(corpus: Corpus, folder: str, snapshot_id: str) -> None:
    """A further snapshot of the debt reports in the folder of a log."""
    write_snapshot(full_report(corpus, ["debt"]), folder, snapshot_id, generated_at(snapshot_id))


def written_rows(corpus: Corpus, snapshot_id: str = "current") -> DataFrame:
    """The rows of a snapshot as they lie on disk: one JSON object per repository."""
    lines = corpus.files.sparkSession.read.text(f"{written(corpus, snapshot_id)}/{REPORTS}")
    return lines.select(
        "snapshot_id",
        F.get_json_object("value", "$.repo").alias("repo"),
        F.size(F.json_object_keys("value")).cast("bigint").alias("field_count"),
    )


FLAT = {
    "architecture": [
        "project_type", "framework", "structure_pattern", "total_files", "total_lines", "entry_point_count", "edge_count",
    ],
    "tech_debt": ["overall_score", "grade"],
    "onboarding": ["project_summary", "architecture_overview"],
    "dependencies": ["package_manager", "total_deps", "outdated_count", "risk_score"],
    "conventions": [
        "variables", "functions", "classes", "files", "indent_style", "indent_width", "quotes", "semicolons",
        "import_style", "error_handling", "test_pattern", "commit_format", "linter_config", "consistency_score",
    ],
    "api": ["api_type", "total_routes", "total_commands", "undocumented_routes"],
    "security": ["risk_level", "secrets_found", "auth_pattern"],
    "setup": ["build_command", "test_command"],
}
SIZES = {
    "key_file_count": "size(architecture.key_files)",
    "hotspot_count": "coalesce(size(tech_debt.hotspots), 0)",
    "recommendation_count": "size(tech_debt.recommendations)",
    "setup_step_count": "size(onboarding.setup_steps)",
    "test_command_count": "size(onboarding.test_commands)",
    "gotcha_count": "size(onboarding.gotchas)",
    "term_count": "coalesce(size(onboarding.glossary), 0)",
    "contributor_count": "size(onboarding.top_contributors)",
    "port_count": "size(security.exposed_ports)",
    "advice_count": "size(security.recommendations)",
    "prerequisite_count": "size(setup.prerequisites)",
    "install_step_count": "size(setup.install_steps)",
    "run_command_count": "size(setup.run_commands)",
    "issue_count": "size(setup.common_issues)",
}
# lists as texts: a line for each element, its fields parted by bars
TEXTS = {
    "key_files": ("architecture.key_files", "concat_ws('|', x.path, x.role, x.importance_score)"),
    "hotspots": ("tech_debt.hotspots", "concat_ws('|', x.path, x.reason, x.score)"),
    "debt_advice": ("tech_debt.recommendations", "x"),
    "setup_commands": ("onboarding.setup_steps", "x.command"),
    "test_commands": ("onboarding.test_commands", "x"),
    "gotchas": ("onboarding.gotchas", "x"),
    "terms": ("array_sort(map_entries(onboarding.glossary))", "concat_ws('|', x.key, x.value)"),
    "contributors": ("onboarding.top_contributors", "concat_ws('|', x.name, x.email, x.recent_commits)"),
    "packages": ("dependencies.deps", "concat_ws('|', x.name, x.current_version, x.status)"),
    "ports": ("security.exposed_ports", "cast(x as string)"),
    "security_advice": ("security.recommendations", "x"),
    "install_commands": ("setup.install_steps", "x.command"),
    "issues": ("setup.common_issues", "x.description"),
}


def flat(reports: DataFrame, *more: Column | str) -> DataFrame:
    """The scalars of all sections side by side, and the sizes of their lists."""
    return reports.select(
        *more,
        "repo",
        "head_commit",
        *(f"{section}.{name}" for section, names in FLAT.items() for name in names),
        *(F.expr(f"cast({size} as bigint)").alias(name) for name, size in SIZES.items()),
    )


def whole(reports: DataFrame) -> DataFrame:
    """Reports without nesting: scalars, sizes, and the lists as texts."""
    lists = {
        name: F.expr(f"coalesce(array_join(transform({value}, x -> {item}), '\n'), '')") for name, (value, item) in TEXTS.items()
    }
    return flat(reports, *(text.alias(name) for name, text in lists.items()))


def stored_reports(corpus: Corpus, snapshot_id: str = "current") -> DataFrame:
    """Write the report as a snapshot, read it back and lay its scalars out flat."""
    return flat(read_snapshots(corpus.files.sparkSession, written(corpus, snapshot_id)), "snapshot_id")

"""Every operator as a named query over the derived corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import api, architecture, conventions, debt, dependencies, diff, exports, facts, history
from ..functions.scale import kept
from ..operators import languages, licensing, onboarding, profile, scorecard, security, setup, trend, versions
from ..sources.corpus import Corpus, later_corpus, projected_corpus, staged_corpus
from . import report, streams

C = F.col


class Inputs:
    """Lazily planned inputs of the queries; staged facts and snapshots are written when a query is built."""

    def __init__(
        self,
        corpus: Corpus | Callable[[], Corpus],
        signals: tuple[str, ...],
        snapshots: Callable[[], diff.Snapshots] | None = None,
        staged: bool = False,
        log: Callable[[], str] | None = None,
    ):
        self.given = corpus
        self.signals = signals or ("manifest",)
        self.snapshots = snapshots
        self.staged = staged
        self.log = log

    @cached_property
    def corpus(self) -> Corpus:
        """Made when a query reads it: those over stored states don't."""
        return self.given if isinstance(self.given, Corpus) else self.given()

    @property
    def files(self) -> DataFrame:
        return self.corpus.files

    @property
    def commits(self) -> DataFrame:
        return self.corpus.commits

    @property
    def commit_files(self) -> DataFrame:
        return self.corpus.commit_files

    @cached_property
    def every(self) -> DataFrame:
        """Facts that know which files the walk keeps, written once if the plan reads them often."""
        if self.staged:
            return report.staged_facts(self.corpus, *self.signals)
        return facts.with_walked(self.facts, self.corpus.rules)

    @cached_property
    def facts(self) -> DataFrame:
        return self.every if self.staged else facts.facts(self.files, *self.signals)

    @cached_property
    def tree(self) -> DataFrame:
        return self.every.where("walked") if self.staged else facts.walked(self.facts, self.corpus.rules)

    @cached_property
    def scores(self) -> DataFrame:
        return scorecard.score_table(self.every, self.commit_files)


class Plan:
    """A query: a function of the inputs and the signals it reads from file contents."""

    def __init__(self, build: Callable[[Inputs], DataFrame], *signals: str, staged: bool = False):
        self.build = build
        self.signals = signals
        self.staged = staged


def staged(build: Callable[[Inputs], DataFrame], *signals: str) -> Plan:
    """A query with several uses of the signals: contents are read once and the facts written."""
    return Plan(build, *signals, staged=True)


FACT_COLUMNS = ["repo", "path", "name", "stem", "suffix", "suffix_lower", "depth", "top_dir", "size_bytes", "line_count"]


def bigints(df: DataFrame) -> DataFrame:
    """Counts as BIGINT whatever width Spark chose for them."""
    wide = {"position", "rank", "line", "depth", "port"}
    return df.select(*(C(c).cast("bigint").alias(c) if c in wide else C(c) for c in df.columns))


# key -> plan over the inputs and the signals it reads
PLANS: dict[str, Plan] = {
    # corpus
    "file_facts": Plan(lambda i: i.facts.select(*FACT_COLUMNS)),
    "prune_dirs": Plan(lambda i: i.facts.where(facts.outside_pruned_dirs()).select("repo", "path")),
    "gitignore_filter": Plan(lambda i: facts.drop_ignored(i.facts, i.corpus.rules).select("repo", "path"), "manifest"),
    "binary_ext_filter": Plan(lambda i: i.facts.where(facts.not_binary()).select("repo", "path")),
    "size_filter": Plan(lambda i: i.facts.where(facts.within_size(5000)).select("repo", "path", "size_bytes")),
    "size_filter_default": Plan(lambda i: i.facts.where(facts.within_size()).select("repo", "path", "size_bytes")),
    "walked_files": Plan(lambda i: i.tree.select("repo", "path", "size_bytes", "line_count"), "manifest"),
    "scope_all_files": Plan(lambda i: i.facts.where("scannable").select("repo", "path")),
    "corpus_totals": Plan(lambda i: languages.corpus_totals(i.tree), "manifest"),
    # languages
    "language_of": Plan(lambda i: languages.language_of(i.tree), "manifest"),
    "language_stats": Plan(lambda i: languages.language_stats(i.tree), "manifest"),
    "language_breakdown": Plan(lambda i: languages.language_breakdown(i.tree), "manifest"),
    "top_languages": Plan(lambda i: languages.top_languages(i.tree), "manifest"),
    # line patterns
    "py_imports": Plan(lambda i: architecture.py_imports(i.tree), "manifest", "imports"),
    "js_imports": Plan(lambda i: architecture.js_imports(i.tree), "manifest", "imports"),
    "todo_comments": Plan(lambda i: debt.todo_comments(i.tree), "manifest", "todos"),
    "secret_lines": Plan(lambda i: debt.secret_lines(i.tree), "manifest", "line_secrets"),
    # architecture
    "framework_python": Plan(lambda i: architecture.framework_python(i.tree), "manifest"),
    "framework_js": Plan(lambda i: architecture.framework_js(i.tree), "manifest"),
    "framework": Plan(lambda i: architecture.framework(i.tree), "manifest"),
    "project_type": Plan(lambda i: architecture.project_type(i.tree, i.facts).drop("framework"), "manifest"),
    "structure_pattern": Plan(lambda i: architecture.structure_pattern(i.tree), "manifest"),
    "entry_points": Plan(lambda i: architecture.entry_points(i.tree), "manifest"),
    "layers": Plan(lambda i: architecture.layers(i.tree), "manifest"),
    "module_map": Plan(lambda i: architecture.module_map(i.tree), "manifest"),
    "import_edges": Plan(lambda i: architecture.import_edges(i.tree), "manifest", "imports"),
    "module_in_degree": Plan(lambda i: architecture.module_in_degree(i.tree), "manifest", "imports"),
    "key_files": Plan(lambda i: architecture.key_files(i.tree), "manifest", "imports"),
    "architecture_report": staged(lambda i: architecture.architecture_report(i.tree, i.facts), "manifest", "imports"),
    # technical debt
    "todo_density": Plan(lambda i: debt.todo_density(i.tree), "manifest", "todos", "opens_with_docstring"),
    "test_ratio": Plan(lambda i: debt.test_ratio(i.tree), "manifest", "todos", "opens_with_docstring"),
    "complexity": Plan(lambda i: debt.complexity(i.tree), "manifest", "todos", "opens_with_docstring"),
    "hotspots": Plan(lambda i: debt.hotspots(i.tree), "manifest"),
    "documentation_gap": Plan(lambda i: debt.documentation_gap(i.tree), "manifest", "todos", "opens_with_docstring"),
    "dead_modules": Plan(lambda i: debt.dead_modules(i.tree), "manifest", "imports"),
    "dead_code": staged(lambda i: debt.dead_code(i.tree), "manifest", "imports", "todos", "opens_with_docstring"),
    "debt_dimensions": staged(
        lambda i: debt.debt_dimensions(i.tree),
        "manifest", "imports", "todos", "opens_with_docstring"
    ),
    "debt_score": staged(lambda i: debt.debt_score(i.tree), "manifest", "imports", "todos", "opens_with_docstring"),
    "debt_recommendations": staged(
        lambda i: debt.debt_recommendations(i.tree),
        "manifest", "imports", "todos", "opens_with_docstring"
    ),
    # onboarding
    "readme_pick": Plan(lambda i: onboarding.readme_pick(i.facts), "manifest"),
    "readme_summary": Plan(lambda i: onboarding.readme_summary(i.facts), "manifest"),
    "readme_setup_steps": Plan(lambda i: onboarding.readme_setup_steps(i.facts), "manifest"),
    "setup_steps": Plan(lambda i: onboarding.setup_steps(i.tree, i.facts), "manifest", "reads_env"),
    "test_commands": Plan(lambda i: onboarding.test_commands(i.tree, i.facts), "manifest", "reads_env"),
    "gotchas": Plan(lambda i: onboarding.gotchas(i.tree), "manifest", "reads_env"),
    "glossary": staged(lambda i: onboarding.glossary(i.tree), "manifest", "terms"),
    "architecture_overview": Plan(lambda i: onboarding.architecture_overview(i.tree, i.facts), "manifest", "imports"),
    "top_contributors": Plan(lambda i: onboarding.top_contributors(i.commits)),
    "onboarding_key_files": Plan(lambda i: onboarding.onboarding_key_files(i.tree), "manifest", "imports"),
    # dependencies
    "deps_requirements": Plan(lambda i: dependencies.deps_requirements(i.facts), "manifest"),
    "deps_pyproject": Plan(lambda i: dependencies.deps_pyproject(i.facts), "manifest"),
    "deps_package_json": Plan(lambda i: dependencies.deps_package_json(i.facts), "manifest"),
    "deps_go_mod": Plan(lambda i: dependencies.deps_go_mod(i.facts), "manifest"),
    "deps_cargo": Plan(lambda i: dependencies.deps_cargo(i.facts), "manifest"),
    "deps_gemfile": Plan(lambda i: dependencies.deps_gemfile(i.facts), "manifest"),
    "dep_status": Plan(lambda i: dependencies.dep_status(i.facts), "manifest"),
    "dependencies": Plan(lambda i: dependencies.dependencies(i.facts), "manifest"),
    "package_manager": Plan(lambda i: dependencies.package_manager(i.facts), "manifest"),
    "dependency_risk": Plan(lambda i: dependencies.dependency_risk(i.facts), "manifest"),
    "version_ranges": Plan(lambda i: versions.version_ranges(i.facts), "manifest"),
    "latest_version": Plan(lambda i: versions.latest_version(i.facts), "manifest"),
    "license_notices": Plan(lambda i: licensing.license_notices(i.facts), "notices"),
    "project_license": Plan(lambda i: licensing.project_license(i.facts), "manifest"),
    "license_verdicts": Plan(lambda i: licensing.license_verdicts(i.facts), "manifest", "notices"),
    "license_conflicts": Plan(lambda i: licensing.license_conflicts(i.facts), "manifest", "notices"),
    # conventions
    "convention_sample": Plan(lambda i: conventions.convention_sample(i.facts)),
    "naming_style": Plan(lambda i: conventions.naming_style(i.facts), "style"),
    "indent_per_file": Plan(lambda i: conventions.indent_per_file(i.facts), "style"),
    "indent_style": Plan(lambda i: conventions.indent_style(i.facts), "style"),
    "quote_style": Plan(lambda i: conventions.quote_style(i.facts), "style"),
    "semicolon_style": Plan(lambda i: conventions.semicolon_style(i.facts), "style"),
    "import_style": Plan(lambda i: conventions.import_style(i.facts), "style"),
    "error_handling": Plan(lambda i: conventions.error_handling(i.facts), "style"),
    "test_pattern": Plan(lambda i: conventions.test_pattern(i.facts)),
    "commit_format": Plan(lambda i: conventions.commit_format(i.commits)),
    "linter_config": Plan(lambda i: conventions.linter_config(i.facts)),
    "consistency_score": Plan(lambda i: conventions.consistency_score(i.facts), "style"),
    "line_length": Plan(lambda i: conventions.line_length(i.tree), "manifest", "line_buckets"),
    "convention_report": Plan(lambda i: conventions.convention_report(i.facts, i.commits), "style"),
    # API surface
    "routes_flask": Plan(lambda i: api.routes(i.facts, "flask"), "flask"),
    "routes_fastapi": Plan(lambda i: api.routes(i.facts, "fastapi"), "fastapi"),
    "routes_django": Plan(lambda i: api.routes(i.facts, "django"), "django"),
    "routes_express": Plan(lambda i: api.routes(i.facts, "express"), "express"),
    "routes_next_pages": Plan(lambda i: api.routes(i.facts, "next_pages"), "next_pages"),
    "routes_next_app": Plan(lambda i: api.routes(i.facts, "next_app"), "next_app"),
    "cli_click": Plan(lambda i: api.commands(i.facts, "click"), "click"),
    "cli_argparse": Plan(lambda i: api.commands(i.facts, "argparse"), "argparse"),
    "endpoints": Plan(lambda i: api.endpoints(i.facts), *api.ROUTE_KINDS),
    "undocumented_routes": Plan(lambda i: api.undocumented_routes(i.facts), *api.ROUTE_KINDS, "has_docstring"),
    "api_report": Plan(lambda i: api.api_report(i.facts), *api.ROUTE_KINDS, "click", "argparse", "has_docstring"),
    "public_exports": staged(lambda i: exports.public_exports(i.tree), "manifest", "symbols", "links"),
    # security
    "secret_findings": Plan(lambda i: security.secret_findings(i.facts), "secrets"),
    "sql_injection": Plan(lambda i: security.sql_injection(i.facts), "sql_strings"),
    "env_exposed": Plan(lambda i: security.env_exposed(i.facts), "manifest"),
    "env_in_history": Plan(lambda i: security.env_in_history(i.facts, i.commit_files)),
    "exposed_ports": Plan(lambda i: security.exposed_ports(i.facts), "manifest"),
    "auth_pattern": Plan(lambda i: security.auth_pattern(i.facts), "auth"),
    "security_findings": Plan(
        lambda i: security.security_findings(i.facts, i.commit_files),
        "secrets", "sql_strings", "manifest"
    ),
    "risk_level": Plan(lambda i: security.risk_level(i.facts, i.commit_files), "secrets", "sql_strings", "manifest"),
    "security_recommendations": Plan(
        lambda i: security.security_recommendations(i.facts, i.commit_files),
        "secrets", "sql_strings", "manifest", "auth"
    ),
    # setup guide
    "prerequisites": Plan(lambda i: setup.prerequisites(i.facts), "manifest"),
    "install_steps": Plan(lambda i: setup.install_steps(i.facts), "manifest"),
    "env_vars": Plan(lambda i: setup.env_vars(i.facts), "manifest", "env_names"),
    "database_setup": Plan(lambda i: setup.database_setup(i.facts), "manifest"),
    "run_commands": Plan(lambda i: setup.run_commands(i.facts), "manifest"),
    "test_command": Plan(lambda i: setup.test_command(i.facts), "manifest"),
    "build_command": Plan(lambda i: setup.build_command(i.facts), "manifest"),
    "common_issues": Plan(lambda i: setup.common_issues(i.facts), "manifest"),
    # history
    "head_commit": Plan(lambda i: history.head_commit(i.commits)),
    "commit_count": Plan(lambda i: history.commit_count(i.commits)),
    "contributors": Plan(lambda i: history.contributors(i.commits)),
    "recent_files": Plan(lambda i: history.recent_files(i.commits, i.commit_files)),
    # the derived history spans thirty days, so that half a year would find nothing
    "stale_files": Plan(lambda i: history.stale_files(i.tree, i.commits, i.commit_files, 14)),
    "code_staleness": Plan(lambda i: history.code_staleness(i.tree, i.commits, i.commit_files, 14)),
    # scorecard and differences
    "scorecard": staged(lambda i: scorecard.scorecard(i.scores), *profile.SIGNALS),
    "overall_health": staged(lambda i: scorecard.overall_health(i.scores), *profile.SIGNALS),
    "score_band": staged(
        lambda i: scorecard.score_band(i.tree),
        "manifest", "imports", "todos", "opens_with_docstring"
    ),
    # the same on a stream of files
    "stream_todo_comments": Plan(lambda i: streams.extracted(i.corpus, "todo_comments")),
    "stream_secret_findings": Plan(lambda i: streams.extracted(i.corpus, "secret_findings")),
    "stream_endpoints": Plan(lambda i: streams.extracted(i.corpus, "endpoints")),
    "stream_daily_totals": Plan(lambda i: streams.totals(i.corpus)),
    "full_report": Plan(lambda i: report.whole(report.full_report(i.corpus))),
    "snapshot_write": Plan(lambda i: report.written_rows(i.corpus)),
    "snapshot_read": Plan(lambda i: report.stored_reports(i.corpus)),
    "report_items": Plan(lambda i: report.report_items(i.corpus)),
    "debt_chart_rows": staged(
        lambda i: debt.debt_chart_rows(i.tree),
        "manifest", "imports", "todos", "opens_with_docstring"
    ),
    "diff_grade": Plan(lambda i: i.snapshots().grade()),
    "diff_findings": Plan(lambda i: i.snapshots().findings()),
    "diff_key_files": Plan(lambda i: i.snapshots().key_files()),
    "diff_recommendations": Plan(lambda i: i.snapshots().recommendations()),
    "debt_trend": Plan(lambda i: trend.stored_trend(i.snapshots().spark, i.log())),
}


def corpus_for(spark: SparkSession, sf_dir: str, compared: bool = False) -> Corpus:
    """The derived tables, made once per application and folder: written, as a deployment would hold them.

    States that are ``compared`` share one writing of the documents instead.
    """
    make = projected_corpus if compared else staged_corpus
    return kept(spark, ("compared" if compared else "corpus", sf_dir), lambda: make(spark, sf_dir))


def snapshots_for(spark: SparkSession, sf_dir: str) -> diff.Snapshots:
    """Two stored states of the corpus, written once per application and folder."""

    def write() -> str:
        now = corpus_for(spark, sf_dir, True)
        return report.write_for_diff({"now": now, "later": later_corpus(spark, sf_dir, now)}, report.new_folder(spark))

    return diff.Snapshots(spark, kept(spark, ("snapshots", sf_dir), write), "now", "later")


def log_for(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a log of five states: the two that are compared, and the debt reports of three more."""

    def write() -> str:
        folder, now = snapshots_for(spark, sf_dir).folder, corpus_for(spark, sf_dir, True)
        for shift, state in list(enumerate(report.STATES))[2:]:
            report.write_debt(later_corpus(spark, sf_dir, now, shift), folder, state)
        return folder

    return kept(spark, ("log", sf_dir), write)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = PLANS[name]
    corpus, snapshots = (lambda: corpus_for(spark, sf_dir)), (lambda: snapshots_for(spark, sf_dir))
    return bigints(plan.build(Inputs(corpus, plan.signals, snapshots, plan.staged, lambda: log_for(spark, sf_dir))))

"""Structure of a repository: frameworks, layers, import graph and key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import first_rows, merge_on
from .languages import corpus_totals, language_breakdown
from .manifests import roots

C = F.col


def framework_python(tree: DataFrame) -> DataFrame:
    """Framework named by each Python manifest that names one."""
    named = tree.where(T.is_in("name", R.FRAMEWORK_MANIFESTS) & C("framework_hint").isNotNull())
    return named.select("repo", "path", C("framework_hint").alias("framework"))


def framework_js(tree: DataFrame) -> DataFrame:
    named = tree.where((C("name") == "package.json") & C("framework_hint").isNotNull())
    return named.select("repo", "path", C("framework_hint").alias("framework"))


ORDERED = [*R.FRAMEWORK_MANIFESTS, "package.json"]


def framework_columns() -> list[Column]:
    """Framework of the last file of each manifest name, as aggregates per repository."""
    named = [
        F.max_by(F.when(C("name") == n, C("framework_hint")), F.when(C("walked") & (C("name") == n), C("parts"))).alias(f"fw_{i}")
        for i, n in enumerate(ORDERED)
    ]
    django = F.coalesce(F.bool_or(C("walked") & (C("name") == "manage.py")), F.lit(False))
    return [*named, django.alias("has_manage")]


def has_framework_file() -> Column:
    return T.is_in("name", [*ORDERED, "manage.py"])


def framework_of() -> Column:
    """First framework over the manifests in order, then Django's manage.py."""
    return F.coalesce(*(C(f"fw_{i}") for i in range(len(ORDERED))), F.when(C("has_manage"), "django"))


def framework(tree: DataFrame) -> DataFrame:
    found = tree.where(has_framework_file()).groupBy("repo").agg(*framework_columns())
    return tree.select("repo").distinct().join(found, "repo", "left").select("repo", framework_of().alias("framework"))


def kind_columns() -> list[Column]:
    """Switches on names that the project type depends on."""

    def seen(sql: str, name: str) -> Column:
        return F.expr(f"coalesce(bool_or(walked and {sql}), false) as {name}")

    folders = ", ".join(map(T.quoted, R.MONOREPO_DIRS))
    return [
        seen(f"coalesce(top_dir in ({folders}), false)", "monorepo"),
        seen("name in ('cli.py', '__main__.py')", "cli"),
        seen("name = 'pyproject.toml'", "any_pyproject"),
        seen("name = 'setup.py'", "any_setup_py"),
    ]


def project_type_of(framework: Column) -> Column:
    def plain(text: str) -> Column:
        return F.contains(text, F.lit("[project]")) & ~F.contains(text, F.lit("scripts"))

    library = (C("any_pyproject") & plain("pyproject")) | (C("any_setup_py") & plain("setup_py"))
    bare = framework.isNull()
    return (
        F.when(C("monorepo"), "monorepo")
        .when(bare & C("cli"), "cli")
        .when(bare & F.coalesce(library, F.lit(False)), "library")
        .otherwise("monolith")
    )


def project_type(tree: DataFrame, every: DataFrame) -> DataFrame:
    """Monorepo, command-line tool, library or monolith; root manifests are read wherever they lie."""
    flags = tree.groupBy("repo").agg(*kind_columns())
    texts = roots(every).select("repo", "pyproject", "setup_py")
    rows = flags.join(framework(tree), "repo").join(texts, "repo")
    return rows.select("repo", "framework", project_type_of(C("framework")).alias("project_type"))


def structure_pattern(tree: DataFrame) -> DataFrame:
    folders = tree.select("repo", F.lower("top_dir").alias("folder")).distinct()
    plain = ~C("folder").isin(R.MVC_DIRS + R.CLEAN_DIRS + R.NEUTRAL_DIRS)
    kinds = folders.groupBy("repo").agg(
        F.count_if(T.is_in("folder", R.CLEAN_DIRS)).alias("clean"),
        F.count_if(T.is_in("folder", R.MVC_DIRS)).alias("mvc"),
        F.count_if(plain).alias("feature"),
    )
    return kinds.select(
        "repo",
        F.when(C("clean") > 0, "clean")
        .when(C("mvc") >= 2, "mvc")
        .when(C("feature") >= 2, "feature-based")
        .otherwise("flat")
        .alias("structure_pattern"),
    )


def is_entry_point() -> Column:
    return T.is_in("name", list(R.ENTRY_POINTS))


def entry_points(tree: DataFrame) -> DataFrame:
    return tree.where(is_entry_point()).select(
        "repo", "path", T.lookup(R.ENTRY_POINTS, "name").alias("entry_type")
    )


def layers(tree: DataFrame) -> DataFrame:
    """The files of each architectural layer, one row per file: a layer's size has no bound."""
    return (
        tree.select("repo", F.lower("top_dir").alias("layer"), "path")
        .where(T.is_in("layer", list(R.LAYERS)))
        .select("repo", "layer", T.lookup(R.LAYERS, "layer").alias("purpose"), "path")
    )


def module_map(tree: DataFrame) -> DataFrame:
    """Python module names, as bare stem and as dotted path, with the last file of that name."""
    dotted = F.replace(F.expr("left(path, length(path) - length(suffix))"), F.lit("/"), F.lit("."))
    named = tree.where(T.is_in("suffix", R.PY_GRAPH_SUFFIXES)).select(
        "repo", "path", "parts", F.explode(F.array_distinct(F.array("stem", dotted))).alias("module")
    )
    return named.groupBy("repo", "module").agg(F.max_by("path", "parts").alias("target"))


def imported_modules(tree: DataFrame) -> DataFrame:
    return T.explode_kept(tree.select("repo", "path", "suffix", "imports"), "imports", "module").drop("imports")


def py_imports(tree: DataFrame) -> DataFrame:
    return imported_modules(tree.where(T.is_in("suffix", R.PY_GRAPH_SUFFIXES))).drop("suffix")


def js_imports(tree: DataFrame) -> DataFrame:
    return imported_modules(tree.where(T.is_in("suffix", R.JS_GRAPH_SUFFIXES))).drop("suffix")


def import_edges(tree: DataFrame) -> DataFrame:
    """Edges from a file to the file of this repository that an import resolves to."""
    importing = imported_modules(tree.where(T.is_in("suffix", R.PY_GRAPH_SUFFIXES + R.JS_GRAPH_SUFFIXES)))
    resolved = importing.join(module_map(tree), ["repo", "module"])
    return resolved.where("target <> path").select(
        "repo", C("path").alias("from_module"), C("target").alias("to_module")
    )


def module_in_degree(tree: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    edges = import_edges(tree) if edges is None else edges
    return edges.groupBy("repo", "to_module").agg(F.count(F.lit(1)).alias("in_degree"))


def scored_files(tree: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All files of the walk with their weight by entry-point role, in-degree and name."""
    degrees = module_in_degree(tree, edges)
    highest = degrees.groupBy("repo").agg(F.max("in_degree").alias("highest"))
    weighed = degrees.join(highest, "repo").select(
        "repo",
        C("to_module").alias("path"),
        (C("in_degree").cast("double") / C("highest") * 40).cast("int").alias("graph"),
    )
    entry = is_entry_point()
    score = (
        F.when(entry, 50).otherwise(0)
        + F.coalesce("graph", F.lit(0))
        + F.when(T.is_in("name", R.WELL_KNOWN_FILES), 10).otherwise(0)
    )
    scored = tree.select("repo", "path", "parts", "name").join(weighed, ["repo", "path"], "left")
    scored = scored.withColumn("importance_score", F.least(score, F.lit(100)).cast("int"))
    role = (
        F.when(C("name") == "README.md", "documentation")
        .when(T.is_in("name", R.PACKAGE_CONFIG_FILES), "package config")
        .when(entry, "entry point")
        .otherwise("module")
    )
    return scored.select("repo", "path", "parts", role.alias("role"), "importance_score")


def key_files(tree: DataFrame, edges: DataFrame | None = None, limit: int = R.KEY_FILE_LIMIT) -> DataFrame:
    """The files that matter most."""
    order = [F.desc("importance_score"), F.asc("parts")]
    ranked = first_rows(scored_files(tree, edges), ["repo"], order, limit, "rank")
    return ranked.select("repo", "rank", "path", "role", "importance_score")


def architecture_report(tree: DataFrame, every: DataFrame) -> DataFrame:
    """One row per repository: kinds, totals and the sizes of the lists kept in their own tables."""
    edges = import_edges(tree)

    def sized(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))

    parts = [
        project_type(tree, every),
        structure_pattern(tree),
        sized(entry_points(tree), "entry_point_count"),
        sized(layers(tree).select("repo", "layer").distinct(), "layer_count"),
        sized(edges, "edge_count"),
        sized(key_files(tree, edges), "key_file_count"),
        sized(language_breakdown(tree), "language_count"),
    ]
    report = merge_on("repo", corpus_totals(tree), parts)
    counts = [c for c in report.columns if c.endswith("_count")]
    return report.fillna(0, counts)

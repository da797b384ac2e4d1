"""Declared dependencies of root manifests, their status and the risk they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .manifests import repos, roots, there, toml_body, toml_sections

C = F.col
DEP = "struct<name:string,current_version:string,license:string,status:string>"
SPECIFIER = "^~>=<"


def split_spec(spec: Column) -> Column:
    """struct<name, version> of a requirement such as ``flask[async]==2.3.0``."""
    bare = T.strip(F.regexp_replace(spec, r"\[[^\n]*?\]", ""))
    version = T.strip(T.lstrip(T.strip(T.find(bare, R.SPEC, 2)), "="))
    fits = T.has(bare, R.SPEC)
    return F.struct(
        F.when(fits, T.find(bare, R.SPEC, 1)).otherwise(bare).alias("name"),
        F.when(fits, version).otherwise("").alias("version"),
    )


def status_of(name: Column, version: Column) -> Column:
    digits = T.find(version, r"(\d+)", 1)
    major = digits.try_cast("bigint")
    lowered = F.lower(name)
    behind = F.lit(False)
    for package, stable in R.STABLE_MAJOR.items():
        if stable > 0:
            behind = behind | ((lowered == package) & (major < stable - 1))
    early = (major == 0) & (F.contains(version, F.lit("==")) | F.startswith(version, F.lit("0")))
    outdated = behind | (early & lowered.isin(R.PAST_V1))
    return F.when(digits == "", "unknown").when(F.coalesce(outdated, F.lit(False)), "outdated").otherwise("ok")


def dependency(name: Column, version: Column, status: Column, license: Column | None = None) -> Column:
    shown = F.when(version == "", "unknown").otherwise(version)
    return F.struct(name, shown, F.lit(None).cast("string") if license is None else license, status).cast(DEP)


def from_specs(specs: Column) -> Column:
    pairs = F.filter(F.transform(specs, split_spec), lambda s: s["name"] != "")
    return F.transform(
        pairs, lambda s: dependency(s["name"], s["version"], status_of(s["name"], s["version"]))
    )


def stripped_lines(content: Column) -> Column:
    return F.transform(T.split_lines(content), lambda s: T.strip(s))


def or_none(value: Column) -> Column:
    return F.coalesce(value.cast(f"array<{DEP}>"), T.empty(DEP))


def requirement_specs() -> Column:
    wanted = lambda s: (s != "") & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("-"))
    return F.filter(stripped_lines(C("requirements")), wanted)


def pyproject_specs() -> Column:
    # possessive repetition keeps long lists off the matcher's stack
    pattern = r"""(?m)^[ \t]*dependencies\s*=\s*\[((?:[^\]"'#]|"[^"]*"|'[^']*'|#[^\n]*)*+)\]"""
    listed = T.find(F.coalesce(toml_body(C("pyproject"), "project"), F.lit("")), pattern)
    tokens = T.find_all(listed, r""""[^"]*"|'[^']*'|#[^\n]*""", 0)
    quoted = F.filter(tokens, lambda t: ~F.startswith(t, F.lit("#")))
    return F.transform(quoted, lambda t: F.substr(t, F.lit(2), F.length(t) - 2))


def package_entries() -> Column:
    sections = ["dependencies", "devDependencies", "peerDependencies"]
    nothing = T.empty("struct<key:string,value:string>")
    return F.concat(*(F.coalesce(F.map_entries(C("npm")[s]), nothing) for s in sections))


def package_deps() -> Column:
    def row(e: Column) -> Column:
        version = T.strip(T.lstrip(F.coalesce(e["value"], F.lit("")), SPECIFIER))
        status = F.when(version == "", "unknown").otherwise("ok")
        return dependency(e["key"], version, status, C("npm")["license"])

    return F.transform(package_entries(), row)


def go_deps() -> Column:
    usable = lambda s: (
        (F.startswith(s, F.lit("require")) | T.has(s, r"^\S+\s+v")) & T.has(s, R.GO_REQUIRE)
    )
    lines = F.filter(stripped_lines(C("go_mod")), usable)
    return F.transform(
        lines,
        lambda s: dependency(
            T.find(s, R.GO_REQUIRE, 1), T.lstrip(T.find(s, R.GO_REQUIRE, 2), "v"), F.lit("ok")
        ),
    )


def cargo_deps() -> Column:
    """Entries of [dependencies], then of [dev-dependencies]; inline and own tables alike."""
    entry = r"""^[ \t]*["']?([A-Za-z0-9_\-]+)["']?[ \t]*=[ \t]*([^\n]+)$"""
    quoted = r"""^["']([^"'\n]*)["']"""
    version_key = r"""(?:^|[{,\n])[ \t]*version[ \t]*=[ \t]*["']([^"'\n]*)["']"""

    def dep(name: Column, version: Column) -> Column:
        return dependency(name, T.strip(T.lstrip(version, SPECIFIER)), F.lit("ok"))

    def section(header: str) -> Column:
        def rows(s: Column) -> Column:
            entries = F.filter(T.split_lines(s["body"]), lambda x: T.has(x, entry))

            def row(x: Column) -> Column:
                value = T.find(x, entry, 2)
                version = F.when(T.has(value, quoted), T.find(value, quoted)).otherwise(
                    T.find(value, version_key)
                )
                return dep(T.find(x, entry, 1), version)

            own = T.strip(F.substring(s["header"], len(header) + 2, 1 << 30), "\"' ")
            table = F.array(dep(own, T.find(s["body"], version_key)))
            return F.when(s["header"] == header, F.transform(entries, row)).otherwise(table)

        mine = lambda s: (s["header"] == header) | F.startswith(s["header"], F.lit(header + "."))
        return F.flatten(F.transform(F.filter(toml_sections(C("cargo")), mine), rows))

    return F.concat(section("dependencies"), section("dev-dependencies"))


def gem_deps() -> Column:
    lines = F.filter(
        stripped_lines(C("gemfile")), lambda s: F.startswith(s, F.lit("gem ")) & T.has(s, R.GEM_LINE)
    )
    return F.transform(
        lines,
        lambda s: dependency(
            T.find(s, R.GEM_LINE, 1), T.strip(T.lstrip(T.find(s, R.GEM_LINE, 2), "~>=<")), F.lit("ok")
        ),
    )


def rows_of(root_rows: DataFrame, deps: Column) -> DataFrame:
    kept = root_rows.select("repo", or_none(deps).alias("deps"))
    return kept.select("repo", F.posexplode("deps").alias("position", "d")).select(
        "repo", "position", "d.name", "d.current_version", "d.license", "d.status"
    )


def deps_requirements(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), from_specs(requirement_specs()))


def deps_pyproject(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), from_specs(pyproject_specs()))


def deps_package_json(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), package_deps())


def deps_go_mod(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), go_deps())


def deps_cargo(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), cargo_deps())


def deps_gemfile(facts: DataFrame) -> DataFrame:
    return rows_of(roots(facts), gem_deps())


def all_deps() -> Column:
    """Dependencies of all manifests of one repository in manifest order."""
    parts = [
        from_specs(requirement_specs()), from_specs(pyproject_specs()), package_deps(),
        go_deps(), cargo_deps(), gem_deps(),
    ]
    return F.concat(*(or_none(p) for p in parts))


def dep_status(facts: DataFrame) -> DataFrame:
    """Requirement specifiers of the Python manifests with the status of each."""
    specs = F.concat(*(or_none(from_specs(s)) for s in (requirement_specs(), pyproject_specs())))
    return rows_of(roots(facts), specs).select("repo", "position", "name", "current_version", "status")


def dependencies(facts: DataFrame, root_rows: DataFrame | None = None) -> DataFrame:
    """All manifests in order; of several entries for a name the first counts."""
    rows = rows_of(roots(facts) if root_rows is None else root_rows, all_deps())
    detail = F.struct("position", "name", "current_version", "license", "status")
    kept = rows.groupBy("repo", F.lower("name").alias("key")).agg(F.min(detail).alias("d"))
    return kept.select("repo", "d.position", "d.name", "d.current_version", "d.license", "d.status")


def manager_of() -> Column:
    python_deps = F.size(or_none(from_specs(pyproject_specs()))) > 0
    script_deps = F.size(package_entries()) > 0
    pip = there("requirements") | (there("pyproject") & python_deps)
    npm = there("package") & ((~there("requirements") & ~there("pyproject")) | script_deps)
    return (
        F.when(npm, "npm")
        .when(pip, "pip")
        .when(there("go_mod"), "go")
        .when(there("cargo"), "cargo")
        .when(there("gemfile"), "bundler")
        .otherwise("none")
    )


def package_manager(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", manager_of().alias("package_manager"))


def risk_of() -> Column:
    total = C("total_deps")
    ratio = C("outdated_count").cast("double") / F.when(total > 0, total)
    size = F.when(total > 100, 20).when(total > 50, 10).otherwise(0)
    return F.least(F.coalesce((ratio * 40).cast("int"), F.lit(0)) + size, F.lit(100)).cast("int")


def count_statuses(deps: DataFrame) -> DataFrame:
    return deps.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_deps"), F.count_if(C("status") == "outdated").alias("outdated_count")
    )


def dependency_counts(facts: DataFrame) -> DataFrame:
    return count_statuses(dependencies(facts))


def dependency_risk(facts: DataFrame) -> DataFrame:
    return repos(facts).join(dependency_counts(facts), "repo", "left").fillna(0).select(
        "repo",
        "total_deps",
        C("total_deps").alias("direct_deps"),
        "outdated_count",
        F.lit(0).cast("bigint").alias("vulnerability_count"),
        risk_of().alias("risk_score"),
    )

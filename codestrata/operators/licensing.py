"""Licenses: expressions and how they combine, notices in files, and what does not fit a repository's own license.

An expression is read by a fold over its tokens.  The state is a stack of open brackets, each with what the finished
alternatives gave and what the present one gives so far; OR closes an alternative, a closing bracket hands its value to the
bracket around it, and WITH binds a license to its exception before anything else.  A leaf is true, false, or null where
the license is not known, and so is the whole.  Whether one license may go into another is the closure of an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .dependencies import dependencies
from .manifests import roots, toml_body

C = F.col
STATE = "struct<stack:array<struct<any:boolean,every:boolean>>,wants:boolean,bad:boolean>"
TOKEN = r"\(|\)|[^\s()]+"
BOUND = r"(?i)(\S+)\s+WITH\s+([^\s()]+)"


def closure(order: list[tuple[str, str]], beside: list[tuple[str, str]]) -> dict[str, list[str]]:
    """For each license of a fixed order all that its code may go into, itself included."""
    into = {name: {name} for edge in order for name in edge}
    changed = True
    while changed:
        changed = False
        for a, b in order:
            for reached in into.values():
                if a in reached and b not in reached:
                    reached.add(b)
                    changed = True
    for a, b in beside:
        into[a].add(b)
    return {name: sorted(found) for name, found in sorted(into.items())}


INTO = closure(R.LICENSE_ORDER, R.LICENSE_BESIDE)


def normal(expression: Column) -> Column:
    """An expression with exceptions bound to their license, or a common name's identifier."""
    trimmed = T.strip(F.regexp_replace(expression, r"\s+", " "))
    known = F.create_map(*(F.lit(x) for pair in R.LICENSE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(trimmed)), F.regexp_replace(trimmed, T.rx(BOUND), "$1/$2"))


def identifier(token: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in R.LICENSE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(token)), token)


def evaluate(expression: Column, leaf: Callable[[Column], Column]) -> Column:
    """The value of an expression whose licenses have the values of ``leaf``; null if it is none or can't be told."""
    start = F.struct(F.array(F.struct(F.lit(False).alias("any"), F.lit(True).alias("every"))), F.lit(True), F.lit(False)).cast(STATE)

    def frame(any_: Column, every: Column) -> Column:
        return F.struct(any_.alias("any"), every.alias("every"))

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        top, rest = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.size(stack) - 1)
        value = top["any"] | top["every"]
        under, below = F.element_at(rest, -1), F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
        joins = F.upper(token).isin("AND", "OR")
        fits = F.when(token == "(", state["wants"]).when(token == ")", ~state["wants"] & (F.size(stack) > 1))
        fits = fits.when(joins, ~state["wants"]).otherwise(state["wants"])
        # a closing bracket without a partner is never looked at: the state is bad by then
        closed = F.when(F.size(rest) > 0, F.concat(below, F.array(frame(under["any"], under["every"] & value)))).otherwise(stack)
        pushed = (
            F.when(token == "(", F.concat(stack, F.array(frame(F.lit(False), F.lit(True)))))
            .when(token == ")", closed)
            .when(F.upper(token) == "OR", F.concat(rest, F.array(frame(value, F.lit(True)))))
            .when(joins, stack)
            .otherwise(F.concat(rest, F.array(frame(top["any"], top["every"] & leaf(identifier(token))))))
        )
        return F.struct(pushed, (token == "(") | joins, state["bad"] | ~fits).cast(STATE)

    def result(state: Column) -> Column:
        top = F.element_at(state["stack"], -1)
        whole = ~state["bad"] & ~state["wants"] & (F.size(state["stack"]) == 1)
        return F.when(whole, top["any"] | top["every"])

    return F.aggregate(T.find_all(normal(expression), TOKEN, 0), start, step, result)


def allowed(own: Column, inner: Column, linked: Column) -> Column:
    """Whether code under ``inner`` may be part of a work under ``own``, or be used by it as a package."""
    into = F.create_map(*(x for k, v in INTO.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    base, exception = F.substring_index(inner, "/", 1), F.element_at(F.split(inner, "/"), -1)
    free = linked & (base.isin(R.LINKABLE) | (F.contains(inner, F.lit("/")) & exception.isin(R.LINKING_EXCEPTIONS)))
    known = F.when(F.try_element_at(into, own).isNotNull(), F.array_contains(F.try_element_at(into, base), own))
    return F.when(free | (own == inner), True).otherwise(known)


def fits(own: Column, inner: Column, linked: Column) -> Column:
    """Whether some license that ``own`` offers, and all that it holds together, takes in what ``inner`` offers."""
    return evaluate(own, lambda mine: evaluate(inner, lambda theirs: allowed(mine, theirs, linked)))


def license_notices(facts: DataFrame) -> DataFrame:
    """Notices in the files that are scanned."""
    hits = T.explode_kept(facts.select("repo", "path", "notices"), "notices", "x")
    return hits.select("repo", "path", "x.line", "x.license")


def project_of() -> Column:
    """The license that a repository declares: in package.json, pyproject.toml, Cargo.toml, or under a README's heading."""
    plain = r"""(?m)^[ \t]*license[ \t]*=[ \t]*(?:\{[ \t]*text[ \t]*=[ \t]*)?["']([^"'\n]+)["']"""
    toml = lambda c, header: F.nullif(T.find(F.coalesce(toml_body(C(c), header), F.lit("")), plain), F.lit(""))
    heading = r"(?im)^#+[ \t]*licen[sc]e[ \t]*\n+[ \t]*([^\n]+?)[ \t.]*$"
    readme = F.nullif(T.find(F.coalesce("readme_md", F.lit("")), heading), F.lit(""))
    return F.coalesce(F.nullif(C("npm")["license"], F.lit("")), toml("pyproject", "project"), toml("cargo", "package"), readme)


def project_license(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", normal(project_of()).alias("license"))


def license_verdicts(facts: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """What each repository takes in, packages and files with a notice, under which license, and whether that fits its own.

    ``packages`` (package, license) names the licenses of packages; by default those of a fixed list.  The verdict is
    ``conflict``, ``fits``, or ``unknown`` where a license or the repository's own is not known or not an expression.
    """
    if packages is None:
        known = F.create_map(*(F.lit(x) for pair in R.PACKAGE_LICENSES.items() for x in pair))
        used = dependencies(facts).select("repo", "name", F.try_element_at(known, F.lower("name")).alias("license"))
    else:
        named = packages.select(F.lower("package").alias("package"), C("license").alias("known")).distinct()
        used = dependencies(facts).select("repo", "name", F.lower("name").alias("package")).join(named, "package", "left")
        used = used.select("repo", "name", C("known").alias("license"))
    used = used.select("repo", F.lit("package").alias("kind"), C("name").alias("source"), normal(C("license")).alias("license"))
    held = license_notices(facts).select("repo", F.lit("file").alias("kind"), C("path").alias("source"), normal(C("license")).alias("license"))
    own = project_license(facts).select("repo", C("license").alias("project_license"))
    rows = used.unionByName(held.distinct()).join(own, "repo")
    verdict = fits(C("project_license"), C("license"), C("kind") == "package")
    told = F.when(verdict, "fits").when(~verdict, "conflict").otherwise("unknown")
    return rows.select("repo", "kind", "source", "license", "project_license", told.alias("verdict"))


def license_conflicts(facts: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    return license_verdicts(facts, packages).where("verdict = 'conflict'").drop("verdict")

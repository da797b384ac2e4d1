"""Version ranges of declared dependencies, and the newest version of each package that the corpus knows.

A version is an array of whole numbers that sorts like the version: its release numbers plus ten, without zeros at the
end, then its stage (below ten, so that 1.2rc1 < 1.2 < 1.2.post1 < 1.2.1), then the number of the stage.  A range is a list
of alternatives, each the intersection of intervals between two such keys; intersecting takes the largest lower and the
smallest upper bound.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .dependencies import package_entries, pyproject_specs, requirement_specs, stripped_lines
from .manifests import roots, toml_sections

C = F.col
RELEASE = r"^[vV=\s]*(\d+(?:\.\d+)*)"
STAGED = r"(?i)^[vV=\s]*\d+(?:\.\d+)*[-_.]?(dev|alpha|a|beta|b|rc|c|preview|pre|post|rev|r)(?![A-Za-z])[-_.]?(\d*)"
OTHER = r"^[vV=\s]*\d+(?:\.\d+)*-[0-9A-Za-z]"
#: Stages in order; what follows a hyphen and is none of these is an early one.
DEV, ALPHA, BETA, CANDIDATE, FINAL, POST = range(6)
STAGES = {
    "dev": DEV, "a": ALPHA, "alpha": ALPHA, "b": BETA, "beta": BETA, "c": CANDIDATE, "rc": CANDIDATE, "pre": CANDIDATE,
    "preview": CANDIDATE, "post": POST, "rev": POST, "r": POST,
}
HUGE = 1 << 62
KEY = "array<bigint>"
CLAUSE = f"struct<low:{KEY},low_open:boolean,high:{KEY},high_open:boolean,hole:{KEY},seen:string>"
OPERATOR = r"^(===|==|~=|~>|!=|>=|<=|>|<|\^|~|=)?\s*(.*)$"
EMPTY_KEY = f"cast(null as {KEY})"


def numbers(release: Column) -> Column:
    return F.transform(F.split(release, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(HUGE)))


def key_of(numbers_: Column, *tail: Column | int) -> Column:
    """Release numbers as the beginning of a key: plus ten, without zeros at the end, but for a first one."""
    raised = F.transform(numbers_, lambda n: n + 10)
    last = F.array_max(F.transform(raised, lambda n, i: F.when(n != 10, i + 1).otherwise(1)))
    ends = [F.lit(t) if isinstance(t, int) else t for t in tail]
    return F.concat(F.slice(raised, F.lit(1), last), F.array(*(e.cast("bigint") for e in ends))) if ends else F.slice(raised, F.lit(1), last)


def version_key(version: Column) -> Column:
    """The key of a version; null for a text that doesn't begin with one."""
    release = T.find(version, RELEASE)
    tag = F.lower(T.find(version, STAGED, 1))
    stage = reduce(lambda a, e: a.when(tag == e[0], e[1]), list(STAGES.items())[1:], F.when(tag == "dev", DEV))
    stage = F.when(tag != "", stage).when(T.has(version, OTHER), ALPHA).otherwise(FINAL)
    count = F.coalesce(T.find(version, STAGED, 2).try_cast("bigint"), F.lit(0))
    return F.when(release != "", key_of(numbers(release), stage, count))


def bumped(parts: Column, index: Column) -> Column:
    """The key below all versions of the next release at a place of the numbers; even its early stages lie above."""
    return key_of(F.concat(F.slice(parts, F.lit(1), index), F.array(F.element_at(parts, index + 1) + 1)), DEV)


def clause_of(text: Column, bare: str) -> Column:
    """One comparison as an interval; ``bare`` is the operator of a version without one."""
    found = T.strip(text)
    operator = F.when(T.find(found, OPERATOR, 1) == "", F.lit(bare)).otherwise(T.find(found, OPERATOR, 1))
    version = T.strip(T.find(found, OPERATOR, 2))
    wild = T.has(version, r"^[vV]?\d+(\.\d+)*\.[*xX]")
    release = T.find(version, RELEASE)

    def with_parts(parts: Column) -> Column:
        key, size, nothing = version_key(version), F.size(parts), F.expr(EMPTY_KEY)
        leading = F.array_position(F.transform(parts, lambda n: n > 0), True).cast("int")
        caret = F.when(leading > 0, leading - 1).otherwise(size - 1)
        upto = {
            "^": caret, "major": F.lit(0), "~": F.least(size - 1, F.lit(1)),
            "~=": F.greatest(size - 2, F.lit(0)), "~>": F.greatest(size - 2, F.lit(0)),
        }
        equal = operator.isin("==", "===", "=")
        place = F.when(wild, size - 1)
        for name, index in upto.items():
            place = place.when(operator == name, index)
        next_up = bumped(parts, place)
        low = F.when(wild & (operator != "!="), key_of(parts, DEV)).when(operator.isin("<", "<=", "!="), nothing).otherwise(key)
        high = F.when(operator.isin("!=", ">", ">="), nothing).when(wild | operator.isin(*upto), next_up)
        high = high.when(equal | operator.isin("<", "<="), key)
        hole = F.when((operator == "!=") & ~wild, key)
        seen = F.when(~operator.isin("<", "!=") & ~wild, version)
        return F.struct(
            low.alias("low"), (operator == ">").alias("low_open"), high.alias("high"),
            (wild | operator.isin("<", *upto)).alias("high_open"), hole.alias("hole"), seen.alias("seen"),
        ).cast(CLAUSE)

    return F.when(release != "", T.let(numbers(release), with_parts))


def intersection(clauses: Column) -> Column:
    """One interval for all of several clauses: the largest lower bound, the smallest upper one, and all holes."""
    known = F.filter(clauses, lambda c: c.isNotNull())
    lows = F.filter(F.transform(known, lambda c: F.struct(c["low"].alias("key"), c["low_open"].alias("open"))), lambda b: b["key"].isNotNull())
    # of equal upper bounds the open one is smaller
    highs = F.filter(
        F.transform(known, lambda c: F.struct(c["high"].alias("key"), (~c["high_open"]).alias("closed"))), lambda b: b["key"].isNotNull()
    )
    holes = F.filter(F.transform(known, lambda c: c["hole"]), lambda h: h.isNotNull())
    return F.struct(F.array_max(lows).alias("low"), F.array_min(highs).alias("high"), holes.alias("holes"))


def satisfiable(interval: Column) -> Column:
    low, high = interval["low"], interval["high"]
    both = low.isNotNull() & high.isNotNull()
    room = (low["key"] < high["key"]) | ((low["key"] == high["key"]) & ~low["open"] & high["closed"])
    single = (low["key"] == high["key"]) & F.array_contains(interval["holes"], low["key"])
    return F.when(both, room & ~F.coalesce(single, F.lit(False))).otherwise(True)


def inside(key: Column, interval: Column) -> Column:
    low, high = interval["low"], interval["high"]
    above = low.isNull() | (low["key"] < key) | ((low["key"] == key) & ~low["open"])
    below = high.isNull() | (key < high["key"]) | ((high["key"] == key) & high["closed"])
    return above & below & ~F.array_contains(interval["holes"], key)


DECLARED = "struct<ecosystem:string,name:string,spec:string,clauses:array<array<string>>,bare:string>"


def declared(ecosystem: str, name: Column, spec: Column, alternatives: Column, bare: str) -> Column:
    return F.struct(F.lit(ecosystem), name, spec, alternatives, F.lit(bare)).cast(DECLARED)


def comma_separated(spec: Column) -> Column:
    return F.array(F.split(spec, r"\s*,\s*"))


def python_declared(specs: Column) -> Column:
    """Requirements without extras, markers and comments; one that names an address has no range."""
    plain = r"^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*\(?\s*([^;#@)]*)"

    def row(s: Column) -> Column:
        spec = T.strip(T.find(s, plain, 2))
        return declared("pypi", T.find(s, plain, 1), spec, comma_separated(spec), "==")

    return F.transform(F.filter(specs, lambda s: T.has(s, plain)), row)


def npm_declared() -> Column:
    def row(e: Column) -> Column:
        spec = T.strip(F.coalesce(e["value"], F.lit("")))
        close = F.regexp_replace(spec, r"([<>=^~])\s+", "$1")
        span = F.regexp_replace(close, r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
        return declared("npm", e["key"], spec, F.transform(F.split(span, r"\s*\|\|\s*"), lambda a: F.split(a, r"\s+")), "=")

    return F.transform(package_entries(), row)


def go_declared() -> Column:
    usable = lambda s: (F.startswith(s, F.lit("require")) | T.has(s, r"^\S+\s+v")) & T.has(s, R.GO_REQUIRE)

    def row(s: Column) -> Column:
        spec = T.find(s, R.GO_REQUIRE, 2)
        return declared("go", T.find(s, R.GO_REQUIRE, 1), spec, F.array(F.array(spec)), "major")

    return F.transform(F.filter(stripped_lines(C("go_mod")), usable), row)


def cargo_declared() -> Column:
    entry = r"""^["']?([A-Za-z0-9_\-]+)["']?[ \t]*=[ \t]*(?:["']([^"']*)["']|\{[^\n]*?\bversion[ \t]*=[ \t]*["']([^"']*)["'])"""

    def section(s: Column) -> Column:
        def row(x: Column) -> Column:
            spec = T.strip(F.concat(T.find(x, entry, 2), T.find(x, entry, 3)))
            return declared("cargo", T.find(x, entry, 1), spec, comma_separated(spec), "^")

        return F.transform(F.filter(stripped_lines(s["body"]), lambda x: T.has(x, entry)), row)

    wanted = F.filter(toml_sections(C("cargo")), lambda s: s["header"].isin("dependencies", "dev-dependencies"))
    return F.flatten(F.transform(wanted, section))


def gem_declared() -> Column:
    gem = r"""^gem\s+["']([^"']+)["']"""
    bound = r"""["']([~<>=!\s]*\d[^"']*)["']"""

    def row(s: Column) -> Column:
        rest = F.regexp_replace(s, gem, "")
        found = T.find_all(F.substring_index(rest, "#", 1), bound)
        return declared("gem", T.find(s, gem), F.array_join(found, ", "), F.array(found), "=")

    return F.transform(F.filter(stripped_lines(C("gemfile")), lambda s: T.has(s, gem)), row)


def or_none(rows: Column) -> Column:
    return F.coalesce(rows.cast(f"array<{DECLARED}>"), T.empty(DECLARED))


def all_declared() -> Column:
    parts: list[Callable[[], Column]] = [
        lambda: python_declared(requirement_specs()), lambda: python_declared(pyproject_specs()), npm_declared,
        go_declared, cargo_declared, gem_declared,
    ]
    return F.concat(*(or_none(p()) for p in parts))


def parsed(facts: DataFrame) -> DataFrame:
    """Declared dependencies with their range: alternatives, each one interval, and the versions that are named."""
    rows = roots(facts).select("repo", F.posexplode(all_declared()).alias("position", "d")).select("repo", "position", "d.*")
    clauses = F.transform(
        "clauses",
        lambda a: F.transform(
            F.filter(a, lambda x: x != ""),
            lambda x: F.when(C("bare") == "==", clause_of(x, "==")).when(C("bare") == "^", clause_of(x, "^"))
            .when(C("bare") == "major", clause_of(x, "major")).otherwise(clause_of(x, "=")),
        ),
    )
    rows = rows.withColumn("clauses", clauses)
    return rows.withColumn("intervals", F.transform("clauses", intersection)).withColumn("package", F.lower("name"))


def version_ranges(facts: DataFrame) -> DataFrame:
    """Declared ranges, and whether any version can lie in them."""
    rows = parsed(facts).withColumn("satisfiable", F.exists("intervals", satisfiable))
    return rows.select("repo", "position", "ecosystem", "name", "spec", "satisfiable")


def known_versions(rows: DataFrame) -> DataFrame:
    """The newest version of each package that any range names as one it admits; of equal ones the first text."""
    named = rows.select("ecosystem", "package", F.explode(F.flatten("clauses")).alias("c")).where("c.seen is not null")
    best = F.struct(version_key(C("c.seen")).alias("key"), F.regexp_replace("c.seen", r"^[vV=\s]+", "").alias("text"))
    found = named.groupBy("ecosystem", "package").agg(F.max(best).alias("best"))
    return found.select("ecosystem", "package", C("best.key").alias("latest_key"), C("best.text").alias("latest_version"))


def latest_version(facts: DataFrame) -> DataFrame:
    """Each declared dependency with the newest version of its package in the whole corpus, and whether its range admits it.

    A package without a named version has none, and then nothing is said about the range.
    """
    rows = parsed(facts)
    joined = rows.join(known_versions(rows), ["ecosystem", "package"], "left")
    admits = F.when(C("latest_key").isNotNull(), F.exists("intervals", lambda i: inside(C("latest_key"), i)))
    return joined.select("repo", "position", "ecosystem", "name", "spec", "latest_version", admits.alias("admits_latest"))

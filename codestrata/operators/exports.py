"""Public symbols of a repository and the files that use them, through imports and re-exports.

Two signals per file carry all that is needed: what it defines or exports (``symbols``) and what it takes from other
modules (``links``).  Modules become files by equality joins on candidate paths.  A use names a file and a symbol there;
where that file only hands the symbol on, the use moves on along the hand-over, round by round, until no use moves any
more.  A round works on distinct (file, symbol) pairs, never on single uses, and pairs that were met are not met again,
so that circles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import stage
from .architecture import module_map

C = F.col
SYMBOL = "struct<name:string,kind:string,line:int>"
LINK = "struct<module:string,name:string,alias:string,exported:boolean>"
PY_SYMBOL = r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+[A-Za-z_]\w*|^[A-Z][A-Z0-9_]*[ \t]*(?::[^=\n]+)?=(?!=)"
PY_ALL = r"(?m)^__all__[ \t]*=[ \t]*[\[(]([^\])]*)[\])]"
PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#;]+))"
PY_MODULE = r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"
JS_SYMBOL = (
    r"(?m)^[ \t]*export[ \t]+(?:default[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?"
    r"(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+[A-Za-z_$][\w$]*|^[ \t]*export[ \t]+default\b"
)
JS_LIST = r"(?m)^[ \t]*export[ \t]*\{([^}]*)\}[ \t]*(?:;|$)"
JS_HANDED = r"""(?m)^[ \t]*export[ \t]*(?:\{([^}]*)\}|(\*))[ \t]*from[ \t]*['"]([^'"\n]+)['"]"""
JS_NAMED = r"""(?m)^[ \t]*import[ \t]+(?:type[ \t]+)?(?:[\w$]+[ \t]*,[ \t]*)?\{([^}]*)\}[ \t]*from[ \t]*['"]([^'"\n]+)['"]"""
JS_DEFAULT = r"""(?m)^[ \t]*import[ \t]+([\w$]+)[ \t]*(?:,[ \t]*\{[^}]*\}[ \t]*)?from[ \t]*['"]([^'"\n]+)['"]"""
JS_WHOLE = r"""(?m)^[ \t]*import[ \t]*\*[ \t]*as[ \t]+([\w$]+)[ \t]+from[ \t]*['"]([^'"\n]+)['"]"""
JS_REQUIRED = r"""\{([^}]*)\}[ \t]*=[ \t]*require\([ \t]*['"]([^'"\n]+)['"]"""
MEMBER = r"(?<![\w$.])([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)"


def symbol(name: Column, kind: Column, line: Column) -> Column:
    return F.struct(name, kind, line).cast(SYMBOL)


def link(module: Column, name: Column, alias: Column, exported: bool) -> Column:
    return F.struct(module, name, alias, F.lit(exported)).cast(LINK)


def python_symbols(content: Column) -> Column:
    """Definitions at the left margin that are public: those that __all__ lists, or all without a leading underscore."""

    def row(m: Column) -> Column:
        name = F.coalesce(F.nullif(T.find(m["match"], r"(?:def|class)[ \t]+(\w+)"), F.lit("")), T.find(m["match"], r"^(\w+)"))
        kind = F.when(T.has(m["match"], r"^(?:async[ \t]+)?def\b"), "function").when(T.has(m["match"], r"^class\b"), "class")
        return symbol(name, kind.otherwise("constant"), m["line"])

    listed = T.find_all(T.find(content, PY_ALL), r"""["'](\w+)["']""")
    found = F.transform(T.matches_with_lines(content, PY_SYMBOL), row)
    public = lambda s: F.when(T.has(content, PY_ALL), F.array_contains(listed, s["name"])).otherwise(~F.startswith(s["name"], F.lit("_")))
    return F.filter(found, public)


def script_symbols(content: Column) -> Column:
    def row(m: Column) -> Column:
        name = T.find(m["match"], r"(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+([\w$]+)$")
        word = T.find(m["match"], r"(function|class|const|let|var|interface|type|enum)\*?[ \t]+[\w$]+$")
        kind = F.when(word.isin("const", "let", "var"), "constant").when(word == "", "default").otherwise(word)
        default = T.has(m["match"], r"export[ \t]+default\b")
        return symbol(F.when(default, "default").otherwise(name), kind, m["line"])

    def in_list(m: Column) -> Column:
        names = F.filter(F.transform(F.split(T.find(m["match"], r"\{([^}]*)\}"), ","), lambda x: T.strip(x)), lambda x: x != "")
        return F.transform(names, lambda x: symbol(F.element_at(F.split(x, r"\s+as\s+"), -1), F.lit("name"), m["line"]))

    return F.concat(
        F.transform(T.matches_with_lines(content, JS_SYMBOL), row), F.flatten(F.transform(T.matches_with_lines(content, JS_LIST), in_list))
    )


def pairs(listed: Column) -> Column:
    """array<struct<name,alias>> of a list such as ``a, b as c``."""
    items = F.filter(F.transform(F.split(listed, ","), lambda x: T.strip(x)), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(F.element_at(F.split(x, r"\s+as\s+"), 1).alias("name"), F.element_at(F.split(x, r"\s+as\s+"), -1).alias("alias")),
    )


def groups(content: Column, pattern: str, *fields: str) -> Column:
    found = [T.find_all(content, pattern, i + 1) for i in range(len(fields))]
    return F.arrays_zip(*found).cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")


def members(content: Column, wholes: Column) -> Column:
    """Symbols that a file reads from modules it holds as a whole: ``wholes`` are links whose alias is the module's name."""
    used = F.array_distinct(groups(content, MEMBER, "owner", "member"))
    named = F.flatten(
        F.transform(
            wholes,
            lambda w: F.transform(
                F.filter(used, lambda u: u["owner"] == w["alias"]), lambda u: link(w["module"], u["member"], u["member"], False)
            ),
        )
    )
    return F.when(F.size(wholes) > 0, named).otherwise(T.empty(LINK))


def python_links(content: Column) -> Column:
    """What ``from`` takes, which the file then hands on as well, and members of modules taken as a whole."""
    taken = F.flatten(
        F.transform(
            groups(content, PY_FROM, "module", "many", "few"),
            lambda f: F.transform(
                pairs(F.regexp_replace(F.concat(f["many"], f["few"]), r"#[^\n]*|\\", "")),
                lambda p: link(f["module"], p["name"], p["alias"], True),
            ),
        )
    )
    wholes = F.transform(
        F.flatten(F.transform(T.find_all(content, PY_MODULE), pairs)), lambda p: link(p["name"], F.lit("*"), p["alias"], False)
    )
    # ``from . import module`` also takes a module as a whole; its members then stand in the module of that name
    from_folder = F.transform(
        F.filter(taken, lambda t: T.has(t["module"], r"^\.+$")), lambda t: link(F.concat(t["module"], t["name"]), F.lit("*"), t["alias"], False)
    )
    held = F.concat(wholes, from_folder)
    return F.when(F.contains(content, F.lit("import")), F.concat(taken, T.let(held, lambda w: members(content, w)))).otherwise(T.empty(LINK))


def script_links(content: Column) -> Column:
    def named(pattern: str) -> Column:
        return F.flatten(
            F.transform(groups(content, pattern, "names", "module"), lambda f: F.transform(pairs(F.regexp_replace(f["names"], r"(?m)\btype[ \t]+|:", " as ")), lambda p: link(f["module"], p["name"], p["alias"], False)))
        )

    handed = F.flatten(
        F.transform(
            groups(content, JS_HANDED, "names", "star", "module"),
            lambda f: F.when(f["star"] != "", F.array(link(f["module"], F.lit("*"), F.lit("*"), True))).otherwise(
                F.transform(pairs(f["names"]), lambda p: link(f["module"], p["name"], p["alias"], True))
            ),
        )
    )
    default = F.transform(groups(content, JS_DEFAULT, "name", "module"), lambda f: link(f["module"], F.lit("default"), f["name"], False))
    wholes = F.transform(groups(content, JS_WHOLE, "name", "module"), lambda f: link(f["module"], F.lit("*"), f["name"], False))
    found = F.concat(named(JS_NAMED), named(JS_REQUIRED), handed, default, T.let(wholes, lambda w: members(content, w)))
    needed = T.holds_any(content, ["import", "export", "require"])
    # only relative modules are files of the repository
    return F.when(needed, F.filter(found, lambda x: F.startswith(x["module"], F.lit(".")))).otherwise(T.empty(LINK))


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def joined(folder: Column, rest: Column) -> Column:
    """A path below a folder, with its steps up and its single dots taken away; null if it leaves the repository."""
    steps = F.filter(F.split(F.concat_ws("/", folder, rest), "/"), lambda s: (s != "") & (s != "."))
    start = F.expr("cast(struct(array(), false) as struct<at:array<string>,out:boolean>)")

    def step(state: Column, s: Column) -> Column:
        up = F.slice(state["at"], F.lit(1), F.greatest(F.size(state["at"]) - 1, F.lit(0)))
        at = F.when(s == "..", up).otherwise(F.concat(state["at"], F.array(s)))
        return F.struct(at, state["out"] | ((s == "..") & (F.size(state["at"]) == 0))).cast("struct<at:array<string>,out:boolean>")

    return F.aggregate(steps, start, step, lambda z: F.when(~z["out"], F.array_join(z["at"], "/")))


def candidates() -> Column:
    """Paths that a link's module may stand for, the best first."""
    script = T.is_in("suffix", R.JS_GRAPH_SUFFIXES)
    here, module = folder_of(C("path")), C("module")
    dots = F.length(T.find(module, r"^(\.+)"))
    plain = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), plain)
    beside = joined(here, F.when(dots > 0, up).otherwise(plain))

    def python(base: Column) -> list[Column]:
        return [F.concat(base, F.lit(end)) for end in (".py", ".pyi")] + [joined(base, F.lit("__init__.py"))]

    relative = joined(here, module)
    js = F.array(relative, *(F.concat(relative, F.lit(s)) for s in R.JS_GRAPH_SUFFIXES), *(joined(relative, F.lit(f"index{s}")) for s in R.JS_GRAPH_SUFFIXES))
    absolute = F.array(*python(beside), *python(plain))
    return F.when(script, js).when(dots > 0, F.array(*python(beside))).otherwise(absolute)


def resolved_links(tree: DataFrame) -> DataFrame:
    """Links with the file they lead to: a path beside the importing file, one from the root, or the file of that name."""
    rows = T.explode_kept(tree.select("repo", "path", "suffix", "links"), "links", "l").select("repo", "path", "suffix", "l.*")
    modules = rows.select("repo", "path", "suffix", "module").distinct()
    places = modules.select("repo", "path", "module", F.posexplode(candidates()).alias("place", "target"))
    files = tree.select("repo", C("path").alias("target"))
    exact = places.join(files, ["repo", "target"]).select("repo", "path", "module", "place", "target")
    python = modules.where(T.is_in("suffix", R.PY_GRAPH_SUFFIXES) & ~F.startswith("module", F.lit(".")))
    stem = python.join(module_map(tree), ["repo", "module"]).select("repo", "path", "module", F.lit(1000).alias("place"), "target")
    found = exact.unionByName(stem).groupBy("repo", "path", "module").agg(F.min(F.struct("place", "target")).alias("t"))
    led = rows.join(found, ["repo", "path", "module"]).select("repo", "path", "name", "alias", "exported", C("t.target").alias("target"))
    return led.where("target <> path")


def definitions(tree: DataFrame) -> DataFrame:
    """Public symbols; of several of one name in a file the first counts."""
    rows = T.explode_kept(tree.select("repo", "path", "symbols"), "symbols", "s").select("repo", "path", "s.*")
    first = rows.groupBy("repo", "path", "name").agg(F.min(F.struct("line", "kind")).alias("d"))
    return first.select("repo", "path", "name", "d.kind", "d.line")


def uses(tree: DataFrame) -> DataFrame:
    """(repo, user, path, name): which file uses which symbol of which file, through all hand-overs."""
    links = stage(resolved_links(tree), "links")
    known = stage(definitions(tree).select("repo", C("path").alias("target"), "name"), "definitions")
    handed = links.where("exported and alias <> '*'").select("repo", C("path").alias("target"), C("alias").alias("name"), C("target").alias("to"), C("name").alias("to_name"))
    star = links.where("exported and name = '*'").select("repo", C("path").alias("target"), C("target").alias("to")).distinct()
    taken = links.where("name <> '*'").select("repo", C("path").alias("user"), "target", "name").distinct()
    # a star takes every public symbol of its file
    whole = links.where("name = '*'").select("repo", C("path").alias("user"), "target").join(known, ["repo", "target"])
    used = stage(taken.unionByName(whole).distinct(), "uses")

    # (from, symbol) -> (at, symbol): where a use that names the former has come to
    pairs_ = used.select("repo", "target", "name").distinct()
    moving = stage(pairs_.select("*", C("target").alias("at"), C("name").alias("as")), "moving")
    rounds = [moving]
    key = ["repo", "target", "name", "at", "as"]
    while True:
        here = known.select("repo", C("target").alias("at"), C("name").alias("as"))
        open_ = moving.join(here, ["repo", "at", "as"], "left_anti")
        named = open_.join(handed.toDF("repo", "at", "as", "to", "to_name"), ["repo", "at", "as"]).select("repo", "target", "name", C("to").alias("at"), C("to_name").alias("as"))
        through = open_.join(star.toDF("repo", "at", "to"), ["repo", "at"]).select("repo", "target", "name", C("to").alias("at"), "as")
        met = reduce(DataFrame.unionByName, rounds)
        moving = stage(named.unionByName(through).where(C("as") != "*").distinct().join(met, key, "left_anti"), "moving")
        if moving.isEmpty():
            break
        rounds.append(moving)
    found = reduce(DataFrame.unionByName, rounds).join(here, ["repo", "at", "as"], "left_semi")
    ended = found.select("repo", "target", "name", C("at").alias("path"), C("as").alias("symbol"))
    led = used.join(ended, ["repo", "target", "name"]).where("user <> path")
    return led.select("repo", "user", "path", C("symbol").alias("name")).distinct()


def public_exports(tree: DataFrame) -> DataFrame:
    """Public symbols with the number of other files that use them; ``used`` is false for those that no file does."""
    counted = uses(tree).groupBy("repo", "path", "name").agg(F.count(F.lit(1)).alias("uses"))
    rows = definitions(tree).join(counted, ["repo", "path", "name"], "left").fillna(0, ["uses"])
    return rows.select("repo", "path", "name", "kind", "line", "uses", (C("uses") > 0).alias("used"))

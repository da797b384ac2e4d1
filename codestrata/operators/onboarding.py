"""What a newcomer reads first: summary, set-up, tests, pitfalls, terms and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.scale import first_rows
from .architecture import entry_points, key_files, layers, project_type, structure_pattern
from .debt import fixed
from .history import top_contributors as history_top
from .languages import language_breakdown
from .manifests import roots, script, there

C = F.col
READMES = dict(zip(["readme_md", "readme_rst", "readme_txt", "readme"], R.README_NAMES))


def summary_of(content: Column) -> Column:
    """First paragraph of more than twenty characters, without headings and markup."""

    def token(line: Column) -> Column:
        s = T.strip(line)
        ends = (s == "") | F.startswith(s, F.lit("#"))
        skipped = T.has(s, r"^(?:```|!\[|\||\[!?\[)") | T.has(s, r"^\[.*\]\(.*\)\s*$")
        quoted = F.when(F.startswith(s, F.lit(">")), T.strip(F.substring(s, 2, 1 << 30))).otherwise(s)
        linked = F.regexp_replace(quoted, r"\[([^\]]+)\]\([^)]+\)", "$1")
        plain = F.regexp_replace(linked, r"\*{1,2}([^*]+)\*{1,2}", "$1")
        return F.when(ends, "\x01").when(~skipped & (plain != ""), plain)

    tokens = F.filter(F.transform(T.split_lines(F.translate(content, "\x01\x02", "")), token), lambda t: t.isNotNull())
    paragraphs = F.transform(
        F.split(F.array_join(tokens, "\x02"), "\x01", -1),
        lambda p: F.replace(T.strip(p, "\x02"), F.lit("\x02"), F.lit(" ")),
    )
    fitting = F.filter(paragraphs, lambda p: (F.length(p) > 20) & ~F.startswith(p, F.lit("```")))
    return F.when(content == "", R.EMPTY_README).otherwise(F.coalesce(F.get(fitting, F.lit(0)), T.strip(content)))


def readme_of() -> Column:
    return F.coalesce(*READMES)


def readme_pick(facts: DataFrame) -> DataFrame:
    named = F.coalesce(*(F.when(there(c), F.lit(n)) for c, n in READMES.items()))
    return roots(facts).select("repo", named.alias("readme")).where("readme is not null")


def project_summary() -> Column:
    return F.coalesce(summary_of(readme_of()), F.lit(R.NO_README))


def readme_summary(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", project_summary().alias("project_summary"))


HEADING = r"(?im)^#+[ \t\r]*(?:install|setup|getting started|quickstart|usage|run)"
STOP = r"(?m)^(?!(?i:#+[ \t\r]*(?:install|setup|getting started|quickstart|usage|run)))#+[ \t\r]"
FENCE = r"(?m)^[ \t\r]*```[^\n]*(?:\n|\z)"


def setup_commands(content: Column) -> Column:
    """array<string> of fenced lines from the first set-up heading up to the next other heading.

    Cut at the fence lines, the text alternates between outside and inside.
    """
    lined = T.plain_breaks(content)

    def commands(pieces: Column) -> Column:
        stops = F.transform(pieces, lambda p, i: F.when((i % 2 == 0) & T.has(p, STOP), i))
        last = F.coalesce(F.array_min(stops), F.size(pieces))

        def read(end: Column) -> Column:
            inside = F.filter(pieces, lambda p, i: (i % 2 == 1) & (i < end))
            lines = F.transform(F.flatten(F.transform(inside, T.split_lines)), lambda s: T.strip(s))
            return F.filter(lines, lambda s: s != "")

        return T.let(last, read)

    # without a heading the text is empty and has no inside
    tail = T.find(lined, f"{HEADING}(?s:.*)", 0)
    return T.let(F.split(tail, T.rx(FENCE), -1), commands)


def readme_steps_of() -> Column:
    """Steps of README.md, or of README.rst where the first has none."""
    first = F.coalesce(F.when(C("any_readme_md"), setup_commands(C("readme_md"))), T.empty("string"))
    second = F.coalesce(F.when(C("any_readme_rst"), setup_commands(C("readme_rst"))), T.empty("string"))
    return T.let(first, lambda steps: F.when(F.size(steps) > 0, steps).otherwise(second))


def readme_setup_steps(facts: DataFrame) -> DataFrame:
    rows = []
    for column in ("readme_md", "readme_rst"):
        rows.append(F.struct(F.lit(READMES[column]).alias("readme"), setup_commands(C(column)).alias("steps")))
    each = roots(facts).select("repo", F.inline(F.array(*rows)))
    return each.select("repo", "readme", F.posexplode("steps").alias("at", "command")).select(
        "repo", "readme", (C("at") + 1).alias("position"), "command"
    )


NAMES = {
    "README.md": "any_readme_md", "README.rst": "any_readme_rst", "setup.py": "any_setup_py",
    "requirements.txt": "any_requirements", "package.json": "any_package", "pyproject.toml": "any_pyproject",
    "pytest.ini": "any_pytest_ini", "setup.cfg": "any_setup_cfg", "Makefile": "any_makefile",
    ".env": "any_env", ".env.example": "any_env_example", ".nvmrc": "any_nvmrc", ".node-version": "any_node_version",
}


def presence_columns() -> list[Column]:
    """Which file names the walk meets anywhere, with two switches on paths and contents."""
    named = [F.expr(f"coalesce(bool_or(walked and name = {T.quoted(n)}), false) as {c}") for n, c in NAMES.items()]
    env = C("walked") & (T.has(C("path"), R.ENV_REFERENCE) | C("reads_env"))
    tested = F.expr("coalesce(bool_or(walked and contains(lower(path), 'test')), false) as any_test")
    return [*named, F.coalesce(F.bool_or(env), F.lit(False)).alias("any_env_reference"), tested]


def presence(tree: DataFrame) -> DataFrame:
    return tree.groupBy("repo").agg(*presence_columns())


def with_roots(tree: DataFrame, every: DataFrame) -> DataFrame:
    return presence(tree).join(roots(every), "repo")


def setup_steps_of() -> Column:
    kind = "array<struct<description:string,command:string>>"
    inferred = F.array(
        *(F.when(C(NAMES[n]), F.struct(F.lit(text), F.lit(command))) for n, text, command in R.FALLBACK_SETUP)
    )

    def choose(steps: Column) -> Column:
        read = F.transform(steps, lambda s: F.struct(F.concat(F.lit("Run: "), s), s)).cast(kind)
        return F.when(F.size(steps) > 0, read).otherwise(F.filter(inferred, lambda x: x.isNotNull()).cast(kind))

    return T.let(readme_steps_of(), choose)


def setup_steps(tree: DataFrame, every: DataFrame) -> DataFrame:
    rows = with_roots(tree, every).select("repo", F.posexplode(setup_steps_of()).alias("at", "s"))
    return rows.select("repo", (C("at") + 1).alias("position"), "s.description", "s.command")


def test_commands_of() -> Column:
    readme = F.coalesce(F.when(C("any_readme_md"), C("readme_md")), F.lit(""))
    section = T.find(readme, r"(?is)##\s*test.*?\n.*?(?=\n##|\z)", 0)
    blocks = T.find_all(section, r"(?s)```[a-z]*\n(.*?)```", 1)
    lines = F.transform(
        F.flatten(F.transform(blocks, lambda b: T.split_lines(T.strip(b)))), lambda s: T.strip(s)
    )
    lines = F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    targets = T.find_all(F.coalesce(F.when(C("any_makefile"), C("makefile")), F.lit("")), R.MAKE_TEST_TARGET, 1)
    fixed_ones = F.array(
        F.when(C("any_package") & script("test").isNotNull(), "npm test"),
        F.when(C("any_package") & script("test:unit").isNotNull(), "npm run test:unit"),
        F.when(C("any_pytest_ini") | C("any_pyproject") | C("any_setup_cfg"), "pytest"),
    )
    made = F.transform(targets, lambda t: F.concat(F.lit("make "), t))
    return F.array_distinct(F.filter(F.concat(fixed_ones, lines, made), lambda c: c.isNotNull()))


def test_commands(tree: DataFrame, every: DataFrame) -> DataFrame:
    rows = with_roots(tree, every).select("repo", F.posexplode(test_commands_of()).alias("at", "command"))
    return rows.select("repo", (C("at") + 1).alias("position"), "command")


def gotchas_of() -> Column:
    tests = [
        ~C("any_env") & ~C("any_env_example") & C("any_env_reference"),
        ~C("any_test"),
        C("any_requirements") & ~C("any_makefile"),
        C("any_package") & ~C("any_nvmrc") & ~C("any_node_version"),
    ]
    rows = F.array(*(F.when(t, F.lit(text)) for t, text in zip(tests, R.GOTCHAS)))
    return F.filter(rows, lambda x: x.isNotNull())


def gotchas(tree: DataFrame) -> DataFrame:
    rows = presence(tree).select("repo", F.posexplode(gotchas_of()).alias("at", "gotcha"))
    return rows.select("repo", (C("at") + 1).alias("position"), "gotcha")


def defined_terms(tree: DataFrame) -> DataFrame:
    """Constants with a short text, one row for each place that defines one."""
    usable = F.filter(
        "terms", lambda t: (F.length(t["term"]) <= 30) & ~t["term"].isin(R.GLOSSARY_IGNORED)
    )
    rows = tree.where(T.is_in("suffix", R.GLOSSARY_SUFFIXES)).select("repo", "parts", usable.alias("terms"))
    terms = rows.select("repo", "parts", F.posexplode_outer("terms").alias("at", "t")).where("t is not null")
    return terms.select("repo", "t.term", "t.meaning", F.struct("parts", "at").alias("place"))


def glossary(tree: DataFrame) -> DataFrame:
    """All terms; a later value replaces an earlier one."""
    return defined_terms(tree).groupBy("repo", "term").agg(F.max_by("meaning", "place").alias("meaning"))


def first_terms(tree: DataFrame, limit: int = 10) -> DataFrame:
    """The first few terms in file order, as a report shows them; reading stops at the last of them."""
    placed = defined_terms(tree)
    firsts = placed.groupBy("repo", "term").agg(F.min("place").alias("first"))
    chosen = first_rows(firsts, ["repo"], [F.asc("first")], limit, "position")
    ends = chosen.where(C("position") == limit).select("repo", C("first").alias("end"))
    bounded = chosen.join(ends, "repo", "left").select("repo", "term", "position", "end")
    read = placed.join(bounded, ["repo", "term"])
    return (
        read.where("end is null or place <= end")
        .groupBy("repo", "term", "position")
        .agg(F.max_by("meaning", "place").alias("meaning"))
        .select("repo", "position", "term", "meaning")
    )


def joined_text(rows: DataFrame, order: list[Column], limit: int, text: Column, name: str) -> DataFrame:
    """Text of the first few rows of a repository, separated by commas."""
    few = first_rows(rows, ["repo"], order, limit, "at").select("repo", "at", text.alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    return few.groupBy("repo").agg(F.array_join(listed["text"], ", ").alias(name))


def overview_parts(breakdown: DataFrame, entries: DataFrame, layer_files: DataFrame) -> list[DataFrame]:
    """The three lists of the overview as one text each."""
    shown = F.concat("language", F.lit(" ("), fixed(C("percentage"), 0), F.lit("%)"))
    tops = joined_text(breakdown, [F.desc("percentage"), F.asc("language")], 3, shown, "top_languages")
    entry = F.concat("path", F.lit(" ("), C("entry_type"), F.lit(")"))
    starts = joined_text(entries, [F.asc(F.split("path", "/"))], 3, entry, "first_entries")
    seen = layer_files.groupBy("repo", "layer").agg(F.min(F.split("path", "/")).alias("first"))
    layered = joined_text(seen, [F.asc("first")], 5, C("layer"), "first_layers")
    return [tops, starts, layered]


def overview_of() -> Column:
    using = F.when(C("framework").isNotNull(), F.concat(F.lit(" using "), "framework")).otherwise("")
    return F.concat_ws(
        " ",
        F.concat(
            F.lit("This is a "), C("project_type"), F.lit(" project"), using,
            F.lit(" with a "), C("structure_pattern"), F.lit(" structure."),
        ),
        F.concat(F.lit("Primary languages: "), C("top_languages"), F.lit(".")),
        F.concat(F.lit("Entry points: "), C("first_entries"), F.lit(".")),
        F.concat(F.lit("Layers detected: "), C("first_layers"), F.lit(".")),
    )


def architecture_overview(tree: DataFrame, every: DataFrame) -> DataFrame:
    rows = project_type(tree, every).join(structure_pattern(tree), "repo")
    for part in overview_parts(language_breakdown(tree), entry_points(tree), layers(tree)):
        rows = rows.join(part, "repo", "left")
    return rows.select("repo", overview_of().alias("architecture_overview"))


def top_contributors(commits: DataFrame) -> DataFrame:
    return history_top(commits)


def onboarding_key_files(tree: DataFrame) -> DataFrame:
    return key_files(tree).where("rank <= 10")

"""What it takes to set a repository up and run it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T

from .manifests import roots, script, there, toml_body

C = F.col


def or_empty(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


def kept(tests: list[Column], values: list[Column]) -> Column:
    """Array of the values whose test holds, in order."""
    rows = F.array(*(F.when(t, v) for t, v in zip(tests, values)))
    return F.filter(rows, lambda x: x.isNotNull())


def has_python() -> Column:
    return there("requirements") | there("setup_py") | there("setup_cfg") | there("pyproject")


def prerequisites_of() -> Column:
    declared = T.find(or_empty("pyproject"), R.REQUIRES_PYTHON)
    configured = T.strip(T.find(or_empty("setup_cfg"), R.CFG_PYTHON))
    has_cfg = T.has(or_empty("setup_cfg"), R.CFG_PYTHON)
    python = F.when(declared != "", declared).when(has_cfg, configured)
    go = T.find(or_empty("go_mod"), R.GO_VERSION)
    none = F.lit(None).cast("string")
    versions = {
        "python": python,
        "node.js": F.try_element_at(C("npm")["engines"], F.lit("node")),
        "docker": none,
        "go": F.when(go != "", go),
        "rust": none,
    }
    tests = [
        has_python(),
        there("package"),
        there("compose_1") | there("compose_2") | C("has_dockerfile"),
        there("go_mod"),
        there("cargo"),
    ]
    rows = [
        F.struct(F.lit(n).alias("name"), v.alias("version"), F.lit(R.PREREQUISITE_URLS[n]).alias("install_url"))
        for n, v in versions.items()
    ]
    return kept(tests, rows)


def install_steps_of() -> Column:
    named = T.has(F.coalesce(toml_body(C("pyproject"), "project"), F.lit("")), r"""(?m)^[ \t]*name\s*=\s*["'][^"'\n]+["']""")
    installer = (
        F.when(C("has_yarn_lock"), "yarn install").when(C("has_pnpm_lock"), "pnpm install").otherwise("npm install")
    )
    tests = [
        there("requirements"),
        there("pyproject") & (~there("requirements") | named),
        there("package"),
        there("env_example"),
        there("go_mod"),
        there("cargo"),
    ]
    rows = [
        F.struct(
            F.lit(text).alias("description"),
            (installer if command == "npm install" else F.lit(command)).alias("command"),
        )
        for text, command in R.INSTALL_STEPS
    ]
    return kept(tests, rows)


def listed(root_rows: DataFrame, rows: Column, fields: list[str]) -> DataFrame:
    exploded = root_rows.select("repo", F.posexplode(rows).alias("at", "row"))
    return exploded.select("repo", (C("at") + 1).alias("position"), *(f"row.{f}" for f in fields))


def prerequisites(facts: DataFrame) -> DataFrame:
    return listed(roots(facts), prerequisites_of(), ["name", "version", "install_url"])


def install_steps(facts: DataFrame) -> DataFrame:
    return listed(roots(facts), install_steps_of(), ["description", "command"])


def assignments(content: Column) -> Column:
    """array<struct<name, value>> of the lines of an environment file that assign."""
    lines = F.transform(T.split_lines(content), lambda s: T.strip(s))
    wanted = F.filter(lines, lambda s: ~F.startswith(s, F.lit("#")) & T.has(s, R.ENV_LINE))
    return F.transform(
        wanted,
        lambda s: F.struct(T.find(s, R.ENV_LINE, 1).alias("name"), T.strip(T.find(s, R.ENV_LINE, 2)).alias("value")),
    )


def env_vars(facts: DataFrame) -> DataFrame:
    """Variables of .env.example, .env, Python and JavaScript; the first source of a name counts.

    TypeScript is read only in repositories without any .js file.
    """
    # source of a name: 1 example file, 2 .env, 3 Python, 4 JavaScript, 5 TypeScript
    source = (
        F.when(C("path") == ".env.example", 1).when(C("path") == ".env", 2)
        .when(C("suffix") == ".py", 3).when(C("suffix") == ".js", 4).when(C("suffix") == ".ts", 5)
    )
    none = F.lit(None).cast("string")
    entry = "array<struct<name:string,value:string>>"
    declared = assignments(C("manifest")).cast(entry)
    mentioned = F.transform("env_names", lambda n: F.struct(n, none)).cast(entry)
    names = F.when(C("path").isin(".env.example", ".env"), declared).otherwise(mentioned)
    rows = facts.where(source.isNotNull()).select("repo", "path", source.alias("source"), names.alias("names"))
    exploded = rows.select("repo", "source", F.posexplode_outer("names").alias("at", "entry")).where("entry is not null")
    example = F.max(F.when(C("source") == 1, F.struct("at", F.col("entry.value").alias("value"))))
    merged = exploded.groupBy("repo", C("entry.name").alias("name")).agg(
        F.min("source").alias("source"), example.alias("example")
    )
    scripted = (
        facts.where("suffix = '.js'").select("repo").distinct().withColumn("has_js", F.lit(True))
    )
    joined = merged.join(scripted, "repo", "left")
    value = C("example.value")
    return joined.where("source < 5 or has_js is null").select(
        "repo",
        "name",
        (C("source") == 1).alias("required"),
        F.when(value != "", value).alias("example"),
    )


def database_of() -> Column:
    words = "|".join(R.DATABASE_WORDS)
    return or_empty("compose_1").rlike(words) | or_empty("compose_2").rlike(words)


def database_setup(facts: DataFrame) -> DataFrame:
    text, command = R.DATABASE_STEP
    return roots(facts).where(database_of()).select(
        "repo", F.lit(text).alias("description"), F.lit(command).alias("command")
    )


def run_commands_of() -> Column:
    """array<struct<label, command>>: first README line per tool, then package.json scripts."""

    def tool(line: Column) -> Column:
        found = None
        for word in R.RUN_KEYWORDS:
            test, label = F.contains(F.lower(line), F.lit(word)), F.lit(word.split()[0])
            found = F.when(test, label) if found is None else found.when(test, label)
        return found

    def in_readme(content: Column) -> Column:
        blocks = T.find_all(content, R.RUN_BLOCK, 1)
        lines = F.flatten(F.transform(blocks, lambda b: T.split_lines(T.strip(b))))
        rows = F.transform(lines, lambda s: F.struct(tool(T.strip(s)).alias("label"), T.strip(s).alias("command")))
        return F.filter(rows, lambda r: r["label"].isNotNull())

    readmes = ["readme_md", "readme_rst", "readme_txt", "readme"]
    found = F.concat(*(in_readme(or_empty(r)) for r in readmes))

    def first(label: str) -> Column:
        return F.get(F.filter(found, lambda r: r["label"] == label), F.lit(0))

    firsts = F.array(*map(first, dict.fromkeys(w.split()[0] for w in R.RUN_KEYWORDS)))
    scripts = F.array(
        F.when(script("dev").isNotNull(), F.struct(F.lit("dev").alias("label"), F.lit("npm run dev").alias("command"))),
        F.when(script("start").isNotNull(), F.struct(F.lit("start").alias("label"), F.lit("npm start").alias("command"))),
    )
    return F.filter(F.concat(firsts, scripts), lambda r: r.isNotNull())


def run_commands(facts: DataFrame) -> DataFrame:
    return listed(roots(facts), run_commands_of(), ["label", "command"]).drop("position")


def test_command_of() -> Column:
    pytest = F.contains(F.lower(or_empty("requirements")), F.lit("pytest")) | F.contains(
        F.lower(or_empty("pyproject")), F.lit("pytest")
    )
    test = script("test")
    return (
        F.when(pytest, "pytest")
        .when(F.contains(F.lower(test), F.lit("jest")), "jest")
        .when(test.isNotNull(), test)
        .when(there("go_mod"), "go test ./...")
        .when(there("cargo"), "cargo test")
    )


def test_command(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", test_command_of().alias("test_command"))


def build_command_of() -> Column:
    return F.when(script("build").isNotNull(), "npm run build")


def build_command(facts: DataFrame) -> DataFrame:
    return roots(facts).select("repo", build_command_of().alias("build_command"))


def common_issues_of() -> Column:
    rows = [F.struct(F.lit(d).alias("description"), F.lit(s).alias("solution")) for d, s in R.COMMON_ISSUES]
    return kept([has_python(), there("package"), there("env_example")], rows)


def common_issues(facts: DataFrame) -> DataFrame:
    return listed(roots(facts), common_issues_of(), ["description", "solution"])

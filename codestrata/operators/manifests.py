"""Files at the root of a repository, one row per repository.

At most one file per fixed name exists, so the row is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col

# root files whose text is read
ROOT_TEXTS = {
    "requirements": "requirements.txt", "pyproject": "pyproject.toml", "package": "package.json",
    "go_mod": "go.mod", "cargo": "Cargo.toml", "gemfile": "Gemfile", "setup_cfg": "setup.cfg",
    "setup_py": "setup.py", "makefile": "Makefile", "gitignore": ".gitignore", "env": ".env", "env_example": ".env.example",
    "readme_md": "README.md", "readme_rst": "README.rst", "readme_txt": "README.txt", "readme": "README",
    "compose_1": "docker-compose.yml", "compose_2": "docker-compose.yaml",
    "compose_3": "compose.yml", "compose_4": "compose.yaml",
}
# root files that only have to exist
ROOT_MARKS = {
    "yarn_lock": "yarn.lock", "pnpm_lock": "pnpm-lock.yaml", "dockerfile": "Dockerfile",
}
PACKAGE = (
    "license string, engines map<string,string>, scripts map<string,string>, "
    "dependencies map<string,string>, devDependencies map<string,string>, "
    "peerDependencies map<string,string>"
)


def repos(rows: DataFrame) -> DataFrame:
    return rows.select("repo").distinct()


def root_columns() -> list[Column]:
    texts = [f"max(case when path = {T.quoted(p)} then manifest end) as {c}" for c, p in ROOT_TEXTS.items()]
    marks = [f"coalesce(bool_or(path = {T.quoted(p)}), false) as has_{c}" for c, p in ROOT_MARKS.items()]
    return [F.expr(x) for x in texts + marks]


def is_root_file() -> Column:
    return T.is_in("path", [*ROOT_TEXTS.values(), *ROOT_MARKS.values()])


def complete(rows: DataFrame) -> DataFrame:
    """Fill in what repositories without root files lack, and parse package.json."""
    flat = rows.fillna(False, [f"has_{c}" for c in ROOT_MARKS])
    return flat.withColumn("npm", F.from_json("package", PACKAGE))


def roots(rows: DataFrame) -> DataFrame:
    """Root manifests side by side; null where a repository lacks the file."""
    found = rows.where(is_root_file()).groupBy("repo").agg(*root_columns())
    return complete(repos(rows).join(found, "repo", "left"))


def there(column: str) -> Column:
    return C(column).isNotNull()


def script(name: str) -> Column:
    """Text of a package.json script; null when it is not declared."""
    return F.try_element_at(C("npm")["scripts"], F.lit(name))


def toml_sections(content: Column) -> Column:
    """array<struct<header:string,body:string>> of a TOML text."""
    header = r"(?m)^[ \t]*\[+([^\[\]\n=,]+)\]+[ \t]*(?:#[^\n]*)?$"
    marked = F.regexp_replace(F.translate(content, "\x01\x02", "  "), T.rx(header), "\x01$1\x02")
    pieces = F.slice(F.split(marked, "\x01", -1), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda s: F.struct(
            T.strip(F.substring_index(s, "\x02", 1)).alias("header"),
            F.substring_index(s, "\x02", -1).alias("body"),
        ),
    )


def toml_body(content: Column, header: str) -> Column:
    return F.get(F.filter(toml_sections(content), lambda s: s["header"] == header), F.lit(0))["body"]

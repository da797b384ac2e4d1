"""Column helpers for text: lines, regex matches, trimming.

All helpers work inside one row, so extracting lines or matches never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"
LINE_BREAK = "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def rx(pattern: str) -> str:
    """Java form of a shared pattern: only a newline ends a line for '.', '^' and '$'."""
    return "(?d)" + pattern


def strip(col: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(col, F.lit(chars))


def rstrip(col: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(col, F.lit(chars))


def lstrip(col: Column, chars: str = WHITESPACE) -> Column:
    return F.ltrim(col, F.lit(chars))


def quoted(value: str) -> str:
    """SQL literal of a text without control characters."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_in(column: str, values: list[str]) -> Column:
    return F.expr(f"{column} in ({', '.join(map(quoted, values))})")


def lookup(entries: dict, column: str) -> Column:
    """Value of a fixed map for a column; null where the key is unknown."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v) if isinstance(v, str) else v}" for k, v in entries.items())
    return F.expr(f"map({pairs})[{column}]")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty(ddl: str) -> Column:
    return F.expr(f"cast(array() as array<{ddl}>)")


def has(col: Column, pattern: str) -> Column:
    return col.rlike(rx(pattern))


def find(col: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; empty string when there is none."""
    return F.regexp_extract(col, rx(pattern), group)


def find_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern)), F.lit(group))


def holds_any(col: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(n)) for n in needles))


def count_of(col: Column, pattern: str, needles: list[str] | None = None) -> Column:
    """Number of matches; texts without any of the needles, which every match contains, are not searched."""
    count = F.regexp_count(col, F.lit(rx(pattern)))
    return count if needles is None else F.when(holds_any(col, needles), count).otherwise(0)


def plain_breaks(col: Column) -> Column:
    """Text in which every line break is a newline."""
    rare = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    return F.when(col.rlike(f"[{rare}]"), F.translate(col, rare, "\n" * len(rare))).otherwise(col)


def split_lines(col: Column) -> Column:
    """Lines of a text; a break at the very end starts no further line."""
    ended = F.right(col, F.lit(1)).rlike(LINE_BREAK)
    body = F.when(ended, F.left(col, F.length(col) - 1)).otherwise(col)
    return F.when(col == "", empty("string")).otherwise(F.split(body, LINE_BREAK, -1))


def numbered_lines(col: Column) -> Column:
    """array<struct<line:int,text:string>>, numbered from one."""
    return F.transform(
        split_lines(col), lambda text, i: F.struct((i + 1).alias("line"), text.alias("text"))
    )


def line_count(col: Column) -> Column:
    breaks = F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
    unfinished = (col != "") & ~F.endswith(col, F.lit("\n"))
    return (breaks + unfinished.cast("int")).cast("bigint")


def matches_with_lines(col: Column, pattern: str) -> Column:
    """array<struct<line:int,match:string>>: every match with the line it starts on.

    Each match is prefixed by a control character; splitting the marked text at
    newlines then tells how many matches start on each line.  Linear in the text
    and local to the row.
    """
    clean = F.replace(col, F.lit("\x01"), F.lit("\x02"))
    marked = F.regexp_replace(clean, rx(pattern), "\x01$0")
    starts = F.transform(
        F.split(marked, "\n", -1),
        lambda text, i: F.array_repeat(i + 1, F.length(text) - F.length(F.replace(text, F.lit("\x01"), F.lit("")))),
    )
    zipped = F.arrays_zip(F.flatten(starts), find_all(clean, pattern, 0))
    kind = "array<struct<line:int,match:string>>"
    return F.when(has(col, pattern), zipped.cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))


def explode_kept(df, array_col: str, alias: str):
    """Explode an array, evaluating its (expensive) expression once.

    A plain explode lets the optimizer infer a size filter below it that repeats
    the extraction; the outer form plus a null test does not.
    """
    return df.withColumn(alias, F.explode_outer(array_col)).where(F.col(alias).isNotNull())

"""Reports on disk: one folder of JSON rows per snapshot, read back strictly."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_FILES = "array<struct<path:string,role:string,importance_score:int>>"
STEPS = "array<struct<description:string,command:string>>"
# the eight sections of a report; each may be null
SECTION_TYPES = {
    "architecture": (
        "struct<project_type:string,framework:string,structure_pattern:string,"
        f"key_files:{KEY_FILES},language_breakdown:map<string,double>,total_files:bigint,"
        "total_lines:bigint,entry_point_count:bigint,edge_count:bigint>"
    ),
    "tech_debt": (
        "struct<overall_score:int,grade:string,"
        "dimensions:map<string,struct<score:int,weight:double,detail:string>>,"
        "hotspots:array<struct<path:string,reason:string,score:int>>,recommendations:array<string>>"
    ),
    "onboarding": (
        f"struct<project_summary:string,architecture_overview:string,key_files:{KEY_FILES},"
        f"setup_steps:{STEPS},test_commands:array<string>,"
        "top_contributors:array<struct<name:string,email:string,recent_commits:bigint>>,"
        "gotchas:array<string>,glossary:map<string,string>>"
    ),
    "dependencies": (
        "struct<package_manager:string,total_deps:bigint,direct_deps:bigint,outdated_count:bigint,"
        "vulnerability_count:int,risk_score:int,"
        "deps:array<struct<name:string,current_version:string,license:string,status:string>>>"
    ),
    "conventions": (
        "struct<variables:string,functions:string,classes:string,files:string,indent_style:string,"
        "indent_width:int,quotes:string,semicolons:boolean,import_style:string,error_handling:string,"
        "test_pattern:string,commit_format:string,linter_config:string,consistency_score:int>"
    ),
    "api": "struct<api_type:string,total_routes:bigint,total_commands:bigint,undocumented_routes:bigint>",
    "security": (
        "struct<risk_level:string,secrets_found:bigint,sql_found:bigint,env_files_in_git:array<string>,"
        "exposed_ports:array<bigint>,auth_pattern:string,recommendations:array<string>>"
    ),
    "setup": (
        "struct<prerequisites:array<struct<name:string,version:string,install_url:string>>,"
        f"install_steps:{STEPS},database_setup:struct<description:string,command:string>,"
        "build_command:string,run_commands:array<struct<label:string,command:string>>,"
        "test_command:string,common_issues:array<struct<description:string,solution:string>>>"
    ),
}
COLUMNS = {"repo": "string", "head_commit": "bigint", "generated_at": "timestamp", **SECTION_TYPES}
REPORT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


REPORTS, ITEMS = "reports", "items"


def write_snapshot(
    report: DataFrame, folder: str, snapshot_id: str, generated_at: datetime, items: DataFrame | None = None
) -> None:
    """Write reports, and the rows of their lists without a bound, under one snapshot id."""
    rows = report.withColumn("generated_at", F.lit(generated_at)).select(*COLUMNS)
    rows.write.option("ignoreNullFields", "false").json(f"{folder}/{REPORTS}/snapshot_id={snapshot_id}")
    if items is not None:
        items.write.parquet(f"{folder}/{ITEMS}/snapshot_id={snapshot_id}")


def strange_fields(value: Column, kind: T.DataType) -> Column:
    """Names, at any depth of a JSON text, that its type does not have."""
    nothing = F.expr("cast(array() as array<string>)")
    if isinstance(kind, T.StructType):
        names = F.array(*(F.lit(f.name) for f in kind))
        found = [F.coalesce(F.array_except(F.json_object_keys(value), names), nothing)]
        nested = (f for f in kind if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType))
        return F.concat(*found, *(strange_fields(F.get_json_object(value, f"$.{f.name}"), f.dataType) for f in nested))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        elements = F.from_json(value, "array<string>")
        return F.coalesce(F.flatten(F.transform(elements, lambda x: strange_fields(x, kind.elementType))), nothing)
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
        values = F.map_values(F.from_json(value, "map<string,string>"))
        return F.coalesce(F.flatten(F.transform(values, lambda x: strange_fields(x, kind.valueType))), nothing)
    return nothing


def places(folder: str, part: str, ids: Iterable[str] | None) -> list[str]:
    """The folders of the named snapshots, or the one of all."""
    return [f"{folder}/{part}"] if ids is None else [f"{folder}/{part}/snapshot_id={i}" for i in sorted(set(ids))]


def read_snapshots(spark: SparkSession, folder: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Reports of all snapshots below a folder, or of the named ones only, of which nothing else is listed or read.

    Unknown fields at any level and malformed rows are errors.
    """
    kind = T.StructType.fromDDL(REPORT_SCHEMA)
    reports = places(folder, REPORTS, ids)
    strange = spark.read.text(reports).select(F.explode(strange_fields(F.col("value"), kind)).alias("name")).take(1)
    if strange:
        raise ValueError(f"unknown report field: {strange[0].name}")
    reader = spark.read.schema(f"{REPORT_SCHEMA}, snapshot_id string").option("basePath", f"{folder}/{REPORTS}")
    return reader.option("mode", "FAILFAST").json(reports)


ITEM_SCHEMA = "repo string, section string, list string, item string, snapshot_id string"


def read_items(spark: SparkSession, folder: str, name: str, fields: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Elements of one list of all or the named snapshots: snapshot_id, repo and the given fields."""
    reader = spark.read.schema(ITEM_SCHEMA).option("basePath", f"{folder}/{ITEMS}")
    rows = reader.parquet(*places(folder, ITEMS, ids)).where(F.col("list") == name)
    return rows.select("snapshot_id", "repo", F.from_json("item", fields).alias("i")).select("snapshot_id", "repo", "i.*")

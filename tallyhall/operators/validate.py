"""Validators of raw JSON records: structure, types, times, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhall.functions import dates as D

STATES = ["open", "closed", "merged"]
# JSON types by the names that a schema uses.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID; null if the field is missing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def change_errors(json: Column) -> Column:
    """What is wrong with a change's record (DQ2)."""
    v = F.try_parse_json(json)
    number, created, state = field(v, "number"), field(v, "created_at"), field(v, "state")
    text = lambda x: F.try_variant_get(x, "$", "string")
    found = [F.when(field(v, n).isNull(), F.lit(f"Missing required field: {n}")) for n in ("number", "author", "created_at", "state")]
    found.append(F.when(number.isNotNull() & ~kind(number).isin("BIGINT", "BOOLEAN"), F.lit("Field 'number' must be integer")))
    found.append(F.when(created.isNotNull() & D.parse(text(created)).isNull(), F.lit("Field 'created_at' must be valid ISO timestamp")))
    found.append(F.when(state.isNotNull() & ~F.coalesce(text(state).isin(STATES), F.lit(False)), F.lit(f"Field 'state' must be one of {', '.join(STATES)}")))
    found += [F.when(field(v, n).isNotNull() & (kind(field(v, n)) != "ARRAY"), F.lit(f"Field '{n}' must be a list")) for n in ("reviews", "comments")]
    return F.array_compact(F.array(*found))


def schema_error(json: Column, required: list[str], properties: dict[str, str]) -> Column:
    """The first way in which a record breaks a small schema, null if it keeps it (DQ5)."""
    v = F.try_parse_json(json)
    out = F.lit(None).cast("string")
    checks = [(field(v, n).isNull(), f"Missing required field: {n}") for n in required]
    checks += [(field(v, n).isNotNull() & ~kind(field(v, n)).isin(TYPES[t]), f"Field '{n}' type mismatch: expected {t}") for n, t in properties.items()]
    for bad, says in reversed(checks):
        out = F.when(bad, F.lit(says)).otherwise(out)
    return out


def members(df: DataFrame, json: str, key: str, value: str) -> DataFrame:
    """One row for each member of an object; rows that are no objects have none."""
    listed = F.from_json(F.when(kind(F.try_parse_json(json)) == "OBJECT", F.col(json)), "map<string,variant>")
    return df.select("*", F.explode(listed).alias(key, value))


def mapping_errors(df: DataFrame, json: str = "json") -> DataFrame:
    """Rows and an error for each fault of identity mappings: person -> platform -> list of ids (DQ3)."""
    keep = [c for c in df.columns if c != json]
    no_dict = df.filter(kind(F.try_parse_json(json)) != "OBJECT").select(*keep, F.lit("Identity mapping must be a dictionary").alias("error"))
    people = members(df, json, "_person", "_platforms")
    no_platforms = people.filter(kind(F.col("_platforms")) != "OBJECT").select(*keep, F.concat(F.lit("Platforms for "), "_person", F.lit(" must be a dictionary")).alias("error"))
    ids = members(people.select(*keep, F.to_json("_platforms").alias("_j")), "_j", "_platform", "_ids")
    no_list = ids.filter(kind(F.col("_ids")) != "ARRAY").select(*keep, F.concat(F.lit("IDs for "), "_platform", F.lit(" must be a list")).alias("error"))
    lists = ids.filter(kind(F.col("_ids")) == "ARRAY")
    odd = F.exists(F.col("_ids").cast("array<variant>"), lambda x: kind(x) != "STRING")
    no_text = lists.filter(odd).select(*keep, F.concat(F.lit("All IDs for "), "_platform", F.lit(" must be strings")).alias("error"))
    return no_dict.unionByName(no_platforms).unionByName(no_list).unionByName(no_text)


def timeline_errors(df: DataFrame, json: str = "json", top: str = "maintainer_timeline") -> DataFrame:
    """Rows and an error for each fault of tenure records: person -> start and periods (DQ4)."""
    keep = [c for c in df.columns if c != json]
    v = field(F.try_parse_json(json), top)
    no_top = df.filter(v.isNull()).select(*keep, F.lit(f"Missing '{top}' key").alias("error"))
    people = members(df.select(*keep, F.to_json(v).alias("_j")), "_j", "_person", "_data")
    no_start = people.filter(field(F.col("_data"), "estimated_start").isNull()).select(*keep, F.concat(F.lit("Missing 'estimated_start' for "), "_person").alias("error"))
    periods = field(F.col("_data"), "periods")
    no_list = people.filter(periods.isNotNull() & (kind(periods) != "ARRAY")).select(*keep, F.concat(F.lit("'periods' must be a list for "), "_person").alias("error"))
    each = people.filter(kind(periods) == "ARRAY").select(*keep, "_person", F.explode(periods.cast("array<variant>")).alias("_p"))
    start = field(F.col("_p"), "start")
    none = each.filter(start.isNull()).select(*keep, F.concat(F.lit("Period missing 'start' for "), "_person").alias("error"))
    bad = each.filter(start.isNotNull() & D.parse(F.try_variant_get(start, "$", "string")).isNull()).select(*keep, F.concat(F.lit("Invalid 'start' timestamp for "), "_person").alias("error"))
    return no_top.unionByName(no_start).unionByName(no_list).unionByName(none).unionByName(bad)


def integrity(checks: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """``check, found``: how many rows each named check finds; ``only`` picks checks (DQ18)."""
    out = None
    for name, rows in checks.items():
        if only is None or name in only:
            one = rows.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found")
            out = one if out is None else out.unionByName(one)
    return out

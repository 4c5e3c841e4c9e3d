"""Validation: every rule is a Column that is null where a record passes and an error where not.

``validate`` adds one array of errors to each record; nothing is raised unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vantloom.functions.binding import let

# Anchored patterns.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^(https?|ftp)://[^\s/$.?#].[^\s]*$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}(.\d+)?$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(.\d+)?(Z|[+-]\d{2}:\d{2})?$",
    "ipv4": r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$",
    "ipv6": r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}


def matches(c: Column, pattern: str) -> Column:
    """A named pattern, or a regular expression found anywhere."""
    if pattern == "ip":
        return matches(c, "ipv4") | matches(c, "ipv6")
    found = c.rlike(PATTERNS.get(pattern, pattern))
    if pattern == "ipv4":
        return found & F.forall(F.split(c, r"\."), lambda p: p.try_cast("int") <= 255)
    return found


def error(name: str, rule: str, message: str) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.lit(message).alias("message"))


@dataclass(frozen=True)
class Rule:
    """A check of one field; ``fails`` is where it does not hold. Null fields pass but for not_null."""

    field: str
    kind: str
    args: dict[str, Any] = field(default_factory=dict)

    def fails(self, df: DataFrame) -> Column:
        if self.field not in df.columns:
            return F.lit(self.kind == "not_null")
        c, kind, a = F.col(self.field), dict(df.dtypes)[self.field], self.args
        none = F.lit(False)
        low, high = a.get("min"), a.get("max")
        outside = lambda x: (none if low is None else (x <= low if a.get("open") else x < low)) | (none if high is None else (x >= high if a.get("open") else x > high))
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "type":
            known = {"numeric": numeric, "text": kind == "string", "boolean": kind == "boolean", "datetime": kind in ("timestamp", "date"), "array": kind.startswith("array")}
            if a.get("parse"):  # text that must read as the type
                return c.isNotNull() & c.cast("string").try_cast({"numeric": "double", "datetime": "timestamp", "boolean": "boolean"}[a["type"]]).isNull()
            return c.isNotNull() & F.lit(not known[a["type"]]) | (c.isNull() & F.lit(not a.get("allow_null", True)))
        checks = {
            "range": lambda: outside(c) if numeric else none,
            "byte_length": lambda: outside(F.octet_length(c)) if kind == "string" else none,
            "length": lambda: outside(F.length(c)) if kind == "string" else none,
            "size": lambda: outside(F.size(c)) if kind.startswith("array") else none,
            "pattern": lambda: ~matches(c, a["pattern"]),
            "substring": lambda: ~F.contains(c, F.lit(a["text"])),
            "enum": lambda: ~c.isin(list(a["values"])),
            "expression": lambda: ~F.expr(a["sql"]),
        }
        return c.isNotNull() & F.coalesce(checks[self.kind](), none)

    def message(self) -> str:
        return f"{self.kind} {', '.join(f'{k}={v}' for k, v in sorted(self.args.items()))}".strip()


def validate(df: DataFrame, rules: list[Rule], stop_on_first: bool = False) -> DataFrame:
    """``df`` with errors array<struct<field, rule, message>>, in the order of the rules."""
    found = F.array_compact(F.array(*(F.when(r.fails(df), error(r.field, r.kind, r.message())) for r in rules)))
    return df.withColumn("errors", F.slice(found, 1, 1) if stop_on_first else found)


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def error_report(df: DataFrame, rules: list[Rule], limit: int | None = None) -> DataFrame:
    """(field, rule, n): a count for each rule that fails anywhere."""
    found = validate(df, rules).select(F.explode("errors").alias("e")).groupBy("e.field", "e.rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field", "rule")
    return found if limit is None else found.limit(limit)


def require_valid(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` unchanged; evaluating a record that breaks a rule raises an error."""
    checked = validate(df, rules)
    return checked.filter(F.when(F.size("errors") > 0, F.raise_error(F.to_json("errors")).cast("boolean")).otherwise(True)).drop("errors")


def duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records after the first of each key, with the first's order value; null equals null, unknown keys are left out.

    The first of a key comes from a pre-aggregated minimum, so a crowded key is never one window.
    """
    keys = [k for k in keys if k in df.columns]
    first = df.groupBy(*keys).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    first = first.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(first, same).filter(F.col(order) > F.col("first_seen")).drop(*(f"_key_{k}" for k in keys))


def dense_columns(df: DataFrame, most_null: float) -> DataFrame:
    """``df`` without the columns whose share of nulls exceeds ``most_null``."""
    row = df.agg(*((F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if row[c] is None or row[c] <= most_null))


def rules_of(schema: StructType, limits: dict[str, dict[str, Any]] | None = None) -> list[Rule]:
    """Rules that a declared schema implies: not-null fields, and the limits named for fields."""
    out = [Rule(f.name, "not_null") for f in schema if not f.nullable]
    for name, found in (limits or {}).items():
        if "min" in found or "max" in found:
            out.append(Rule(name, "range", {k: found[k] for k in ("min", "max") if k in found}))
        if "min_length" in found or "max_length" in found:
            out.append(Rule(name, "byte_length", {k.removesuffix("_length"): found[k] for k in ("min_length", "max_length") if k in found}))
        if "pattern" in found:
            out.append(Rule(name, "pattern", {"pattern": found["pattern"]}))
        if "allowed" in found:
            out.append(Rule(name, "enum", {"values": found["allowed"]}))
    return out


def feature_quality(v: Column) -> Column:
    """Struct over a feature array: share of zeros, of nulls or non-finite entries, and mean over deviation."""
    n = F.size(v)
    zero = F.size(F.filter(v, lambda x: x == 0)) / n
    odd = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) / n
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(let(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))) / n)
    return F.struct(zero.alias("sparsity"), odd.alias("invalid"), F.when(std > 0, F.abs(mean) / std).alias("signal_to_noise"))


def first_repeat_window(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``repeat``: whether an earlier record has the key. For keys without crowding."""
    return df.withColumn("repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)

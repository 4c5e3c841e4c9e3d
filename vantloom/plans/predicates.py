"""Metadata predicates compiled to Columns that are never null.

Metadata is a JSON object in a string column. A field is compared by its JSON kind: strings,
integers, floats, booleans and null never equal one another, but integers and floats compare as
numbers, within 1e-6 for equality. A missing field satisfies only NotExists, Ne, NotIn and
NotContains. Kinds are read from the raw token, so 5 and "5" stay apart.

Three string dialects compile to the same kind of Column: ``field op value``, ``type:value``
for one column, and connector parameters.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


@dataclass(frozen=True)
class Property:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Composite:
    logic: str  # and, or, not
    conditions: tuple


def from_json(spec: dict) -> Property | Composite:
    """A condition from its JSON form."""
    if "logic" in spec:
        return Composite(spec["logic"].lower(), tuple(from_json(c) for c in spec["conditions"]))
    return Property(spec["field"], spec["operator"].lower(), spec.get("value"))


class _Field:
    """One metadata field, seen as each JSON kind."""

    def __init__(self, metadata: Column, name: str):
        keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
        self.present = F.array_contains(keys, name)
        variant = F.try_parse_json(metadata)
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        self.kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(variant, path, "variant")), r"^[A-Z]+", 0)
        text = F.try_variant_get(variant, path, "string")
        self.text = text
        self.is_text = self.kind == "STRING"
        self.is_number = self.kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        self.number = F.try_variant_get(variant, path, "double")
        self.is_bool = self.kind == "BOOLEAN"
        self.flag = F.try_variant_get(variant, path, "boolean")
        self.is_null = self.kind == "VOID"
        self.is_array = self.kind == "ARRAY"
        self.items = F.try_variant_get(variant, path, "array<variant>")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "text" if isinstance(value, str) else "list"


def _equal(f: _Field, value: Any) -> Column:
    kind = _kind(value)
    if kind == "text":
        return _sure(f.is_text & (f.text == value))
    if kind == "number":
        return _sure(f.is_number & (F.abs(f.number - float(value)) < EPS))
    if kind == "bool":
        return _sure(f.is_bool & (f.flag == value))
    return F.lit(False)  # null equals nothing, not even null


def _compare(f: _Field, op: str, value: Any) -> Column:
    """Ordering; null is below everything and equal to null, other kinds don't compare."""
    apply = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}[op]
    kind = _kind(value)
    if kind == "null":
        return _sure(F.when(f.is_null, F.lit(op in ("ge", "le"))).otherwise(F.lit(op in ("gt", "ge")) & f.present))
    own, fits = {"text": (f.text, f.is_text), "number": (f.number, f.is_number), "bool": (f.flag, f.is_bool)}.get(kind, (None, None))
    if own is None:
        return F.lit(False)
    return _sure(F.when(f.is_null, F.lit(op in ("lt", "le"))).otherwise(fits & apply(own, F.lit(value))))


def _element_equals(item: Column, value: Any) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(item), r"^[A-Z]+", 0)
    if _kind(value) == "text":
        return (kind == "STRING") & (F.try_variant_get(item, "$", "string") == value)
    if isinstance(value, float):
        return kind.isin("DECIMAL", "DOUBLE", "FLOAT", "BIGINT") & (F.abs(F.try_variant_get(item, "$", "double") - value) < EPS)
    # An integer is looked for among integers only.
    return (kind == "BIGINT") & (F.try_variant_get(item, "$", "bigint") == value)


def _contains(f: _Field, value: Any) -> Column:
    inside = F.exists(f.items, lambda x: _sure(_element_equals(x, value))) if _kind(value) in ("text", "number") else F.lit(False)
    substring = f.is_text & F.contains(f.text, F.lit(value)) if _kind(value) == "text" else F.lit(False)
    return _sure(F.when(f.is_array, inside).otherwise(substring))


def _property(metadata: Column, p: Property, regex: bool) -> Column:
    f, v = _Field(metadata, p.field), p.value
    negative = {"ne": "eq", "not_contains": "contains", "not_in": "in"}
    if p.op == "exists":
        return _sure(f.present)
    if p.op == "not_exists":
        return ~_sure(f.present)
    if p.op in negative:
        return ~_property(metadata, Property(p.field, negative[p.op], v), regex)
    if p.op == "eq":
        found = _equal(f, v)
    elif p.op in ("gt", "ge", "lt", "le"):
        found = _compare(f, p.op, v)
    elif p.op == "contains":
        found = _contains(f, v)
    elif p.op in ("starts_with", "ends_with"):
        fn = F.startswith if p.op == "starts_with" else F.endswith
        found = _sure(f.is_text & fn(f.text, F.lit(v))) if isinstance(v, str) else F.lit(False)
    elif p.op == "in_range":
        found = _compare(f, "ge", v[0]) & _compare(f, "le", v[1])
    elif p.op == "in":
        found = F.lit(False)
        for x in v:
            found = found | _equal(f, x)
    elif p.op == "regex":
        found = _sure(f.is_text & (f.text.rlike(v) if regex else F.contains(f.text, F.lit(v))))
    else:
        raise ValueError(f"unknown operator {p.op}")
    return _sure(f.present) & found


def compile_condition(metadata: Column, condition: Property | Composite, regex: bool = True) -> Column:
    """Boolean Column without nulls; ``regex`` false makes Regex a substring test."""
    if isinstance(condition, Property):
        return _property(metadata, condition, regex)
    parts = [compile_condition(metadata, c, regex) for c in condition.conditions]
    out = F.lit(condition.logic != "or")
    for c in parts:
        out = (out | c) if condition.logic == "or" else (out & ~c if condition.logic == "not" else out & c)
    return out


# -- field op value ------------------------------------------------------------------------

_EXPRESSION = re.compile(r"^\s*(\S+?)\s*(==|!=|<>|>=|<=|=|>|<|\bcontains\b|\bregex\b)\s*(.*?)\s*$", re.S)


def parse_expression(columns: dict[str, str], text: str) -> Column:
    """``field op value`` joined by AND and OR (AND binds tighter), over real columns.

    The value is JSON if it parses as such, else a string. Numbers compare with numbers and
    strings with strings; a null or missing field satisfies only ``!=``.
    """
    out = None
    for either in re.split(r"\s+(?:OR|or|\|\|)\s+", text):
        part = F.lit(True)
        for each in re.split(r"\s+(?:AND|and|&&)\s+", either):
            part = part & _comparison(columns, each)
        out = part if out is None else out | part
    return out


def _comparison(columns: dict[str, str], text: str) -> Column:
    m = _EXPRESSION.match(text)
    if not m:
        raise ValueError(f"cannot read the condition {text!r}")
    name, op, raw = m.groups()
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw.strip("'")
    negated = op in ("!=", "<>")
    if name not in columns:
        return F.lit(negated)
    column, numeric = F.col(name), columns[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or columns[name].startswith("decimal")
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if op in ("contains", "regex"):
        return _sure(F.contains(column, F.lit(str(value))) if op == "contains" else column.rlike(str(value))) if columns[name] == "string" else F.lit(False)
    same_kind = is_number == numeric if columns[name] != "boolean" else isinstance(value, bool)
    if op in ("=", "==", "!=", "<>"):
        equal = _sure(column == F.lit(value)) if same_kind and value is not None else F.lit(False)
        return ~equal if negated else equal
    if not same_kind or isinstance(value, bool):
        return F.lit(False)
    return _sure({">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[op])


# -- type:value ----------------------------------------------------------------------------


def parse_column_filter(column: str, spec: str) -> Column:
    """``type:value`` over one string column; "", null and NULL are null. Numbers must parse."""
    kind, _, value = spec.partition(":")
    x = F.col(column).cast("string")
    null = x.isNull() | x.isin("", "null", "NULL")
    number = F.when(~null, x.cast("double"))
    ordered = {"gt": lambda v: number > v, "lt": lambda v: number < v, "gte": lambda v: number >= v, "lte": lambda v: number <= v}
    if kind in ordered:
        return _sure(ordered[kind](float(value)))
    if kind in ("range", "not_range"):
        low, high = (float(p) for p in value.split(","))
        inside = _sure(number.between(low, high))
        return inside if kind == "range" else ~inside
    plain = {
        "eq": lambda: _sure(x == value),
        "ne": lambda: ~_sure(x == value),
        "contains": lambda: _sure(F.contains(x, F.lit(value))),
        "not_contains": lambda: ~_sure(F.contains(x, F.lit(value))),
        "starts_with": lambda: _sure(F.startswith(x, F.lit(value))),
        "ends_with": lambda: _sure(F.endswith(x, F.lit(value))),
        "regex": lambda: _sure(x.rlike(value)),
        "is_null": lambda: null,
        "is_not_null": lambda: ~null,
    }
    if kind not in plain:
        raise ValueError(f"unknown filter {kind}")
    return plain[kind]()


# -- connector parameters and declarative filters --------------------------------------------


def connector_condition(column: str, op: str, value: Any = None) -> Column:
    """Filters that query parameters and declarative specifications share; null never matches but for null tests."""
    c = F.col(column)
    table = {
        "equals": lambda: c == value,
        "not_equals": lambda: c != value,
        "greater_than": lambda: c > value,
        "less_than": lambda: c < value,
        "greater_than_or_equal": lambda: c >= value,
        "less_than_or_equal": lambda: c <= value,
        "contains": lambda: F.contains(c, F.lit(value)),
        "not_contains": lambda: ~F.contains(c, F.lit(value)),
        "starts_with": lambda: F.startswith(c, F.lit(value)),
        "ends_with": lambda: F.endswith(c, F.lit(value)),
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~c.isin(list(value)),
        "between": lambda: c.between(value[0], value[1]),
        "like": lambda: c.like(value),
        "is_null": lambda: c.isNull(),
        "is_not_null": lambda: c.isNotNull(),
    }
    return _sure(table[op]())


@dataclass(frozen=True)
class QueryParams:
    """Filters, order and window of rows, as a connector takes them."""

    filters: tuple[tuple[str, str, Any], ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    limit: int | None = None
    offset: int = 0

    def apply(self, df):
        for column, op, value in self.filters:
            df = df.filter(connector_condition(column, op, value))
        if self.sort:
            df = df.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in self.sort))
        if self.offset:
            df = df.offset(self.offset)
        return df if self.limit is None else df.limit(self.limit)

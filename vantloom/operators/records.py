"""Record operators: conversion, imputation, normalisation, encoders, declarative transforms.

Whole-table statistics come in as scalar subqueries: one aggregate over the columns needed, no
join and no driver round trip. Category tables are joined, and broadcast only when small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vantloom.functions import scalars
from vantloom.functions.binding import let
from vantloom.operators import aggregates, text

Stage = Callable[[DataFrame], DataFrame]
#: Category tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def pipeline(*stages: Stage) -> Stage:
    """Stages one after the other, as one lazy plan."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run


def convert_types(targets: dict[str, str], strict: bool = True) -> Stage:
    def run(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.withColumns({c: scalars.convert(F.col(c), kinds[c], t, strict) for c, t in targets.items() if c in kinds})

    return run


def impute(column: str, strategy: str, value=None) -> Stage:
    """drop, constant, mean, median or mode; ties of the mode go to the smallest value."""

    def run(df: DataFrame) -> DataFrame:
        c, kind = F.col(column), dict(df.dtypes)[column]
        if strategy == "drop":
            return df.filter(c.isNotNull())
        if strategy == "constant":
            fill = F.lit(value)
        elif strategy == "mode":
            fill = _mode(df, column).scalar()
        else:
            fill = df.agg(F.avg(c) if strategy == "mean" else F.percentile(c, F.lit(0.5))).scalar()
        return df.withColumn(column, F.coalesce(c, fill.cast(kind)))

    return run


def _mode(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    return counts.groupBy("count").agg(F.min(column).alias("v")).agg(F.max_by("v", "count"))


def normalize(column: str, method: str, low: float = 0.0, high: float = 1.0) -> Stage:
    """minmax (a constant column goes to the middle), zscore (population; no variance gives 0) or maxabs."""

    def run(df: DataFrame) -> DataFrame:
        c = F.col(column).cast("double")
        if method == "minmax":
            s = df.agg(F.struct(F.min(c).alias("a"), F.max(c).alias("b"))).scalar()
            out = F.when(s["a"] == s["b"], (low + high) / 2).otherwise((c - s["a"]) / (s["b"] - s["a"]) * (high - low) + low)
        elif method == "zscore":
            s = df.agg(F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b"))).scalar()
            out = F.when(s["b"] == 0, 0.0).otherwise((c - s["a"]) / s["b"])
        else:
            s = df.agg(F.max(F.abs(c))).scalar()
            out = F.when(s == 0, 0.0).otherwise(c / s)
        return df.withColumn(column, F.when(c.isNotNull(), out))

    return run


def normalize_text_column(column: str, method: str) -> Stage:
    """zscore, minmax, unit (by the column's length) or percentile, of a string column.

    Text that is no number stays as it is; a zero denominator gives 0.
    """

    def run(df: DataFrame) -> DataFrame:
        x = F.col(column).try_cast("double")
        if method == "percentile":
            at = aggregates.order_statistics(df.select(x.alias("x")), "x", {"a": 0.25, "b": 0.75})
            shift, scale = F.lit(at["a"]), F.lit(at["b"]) - F.lit(at["a"])
        else:
            stats = {
                "zscore": F.struct(F.avg(x).alias("a"), F.sqrt(F.avg(x * x) - F.avg(x) * F.avg(x)).alias("b")),
                "minmax": F.struct(F.min(x).alias("a"), (F.max(x) - F.min(x)).alias("b")),
                "unit": F.struct(F.lit(0.0).alias("a"), F.sqrt(F.sum(x * x)).alias("b")),
            }[method]
            s = df.agg(stats).scalar()
            shift, scale = s["a"], s["b"]
        out = F.when(scale == 0, 0.0).otherwise((x - shift) / scale)
        return df.withColumn(column, F.when(x.isNull(), F.col(column)).otherwise(out.cast("string")))

    return run


def transform_field(column: str, kind: str, *args) -> Stage:
    table = scalars.TEXT | scalars.NUMBER | scalars.TIME
    return lambda df: df.withColumn(column, table[kind](F.col(column), *args))


@dataclass
class RecordTransformer:
    """Chains of each field in order, then whole-record stages, then renames; missing output fields are an error."""

    fields: dict[str, list[Callable[[Column], Column]]] = field(default_factory=dict)
    stages: list[Stage] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        for name, chain in self.fields.items():
            c = F.col(name)
            for fn in chain:
                c = fn(c)
            df = df.withColumn(name, c)
        df = pipeline(*self.stages)(df).withColumnsRenamed(self.renames)
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"the output lacks {missing}")
        return df


def computed_fields(specs: dict[str, str]) -> Stage:
    """New fields from ``len(f)`` (bytes, or elements of an array), ``upper(f)``, ``lower(f)`` or a plain copy."""

    def one(df: DataFrame, spec: str) -> Column:
        name, _, rest = spec.partition("(")
        if not rest:
            return F.col(spec)
        of = rest.rstrip(")")
        if name == "len":
            return F.size(of) if dict(df.dtypes)[of].startswith("array") else F.octet_length(of)
        return {"upper": F.upper, "lower": F.lower}[name](F.col(of))

    return lambda df: df.withColumns({out: one(df, spec) for out, spec in specs.items()})


def default_nulls(df: DataFrame) -> DataFrame:
    """Nulls by the name: counts 0, rates 0.0, flags false, other text (also empty text) unknown."""
    # Parts of names, and what stands in for null.
    kinds, out = dict(df.dtypes), {}
    for c, kind in kinds.items():
        if any(p in c for p in ("age", "count", "num")) and kind in ("int", "bigint"):
            out[c] = F.coalesce(F.col(c), F.lit(0).cast(kind))
        elif any(p in c for p in ("rate", "score", "price")) and kind == "double":
            out[c] = F.coalesce(F.col(c), F.lit(0.0))
        elif any(p in c for p in ("flag", "is_", "has_")) and kind == "boolean":
            out[c] = F.coalesce(F.col(c), F.lit(False))
        elif kind == "string":
            out[c] = F.when(F.col(c).isNull() | (F.col(c) == ""), "未知").otherwise(F.col(c))
    return df.withColumns(out) if out else df


def fixed_normalize(df: DataFrame) -> DataFrame:
    """Floats (x - 0.5) / 0.5, integers (x - 50) / 50."""
    out = {c: (F.col(c) - 0.5) / 0.5 if k in ("float", "double") else (F.col(c) - 50) / 50 for c, k in df.dtypes if k in ("float", "double", "int", "bigint")}
    return df.withColumns(out) if out else df


def clean_records(df: DataFrame) -> DataFrame:
    return df.withColumns({c: scalars.clean_text(F.col(c)) if k == "string" else F.transform(c, scalars.clean_text) for c, k in df.dtypes if k in ("string", "array<string>")})


def project_to(schema: StructType | list[str]) -> Stage:
    """The schema's columns in order; missing ones are empty text."""
    names = schema.fieldNames() if isinstance(schema, StructType) else schema
    return lambda df: df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in names))


# -- Encoders -------------------------------------------------------------------------------


def categories(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n): codes from 0 in the order of the values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.with_rank(counts, [F.col("value")]).select("value", "n", F.col("_rank").cast("int").alias("code"))


def _with_categories(df: DataFrame, column: str, limit: int | None) -> tuple[DataFrame, int]:
    found = categories(df, column)
    size = found.count()
    if limit is not None and size > limit:
        raise ValueError(f"{column} has {size} categories; the limit is {limit}")
    small = F.broadcast(found) if size <= BROADCAST_ROWS else found
    return df.join(small, F.col(column) == F.col("value"), "left").drop("value"), size


def label_encode(column: str, limit: int | None = None) -> Stage:
    """Category number; unknown and null get the number of categories."""

    def run(df: DataFrame) -> DataFrame:
        joined, size = _with_categories(df, column, limit)
        return joined.withColumn(f"{column}_label", F.coalesce("code", F.lit(size))).drop("code", "n")

    return run


def one_hot_encode(column: str, limit: int = 1_000) -> Stage:
    def run(df: DataFrame) -> DataFrame:
        joined, size = _with_categories(df, column, limit)
        hot = F.transform(F.sequence(F.lit(0), F.lit(max(0, size - 1))), lambda k: F.coalesce((k == F.col("code")).cast("int"), F.lit(0)))
        return joined.withColumn(f"{column}_one_hot", hot).drop("code", "n")

    return run


def frequency_encode(column: str) -> Stage:
    """Share of the rows; unknown and null get 0."""

    def run(df: DataFrame) -> DataFrame:
        total = df.agg(F.count(F.lit(1))).scalar()
        joined, _ = _with_categories(df, column, None)
        return joined.withColumn(f"{column}_freq", F.coalesce(F.col("n") / total, F.lit(0.0))).drop("code", "n")

    return run


def term_counts(column: str, kind: str = "bow") -> Stage:
    """JSON of a text's lower-case words: counts (bow) or shares (tf), keys in order."""

    def run(df: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
        made = df.withColumn("_terms", text.counted(words))
        counts = F.col("_terms.n") if kind == "bow" else let(F.aggregate("_terms.n", F.lit(0), lambda a, n: a + n), lambda total: F.transform("_terms.n", lambda n: n / total))
        return made.withColumn(f"{column}_{kind}", F.to_json(F.map_from_arrays("_terms.k", counts))).drop("_terms")

    return run


def variance_threshold(columns: list[str], threshold: float) -> Stage:
    """Drops the columns of at most that population variance."""

    def run(df: DataFrame) -> DataFrame:
        row = df.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
        return df.drop(*(c for c in columns if row[c] is None or row[c] <= threshold))

    return run


def augment(factor: float, noise: dict[str, float] | None = None, seed: int = 42) -> Stage:
    """Original rows and a sample of copies up to the factor, the named columns shaken by up to that share."""

    def run(df: DataFrame) -> DataFrame:
        extra = df.sample(withReplacement=True, fraction=max(0.0, factor - 1), seed=seed)
        for c, share in (noise or {}).items():
            extra = extra.withColumn(c, F.col(c) + F.abs(c) * (F.rand(seed) * 2 - 1) * share)
        return df.unionByName(extra)

    return run


@dataclass(frozen=True)
class Transformation:
    """One declared step; disabled ones are passed over, the rest run by ``order``."""

    kind: str
    args: dict
    order: int = 0
    enabled: bool = True


def declared(steps: list[Transformation]) -> Stage:
    makers: dict[str, Callable[..., Stage]] = {
        "mapping": lambda names: lambda df: df.withColumnsRenamed(names),
        "conversion": lambda targets, strict=True: convert_types(targets, strict),
        "filter": lambda condition: lambda df: df.filter(condition),
        "aggregation": lambda key, value, how: lambda df: aggregates.group_aggregate(df, key, value, how),
        "normalization": lambda column, method: normalize(column, method),
        "feature": lambda exprs: lambda df: df.withColumns({k: F.expr(v) for k, v in exprs.items()}),
        "select": lambda columns: lambda df: df.select(*columns),
        "custom": lambda fn: fn,
    }
    return pipeline(*(makers[s.kind](**s.args) for s in sorted(steps, key=lambda s: s.order) if s.enabled))


def text_to_float(column: str, kind: str) -> Column:
    """Numbers, booleans or timestamps in text as floats; what does not parse is null."""
    c = F.col(column)
    return {"numeric": c.try_cast("float"), "boolean": scalars.convert(c, "string", "boolean", strict=False).cast("float"), "datetime": F.unix_timestamp(c.try_cast("timestamp")).cast("float")}[kind]


def mixed_features(df: DataFrame, id_col: str) -> DataFrame:
    """(id, features array<double>): numbers standardised (null counts as the mean), flags as 0 and 1, text by bytes, words and capitals.

    Columns go in the table's order; other types are passed over.
    """
    cells: list[Column] = []
    numeric = [c for c, k in df.dtypes if c != id_col and (k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal"))]
    stats = df.agg(F.struct(*(x for c in numeric for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))).scalar() if numeric else None
    for c, k in df.dtypes:
        if c in numeric:
            m, s = stats[f"m_{c}"], stats[f"s_{c}"]
            cells.append(F.coalesce((F.col(c) - m) / F.when(s == 0, 1.0).otherwise(s), F.lit(0.0)))
        elif k == "boolean":
            cells.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        elif k == "string" and c != id_col:
            text = F.coalesce(c, F.lit(""))
            cells += [F.octet_length(text).cast("double"), F.regexp_count(text, F.lit(r"\S+")).cast("double"), F.regexp_count(text, F.lit("[A-Z]")).cast("double")]
    return df.select(id_col, F.array(*cells).alias("features"))


def filter_by_field(column: str, value) -> Stage:
    """Rows whose field equals the value."""
    return lambda df: df.filter(F.coalesce(F.col(column) == F.lit(value), F.lit(False)))

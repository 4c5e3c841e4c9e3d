"""Aggregation, statistics, deduplication, ordering, splitting, sharding and version diffs."""

from __future__ import annotations

import functools
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vantloom.runtime import shuffle_width

SHARD_ROWS = 10_000


def aggregate(how: str, c: Column, p: float | None = None) -> Column:
    """One of the aggregation functions by name."""
    return {
        "sum": F.sum,
        "average": F.avg,
        "count": F.count,
        "min": F.min,
        "max": F.max,
        "stddev": F.stddev_pop,
        "variance": F.var_pop,
        "median": lambda x: F.percentile(x, F.lit(0.5)),
        "mode": lambda x: F.mode(x, True),
        "percentile": lambda x: F.percentile(x, F.lit(p)),
        "count_distinct": F.count_distinct,
    }[how](c)


def group_aggregate(df: DataFrame, key: str, value: str, how: str, compat: bool = False) -> DataFrame:
    """(key as text, value): rows without the key are left out; only numbers count.

    A group without numbers has average 0 and null extremes; ``compat`` gives infinite extremes.
    """
    x = F.col(value).cast("double")
    out = {"sum": F.coalesce(F.sum(x), F.lit(0.0)), "average": F.coalesce(F.avg(x), F.lit(0.0)), "min": F.min(x), "max": F.max(x), "count": F.count(x).cast("double")}[how]
    if compat and how in ("min", "max"):
        out = F.coalesce(out, F.lit(float("inf") if how == "min" else float("-inf")))
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(out.alias(value))


def first_last(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: count, sum, mean, median, population deviation and variance, min, max."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max"))


def moment_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: skewness and excess kurtosis of the population."""
    return df.agg(F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))


def order_statistics(df: DataFrame, column: str, at: dict[str, float], accuracy: int = 10_000, bound: int = 100_000) -> dict[str, float]:
    """Exact sorted[floor(q * n)] for each named q, without sorting the column.

    Approximate percentiles narrow each rank's bracket, to a ten-thousandth or so a round and all
    brackets in one pass, until ``bound`` rows or one value are left; those are grouped and come back.
    """
    df = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return dict.fromkeys(at)
    # name: lowest and highest value of the bracket, rows below it, rows within it
    box = {name: (lo, hi, 0, n) for name in at}
    rank = {name: min(int(q * n), n - 1) for name, q in at.items()}
    stuck: set[str] = set()
    inside = lambda b: F.col("x").between(b[0], b[1])
    while open_ := [k for k, (a, b, _, m) in box.items() if m > bound and a < b and k not in stuck]:
        ask = []
        for k in open_:
            _, _, below, m = box[k]
            q, margin = (rank[k] - below) / m, 2.0 / accuracy
            ask.append(F.percentile_approx(F.when(inside(box[k]), F.col("x")), [max(0.0, q - margin), min(1.0, q + margin)], accuracy))
        cuts = df.agg(*ask).first()
        counts = df.agg(*(c for a, b in cuts for c in (F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))))).first()
        for j, k in enumerate(open_):
            new = (*cuts[j], counts[2 * j], counts[2 * j + 1])
            if new[2] <= rank[k] < new[2] + new[3] and new[:2] != box[k][:2]:
                box[k] = new
            else:
                stuck.add(k)
    wanted = functools.reduce(lambda a, b: a | b, [inside(b) for b in box.values() if b[0] < b[1]], F.lit(False))
    values = df.filter(wanted).groupBy("x").count().orderBy("x").collect()
    out = {}
    for k, (a, b, below, _) in box.items():
        out[k] = a
        for r in values if a < b else ():
            if a <= r["x"] <= b:
                out[k] = r["x"]
                below += r["count"]
                if below > rank[k]:
                    break
    return out


def numeric_features(df: DataFrame, column: str) -> DataFrame:
    """``numeric_stats`` with range, q1, q3 (sorted[n/4], sorted[3n/4]) and their distance."""
    at = order_statistics(df, column, {"q1": 0.25, "q3": 0.75})
    return numeric_stats(df, column).withColumns({"range": F.col("max") - F.col("min"), "q1": F.lit(at["q1"]), "q3": F.lit(at["q3"]), "iqr": F.lit(at["q3"]) - F.lit(at["q1"])})


def drop_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles; nulls stay."""
    at = order_statistics(df, column, {"q1": 0.25, "q3": 0.75})
    if at["q1"] is None:
        return df
    reach = k * (at["q3"] - at["q1"])
    return df.filter(F.col(column).isNull() | F.col(column).between(at["q1"] - reach, at["q3"] + reach))


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: name, type, count, null_count, completeness in percent. One aggregate pass."""
    cells = [F.struct(F.lit(c).alias("field"), F.lit(k).alias("type"), F.count(F.lit(1)).alias("count"), F.count_if(F.col(c).isNull()).alias("null_count")) for c, k in df.dtypes]
    rows = df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    share = F.when(F.col("count") == 0, 0.0).otherwise((F.col("count") - F.col("null_count")) / F.col("count") * 100)
    return rows.withColumn("completeness", share)


def deduplicate(df: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Distinct records; with keys and an order, the first record of each key."""
    if order is None:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def text_field_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: byte lengths, mean words and sentences, distinct texts."""
    c = F.col(column)
    words = F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+"))
    sentences = F.size(F.filter(F.split(c, "[.?!]"), lambda s: F.trim(s) != ""))
    n = F.octet_length(c)
    return df.agg(F.min(n).alias("min_bytes"), F.max(n).alias("max_bytes"), F.avg(n).alias("avg_bytes"), F.avg(words).alias("avg_words"), F.avg(sentences).alias("avg_sentences"), F.count_distinct(c).alias("distinct_texts"))


def category_stats(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share), commonest first."""
    total = df.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count().withColumn("share", F.col("count") / total).orderBy(F.desc("count"), "value")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one aggregate pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs))
    return df.agg(cells.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def merge(*tables: DataFrame) -> DataFrame:
    """UNION ALL over the union of the columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def split(df: DataFrame, key: str, ratios: list[float], seed: int | None = None) -> list[DataFrame]:
    """Parts of exact sizes floor(ratio * n), the rest to the last; by the key's order or its seeded hash.

    Ranks come from counts of hash or value ranges by partition, not from one sorted task.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    n = df.count()
    ranked = with_rank(df, [F.xxhash64(F.lit(seed), key), F.col(key)] if seed is not None else [F.col(key)])
    ends, at = [], 0
    for r in ratios[:-1]:
        at += int(r * n)
        ends.append(at)
    bounds = [0, *ends, n]
    return [ranked.filter((F.col("_rank") >= a) & (F.col("_rank") < b)).drop("_rank") for a, b in zip(bounds, bounds[1:])]


def with_rank(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with _rank, the row's place from 0 in the whole order.

    Rows are range-partitioned, numbered within each range, and shifted by the ranges before;
    only one count for each range goes through a single task.
    """
    parts = parts or max(64, shuffle_width(df.sparkSession))
    keyed = df.withColumn("_order", F.struct(*(c.alias(f"k{k}") for k, c in enumerate(order))))
    dealt = _ranged(keyed, parts)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    within = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("_order")) - 1)
    return within.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_row") + F.col("_before")).drop("_part", "_order", "_row", "_before")  # one row a range


def _ranged(keyed: DataFrame, parts: int) -> DataFrame:
    """Range numbers from approximate quantiles of the order's first key."""
    first = F.col("_order.k0")
    kind = keyed.select(first.alias("k")).schema["k"].dataType.typeName()
    if kind in ("string", "boolean", "binary"):
        cuts = sorted({r[0] for r in keyed.select(first.alias("k")).filter("k is not null").sample(fraction=min(1.0, 20.0 * parts / max(1, keyed.count())), seed=7).distinct().limit(50 * parts).collect()})
        cuts = cuts[:: max(1, len(cuts) // parts)]
    else:
        cuts = sorted(set(keyed.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 1000)).first()[0] or []))
    if not cuts:
        return keyed.withColumn("_part", F.lit(0))
    bounds = F.array(*(F.lit(c) for c in cuts))
    return keyed.withColumn("_part", F.coalesce(F.size(F.filter(bounds, lambda b: b < first)), F.lit(-1)))


def train_validation(df: DataFrame, key: str, validation: float) -> tuple[DataFrame, DataFrame]:
    """The tail of the key's order is for validation."""
    train, held = split(df, key, [1 - validation, validation])
    return train, held


def shard(df: DataFrame, how: str, column: str, shards: int | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``shard``: random, hash, range (equal-width bins, clamped) or feature (distinct values in order)."""
    count = shards or max(1, ceil(df.count() / SHARD_ROWS))
    c = F.col(column)
    if how == "random":
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), column), F.lit(count)).cast("int"))
    if how == "hash":
        return df.withColumn("shard", F.pmod(F.xxhash64(column), F.lit(count)).cast("int"))
    if how == "range":
        s = df.agg(F.struct(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b"))).scalar()
        width = (s["b"] - s["a"]) / count
        return df.withColumn("shard", F.when(width == 0, 0).otherwise(F.least(F.floor((c - s["a"]) / width), F.lit(count - 1))).cast("int"))
    values = with_rank(df.filter(c.isNotNull()).select(column).distinct(), [c]).withColumn("shard", F.col("_rank").cast("int")).drop("_rank")
    return df.join(values, column, "left")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with ``batch``: the key's order cut into runs of ``size`` rows."""
    return with_rank(df, [F.col(key)]).withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): records added, deleted or modified, and the fields that differ."""
    common = [c for c in old.columns if c in new.columns and c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*(F.col(c) for c in common)).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*(F.col(c) for c in common)).alias("_new"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    fields = F.filter(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in common)), lambda x: x.isNotNull())
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.size(fields) > 0, "modified")
    found = joined.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), F.when(change == "modified", fields).otherwise(F.array().cast("array<string>")).alias("fields"))
    return found.filter("change is not null")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, prefer: str = "ours") -> DataFrame:
    """Records of both sides; where both changed one, the preferred side's stands."""
    changed = diff(base, theirs, key)
    conflict = diff(base, ours, key).select(key)
    taken = changed if prefer == "theirs" else changed.join(conflict, key, "left_anti")
    gone = taken.select(key)
    fresh = theirs.join(taken.filter("change <> 'deleted'").select(key), key, "left_semi")
    return ours.join(gone, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_schemas(schemas: list[StructType], how: str = "relaxed") -> StructType:
    """strict: equal types of all; relaxed: every field, text where types differ; common: each field's most common type."""
    names = list(dict.fromkeys(f.name for s in schemas for f in s))
    out = []
    for n in names:
        kinds = [s[n].dataType for s in schemas if n in s.fieldNames()]
        if how == "strict" and (len(kinds) < len(schemas) or len(set(map(str, kinds))) > 1):
            raise ValueError(f"schemas disagree on {n}")
        simple = [k.simpleString() for k in kinds]
        best = max(sorted(set(simple)), key=simple.count)
        if how == "relaxed" and len(set(simple)) > 1:
            best = "double" if set(simple) <= {"int", "bigint", "float", "double"} else "string"
        nullable = len(kinds) < len(schemas) or any(s[n].nullable for s in schemas if n in s.fieldNames())
        out.append(StructField(n, next((k for k in kinds if k.simpleString() == best), None) or StructType.fromDDL(f"x {best}")["x"].dataType, nullable))
    return StructType(out)


def analyze(df: DataFrame) -> DataFrame:
    """One row about a table: rows, numeric, text and other columns, and the share of null cells."""
    kinds = dict(df.dtypes)
    numeric = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]
    text = [c for c, k in kinds.items() if k == "string"]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.lit(len(numeric)).alias("numeric"), F.lit(len(text)).alias("text"), F.lit(len(kinds) - len(numeric) - len(text)).alias("other"), F.when(n == 0, 0.0).otherwise(nulls / (n * len(kinds))).alias("null_share"))

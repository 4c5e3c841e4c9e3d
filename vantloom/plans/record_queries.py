"""Queries over the star-schema tables: conversion, imputation, normalisation, aggregation, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.functions import scalars
from vantloom.operators import aggregates as A
from vantloom.operators import database
from vantloom.operators import records as R
from vantloom.operators import validation as V
from vantloom.plans.predicates import connector_condition
from vantloom.queries import query
from vantloom.runtime import table


def _t(name: str):
    return lambda spark, sf: table(spark, sf, name)


_orders, _lineitem, _customer, _part, _events = map(_t, ("orders", "lineitem", "customer", "part", "events"))

# -- Records ---------------------------------------------------------------------------------


@query("r1_convert_types", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS as_double, coalesce(TRY_CAST(c_mktsegment AS BIGINT), -1) AS bad, c_nationkey <> 0 AS as_bool, CAST(c_custkey AS VARCHAR) AS as_text FROM customer")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    df = _customer(spark, sf).select("c_custkey", F.col("c_nationkey").alias("as_double"), F.col("c_mktsegment").alias("bad"), F.col("c_nationkey").alias("as_bool"), F.col("c_custkey").alias("as_text"))
    return R.convert_types({"as_double": "double", "bad": "bigint", "as_bool": "boolean", "as_text": "string"}, strict=False)(df).fillna(-1, ["bad"])


_HOLES = "(SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)"


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf).select("l_orderkey", "l_linenumber", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 != 0, F.col("l_quantity")).alias("q"))


def _impute_query(name: str, strategy: str, sql: str, value=None) -> None:
    @query(name, f"SELECT l_orderkey, l_linenumber, {sql} AS q FROM {_HOLES}" + (" WHERE q IS NOT NULL" if strategy == "drop" else ""))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = R.impute("q", strategy, value)(_holes(spark, sf))
        return df.withColumn("q", F.round("q", 6)) if strategy == "mean" else df


_impute_query("r2_impute_drop", "drop", "q")
_impute_query("r2_impute_constant", "constant", "coalesce(q, -1.0)", -1.0)
_impute_query("r2_impute_mean", "mean", f"round(coalesce(q, (SELECT avg(q) FROM {_HOLES})), 6)")
_impute_query("r2_impute_median", "median", f"coalesce(q, (SELECT median(q) FROM {_HOLES}))")
_impute_query("r2_impute_mode", "mode", f"coalesce(q, (SELECT q FROM {_HOLES} WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1))")

_S = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, max(abs(o_totalprice)) AS a FROM orders)"


def _normalize_query(name: str, method: str, sql: str) -> None:
    @query(name, f"SELECT o_orderkey, round({sql}, 6) AS o_totalprice FROM orders, {_S}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return R.normalize("o_totalprice", method)(_orders(spark, sf).select("o_orderkey", "o_totalprice")).withColumn("o_totalprice", F.round("o_totalprice", 6))


_normalize_query("r3_minmax", "minmax", "(o_totalprice - lo) / (hi - lo)")
_normalize_query("r3_zscore", "zscore", "(o_totalprice - m) / s")
_normalize_query("r3_maxabs", "maxabs", "o_totalprice / a")


def _text_normalize_query(name: str, method: str, stats: str, sql: str) -> None:
    @query(name, f"SELECT c_custkey, round({sql}, 6) AS x FROM customer, (SELECT {stats} FROM customer)")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _customer(spark, sf).select("c_custkey", F.col("c_acctbal").cast("string").alias("x"))
        return R.normalize_text_column("x", method)(df).withColumn("x", F.round(F.col("x").cast("double"), 6))


_text_normalize_query("r4_unit_vector", "unit", "sqrt(sum(c_acctbal * c_acctbal)) AS n", "c_acctbal / n")
_text_normalize_query("r4_percentile", "percentile", "list_sort(list(c_acctbal)) AS l, count(*) AS n", "(c_acctbal - l[floor(n * 0.25)::BIGINT + 1]) / (l[floor(n * 0.75)::BIGINT + 1] - l[floor(n * 0.25)::BIGINT + 1])")


@query("r5_field_transforms", "SELECT p_partkey, upper(replace(p_name, 'a', 'x')) AS p_name, round(p_retailprice * 2 + 3, 6) AS p_retailprice FROM part")
def r5(spark: SparkSession, sf: str) -> DataFrame:
    run = R.pipeline(R.transform_field("p_name", "replace", "a", "x"), R.transform_field("p_name", "upper"), R.transform_field("p_retailprice", "multiply", 2), R.transform_field("p_retailprice", "add", 3))
    return run(_part(spark, sf).select("p_partkey", "p_name", "p_retailprice")).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("r6_string_transforms", "SELECT p_partkey, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed, substr(p_name, 3, 2) AS cut FROM part")
def r6(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).select("p_partkey", scalars.TEXT["lower"](F.col("p_brand")).alias("low"), scalars.TEXT["trim"](F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), scalars.substring_bytes(F.col("p_name"), 2, 2).alias("cut"))


@query("r7_number_transforms", "SELECT l_orderkey, l_linenumber, l_extendedprice / 4 AS d, abs(l_tax - 0.05) AS a, floor(l_extendedprice)::DOUBLE AS f, ceil(l_extendedprice)::DOUBLE AS c, round(l_quantity / 2) AS r, round(pow(l_discount, 2), 8) AS p FROM lineitem")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    n, c = scalars.NUMBER, F.col
    return _lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", n["divide"](c("l_extendedprice"), 4).alias("d"), n["abs"](n["subtract"](c("l_tax"), 0.05)).alias("a"), n["floor"](c("l_extendedprice")).alias("f"),
        n["ceil"](c("l_extendedprice")).alias("c"), n["round"](c("l_quantity") / 2).alias("r"), F.round(n["power"](c("l_discount"), 2), 8).alias("p"),
    )


@query(
    "r8_datetime_transforms",
    "SELECT event_id, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS d, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS s, strftime(date_trunc('day', ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS e FROM events",
)
def r8(spark: SparkSession, sf: str) -> DataFrame:
    ts, t, out = F.col("ts"), scalars.TIME, "yyyy-MM-dd HH:mm:ss"
    return _events(spark, sf).select("event_id", *(t["format"](x, out).alias(n) for n, x in (("d", t["add_days"](ts, 3)), ("h", t["add_hours"](ts, -5)), ("s", t["start_of_day"](ts)), ("e", t["end_of_day"](ts)))))


@query("r9_record_transformer", "SELECT c_custkey AS id, upper(trim(c_name)) AS name, round(c_acctbal * 2, 6) AS balance FROM customer WHERE c_acctbal > 0")
def r9(spark: SparkSession, sf: str) -> DataFrame:
    t = R.RecordTransformer(
        fields={"c_name": [F.trim, F.upper], "c_acctbal": [lambda c: c * 2, lambda c: F.round(c, 6)]},
        stages=[lambda df: df.filter("c_acctbal > 0")],
        renames={"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"},
        required=("id", "name"),
    )
    return t.apply(_customer(spark, sf).select("c_custkey", "c_name", "c_acctbal"))


@query("r11_scaled_int", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice * 0.1)::BIGINT AS x FROM lineitem")
def r11(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf).select("l_orderkey", "l_linenumber", scalars.scaled_int(F.col("l_extendedprice"), 0.1).alias("x"))


@query("r12_computed_fields", "SELECT p_partkey, strlen(p_name)::INTEGER AS n, upper(p_type) AS u, lower(p_brand) AS l, p_size AS s FROM part")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    return R.computed_fields({"n": "len(p_name)", "u": "upper(p_type)", "l": "lower(p_brand)", "s": "p_size"})(_part(spark, sf)).select("p_partkey", "n", "u", "l", "s")


@query("r13_default_nulls", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '未知' ELSE c_name END AS title, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END, 0) AS num, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, 0.0) AS price FROM customer")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return R.default_nulls(_customer(spark, sf).select("c_custkey", F.when(k % 3 != 0, F.col("c_name")).otherwise("").alias("title"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("num"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("price")))


@query("r14_fixed_normalize", "SELECT (p_partkey - 50) / 50.0::DOUBLE AS p_partkey, (p_size - 50) / 50.0::DOUBLE AS p_size, (p_retailprice - 0.5) / 0.5::DOUBLE AS p_retailprice FROM part")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    return R.fixed_normalize(_part(spark, sf).select("p_partkey", "p_size", "p_retailprice"))


@query("r15_clean_records", "SELECT doc_id, trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' ') AS text FROM documents")
def r15(spark: SparkSession, sf: str) -> DataFrame:
    return R.clean_records(table(spark, sf, "documents").select("doc_id", "text"))


@query("r16_project_to_schema", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '' AS phone FROM customer")
def r16(spark: SparkSession, sf: str) -> DataFrame:
    return R.project_to(["c_custkey", "c_name", "phone"])(_customer(spark, sf))


@query("r18_term_json", "SELECT p_partkey, '{' || (SELECT string_agg('\"' || w || '\":' || n, ',' ORDER BY w) FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w) GROUP BY w)) || '}' AS bow FROM part")
def r18(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_counts("p_name", "bow")(_part(spark, sf).select("p_partkey", "p_name")).select("p_partkey", F.col("p_name_bow").alias("bow"))


@query("r19_label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer")
def r19_label(spark: SparkSession, sf: str) -> DataFrame:
    return R.label_encode("c_mktsegment")(_customer(spark, sf)).select("c_custkey", F.col("c_mktsegment_label").alias("code"))


@query("r19_one_hot_encode", "WITH s AS (SELECT list_sort(list(DISTINCT c_mktsegment)) AS l FROM customer) SELECT c_custkey, list_transform(l, lambda v: CASE WHEN v = c_mktsegment THEN 1 ELSE 0 END) AS hot FROM customer, s")
def r19_hot(spark: SparkSession, sf: str) -> DataFrame:
    return R.one_hot_encode("c_mktsegment")(_customer(spark, sf)).select("c_custkey", F.col("c_mktsegment_one_hot").alias("hot"))


@query("r19_frequency_encode", "SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment) / (count(*) OVER ())::DOUBLE, 6) AS freq FROM customer")
def r19_freq(spark: SparkSession, sf: str) -> DataFrame:
    return R.frequency_encode("c_mktsegment")(_customer(spark, sf)).select("c_custkey", F.round("c_mktsegment_freq", 6).alias("freq"))


@query("r20_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(abs(c_acctbal) + 1e-8), 6) + 0.0 AS x FROM customer")
def r20(spark: SparkSession, sf: str) -> DataFrame:
    return _customer(spark, sf).select("c_custkey", F.round(scalars.signed_log(F.col("c_acctbal")), 6).alias("x"))


@query("r21_variance_threshold", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem")
def r21(spark: SparkSession, sf: str) -> DataFrame:
    return R.variance_threshold(["l_extendedprice", "l_quantity", "l_discount", "l_tax"], 1.0)(_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))


@query("r22_augment", "SELECT count(*) AS originals, true AS grown, true AS near FROM customer")
def r22(spark: SparkSession, sf: str) -> DataFrame:
    """All rows, and about half as many copies within a tenth of their originals."""
    own = _customer(spark, sf).select("c_custkey", "c_acctbal")
    both = R.augment(1.5, {"c_acctbal": 0.1})(own).join(own.select("c_custkey", F.col("c_acctbal").alias("x")), "c_custkey")
    same, near = F.col("c_acctbal") == F.col("x"), F.abs(F.col("c_acctbal") - F.col("x")) <= 0.1 * F.abs("x") + 1e-9
    counts = both.agg(F.count_if(same).alias("originals"), F.count(F.lit(1)).alias("all"), F.every(near).alias("near"))
    return counts.select("originals", F.col("all").between(1.4 * F.col("originals"), 1.6 * F.col("originals")).alias("grown"), "near")


@query("r23_declared_steps", "SELECT seg, round(avg(bal), 6) AS bal FROM (SELECT c_mktsegment AS seg, c_acctbal * 2 AS bal FROM customer WHERE c_acctbal > 100) GROUP BY seg")
def r23(spark: SparkSession, sf: str) -> DataFrame:
    steps = [
        R.Transformation("aggregation", {"key": "seg", "value": "bal", "how": "average"}, 4),
        R.Transformation("mapping", {"names": {"c_mktsegment": "seg"}}, 1),
        R.Transformation("filter", {"condition": "c_acctbal > 100"}, 2),
        R.Transformation("feature", {"exprs": {"bal": "c_acctbal * 2"}}, 3),
        R.Transformation("filter", {"condition": "false"}, 0, enabled=False),
    ]
    return R.declared(steps)(_customer(spark, sf)).withColumn("bal", F.round("bal", 6))


@query("r25_text_to_float", "SELECT c_custkey, CAST(c_acctbal AS FLOAT)::DOUBLE AS n, 1.0::DOUBLE AS b, epoch(TIMESTAMP '2024-01-02')::DOUBLE AS t FROM customer")
def r25(spark: SparkSession, sf: str) -> DataFrame:
    df = _customer(spark, sf).select("c_custkey", F.col("c_acctbal").cast("string").alias("n"), F.lit("yes").alias("b"), F.lit("2024-01-02").alias("t"))
    return df.select("c_custkey", *(R.text_to_float(c, k).cast("double").alias(c) for c, k in (("n", "numeric"), ("b", "boolean"))), F.unix_timestamp(F.col("t").try_cast("timestamp")).cast("double").alias("t"))


@query("r10_rename_and_prune", "SELECT c_custkey AS id, c_name AS name FROM customer")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    return R.declared([R.Transformation("mapping", {"names": {"c_custkey": "id", "c_name": "name"}}, 1), R.Transformation("select", {"columns": ["id", "name"]}, 2)])(_customer(spark, sf))


# -- Aggregates ------------------------------------------------------------------------------


def _group_query(how: str, sql: str) -> None:
    @query(f"a1_group_{how}", f"SELECT l_returnflag, round({sql}, 2) AS l_extendedprice FROM lineitem GROUP BY l_returnflag")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return A.group_aggregate(_lineitem(spark, sf), "l_returnflag", "l_extendedprice", how).withColumn("l_extendedprice", F.round("l_extendedprice", 2))


for _how, _sql in {"sum": "sum(l_extendedprice)", "average": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "count": "count(l_extendedprice)::DOUBLE"}.items():
    _group_query(_how, _sql)


@query(
    "a2_aggregate_vocabulary",
    """SELECT l_returnflag, l_linestatus, round(stddev_pop(l_quantity), 6) AS stddev, round(var_pop(l_quantity), 6) AS variance, median(l_quantity) AS median,
    round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(DISTINCT l_suppkey) AS suppliers, mode(l_linenumber ORDER BY l_linenumber) AS mode FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a2(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _lineitem(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(A.aggregate("stddev", c("l_quantity")), 6).alias("stddev"), F.round(A.aggregate("variance", c("l_quantity")), 6).alias("variance"), A.aggregate("median", c("l_quantity")).alias("median"),
        F.round(A.aggregate("percentile", c("l_extendedprice"), 0.9), 4).alias("p90"), A.aggregate("count_distinct", c("l_suppkey")).alias("suppliers"), A.aggregate("mode", c("l_linenumber")).alias("mode"),
    )


@query("a2_first_last", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first, max_by(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def a2_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_last(_orders(spark, sf), ["o_custkey"], "o_orderkey", "o_totalprice")


_STATS = "count(x) AS count, round(sum(x), 2) AS sum, round(avg(x), 6) AS mean, median(x) AS median, round(stddev_pop(x), 6) AS std, round(var_pop(x), 4) AS var, min(x) AS min, max(x) AS max"


def _rounded_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6), "std": F.round("std", 6), "var": F.round("var", 4)})


@query("a4_numeric_stats", f"SELECT {_STATS} FROM (SELECT l_quantity AS x FROM lineitem)")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_stats(A.numeric_stats(_lineitem(spark, sf), "l_quantity"))


@query("a5_numeric_features", f"SELECT {_STATS}, max(x) - min(x) AS range, list_sort(list(x))[count(x) // 4 + 1] AS q1, list_sort(list(x))[3 * count(x) // 4 + 1] AS q3, list_sort(list(x))[3 * count(x) // 4 + 1] - list_sort(list(x))[count(x) // 4 + 1] AS iqr FROM (SELECT l_quantity AS x FROM lineitem)")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_stats(A.numeric_features(_lineitem(spark, sf), "l_quantity"))


@query("a6_profile", "SELECT * FROM (SELECT 'c_custkey' AS field, 'bigint' AS type, count(*) AS count, count(*) - count(c_custkey) AS null_count, 100.0::DOUBLE AS completeness FROM customer UNION ALL SELECT 'seg', 'string', count(*), count(*) FILTER (c_custkey % 4 = 0), round(100.0 * count(*) FILTER (c_custkey % 4 <> 0) / count(*), 6) FROM customer)")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    df = _customer(spark, sf).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    return A.profile(df).withColumn("completeness", F.round("completeness", 6))


@query("a7_drop_outliers", "WITH s AS (SELECT list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders), q AS (SELECT l[n // 4 + 1] AS q1, l[3 * n // 4 + 1] AS q3 FROM s) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN q1 - 0.2 * (q3 - q1) AND q3 + 0.2 * (q3 - q1)")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return A.drop_outliers(_orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice", 0.2)


@query("a8_deduplicate", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return A.deduplicate(_lineitem(spark, sf).select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("a8_first_of_key", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def a8_first(spark: SparkSession, sf: str) -> DataFrame:
    return A.deduplicate(_orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("a9_moments", "SELECT round(avg(pow((x - m) / s, 3)), 4) + 0.0 AS skewness, round(avg(pow((x - m) / s, 4)) - 3, 4) + 0.0 AS kurtosis FROM (SELECT l_extendedprice AS x FROM lineitem), (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return A.moment_stats(_lineitem(spark, sf), "l_extendedprice").select(F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query("a9_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def a9_corr(spark: SparkSession, sf: str) -> DataFrame:
    return A.correlations(_lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 6))


@query("a9_text_field_stats", r"SELECT min(strlen(text))::INTEGER AS min_bytes, max(strlen(text))::INTEGER AS max_bytes, round(avg(strlen(text)), 6) AS avg_bytes, round(avg(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))), 6) AS avg_words, round(avg(len(list_filter(regexp_split_to_array(text, '[.?!]'), lambda s: trim(s) <> ''))), 6) AS avg_sentences, count(DISTINCT text) AS distinct_texts FROM documents")
def a9_text(spark: SparkSession, sf: str) -> DataFrame:
    df = A.text_field_stats(table(spark, sf, "documents"), "text")
    return df.withColumns({c: F.round(c, 6) for c in ("avg_bytes", "avg_words", "avg_sentences")})


@query("a9_category_stats", "SELECT c_mktsegment AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 6) AS share FROM customer GROUP BY c_mktsegment")
def a9_category(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_stats(_customer(spark, sf), "c_mktsegment").withColumn("share", F.round("share", 6))


@query("a11_analyze", "SELECT count(*) AS rows, 8 AS numeric, 2 AS text, 1 AS other, 0.0::DOUBLE AS null_share FROM lineitem")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return A.analyze(_lineitem(spark, sf))


@query("a10_unique_values", "SELECT DISTINCT l_suppkey FROM lineitem")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf).select("l_suppkey").distinct()


@query("a12_merge_union", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, NULL::VARCHAR AS r_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey::VARCHAR, r_name FROM region")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return A.merge(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string"), "n_name"), table(spark, sf, "region").select(F.col("r_regionkey").cast("string"), "r_name"))


@query("a13_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return A.page(_orders(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 25)


@query("a14_ratio_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k < floor(0.7 * n) THEN 'train' WHEN k < floor(0.7 * n) + floor(0.2 * n) THEN 'validation' ELSE 'test' END AS part FROM r")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    parts = A.split(_orders(spark, sf).select("o_orderkey"), "o_orderkey", [0.7, 0.2, 0.1])
    return A.merge(*(p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "validation", "test"))))


@query("a14_seeded_shuffle_split", "SELECT floor(count(*) * 0.8)::BIGINT AS n, 0 AS part FROM orders UNION ALL SELECT count(*) - floor(count(*) * 0.8)::BIGINT, 1 FROM orders")
def a14_seeded(spark: SparkSession, sf: str) -> DataFrame:
    parts = A.split(_orders(spark, sf).select("o_orderkey"), "o_orderkey", [0.8, 0.2], seed=3)
    return A.merge(*(p.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k)) for k, p in enumerate(parts)))


@query("a15_shard_range", "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, least(floor((o_totalprice - a) / ((b - a) / 8)), 7)::INTEGER AS shard FROM orders, s")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return A.shard(_orders(spark, sf), "range", "o_totalprice", 8).select("o_orderkey", "shard")


@query("a15_shard_feature", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS shard FROM orders")
def a15_feature(spark: SparkSession, sf: str) -> DataFrame:
    return A.shard(_orders(spark, sf), "feature", "o_orderpriority").select("o_orderkey", "shard")


@query("a15_shard_hash", "SELECT count(*) AS n, 8::BIGINT AS shards, true AS even FROM orders")
def a15_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Every row has a shard, and shards are of like size."""
    sizes = A.shard(_orders(spark, sf), "hash", "o_orderkey", 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n"), F.count("shard").alias("shards"), (F.max("n") < 1.3 * F.min("n")).alias("even"))


@query("a16_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return A.batches(_orders(spark, sf).select("o_orderkey"), "o_orderkey", 1000)


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = _customer(spark, sf).select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    new = df.filter(k % 7 != 0).withColumn("c_acctbal", F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).unionByName(df.filter(k % 50 == 0).withColumn("c_custkey", k + 1_000_000))
    return df, new


@query("a17_version_diff", "SELECT c_custkey, 'deleted' AS change, '' AS fields FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'modified', 'c_acctbal' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 'added', '' FROM customer WHERE c_custkey % 50 = 0")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return A.diff(*_versions(spark, sf), "c_custkey").withColumn("fields", F.array_join("fields", ","))


@query("a17_three_way_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal - 1 WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0")
def a17_merge(spark: SparkSession, sf: str) -> DataFrame:
    base, theirs = _versions(spark, sf)
    ours = base.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal")))
    return A.three_way_merge(base, ours, theirs, "c_custkey").select("c_custkey", "c_acctbal")


# -- Validation ------------------------------------------------------------------------------


@query("v2_range_rules", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 1 ELSE 0 END + CASE WHEN strlen(l_returnflag) > 0 AND l_discount > 0.08 THEN 1 ELSE 0 END)::INTEGER AS n FROM lineitem")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("l_quantity", "range", {"min": 5, "max": 45}), V.Rule("l_discount", "range", {"max": 0.08}), V.Rule("l_returnflag", "byte_length", {"min": 1})]
    return V.validate(_lineitem(spark, sf), rules).select("l_orderkey", "l_linenumber", F.size("errors").alias("n"))


@query("v3_not_null_report", "SELECT 'q' AS field, 'not_null' AS rule, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 = 0")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    return V.error_report(_holes(spark, sf), [V.Rule("q", "not_null"), V.Rule("l_orderkey", "not_null")])


@query("v4_uniqueness", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS first_seen FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1")
def v4(spark: SparkSession, sf: str) -> DataFrame:
    return V.duplicates(_orders(spark, sf), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey", "first_seen")


@query("v6_composite_rules", "SELECT field, rule, count(*) AS n FROM (SELECT unnest([CASE WHEN c_acctbal < 0 THEN {'field': 'c_acctbal', 'rule': 'expression'} END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN {'field': 'c_mktsegment', 'rule': 'enum'} END, CASE WHEN NOT regexp_matches(c_name, '[0-8]$') THEN {'field': 'c_name', 'rule': 'pattern'} END], recursive := true) FROM customer) WHERE field IS NOT NULL GROUP BY field, rule")
def v6(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("c_acctbal", "expression", {"sql": "c_acctbal >= 0"}), V.Rule("c_mktsegment", "enum", {"values": ["BUILDING", "MACHINERY"]}), V.Rule("c_name", "pattern", {"pattern": "[0-8]$"})]
    return V.error_report(_customer(spark, sf), rules)


@query("v8_patterns", r"SELECT page_id, regexp_matches(url, '^(https?|ftp)://[^\s/$.?#].[^\s]*$') AS is_url, regexp_matches(url, '^\d{4}-\d{2}-\d{2}$') AS is_date FROM pages")
def v8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", V.matches(F.col("url"), "url").alias("is_url"), V.matches(F.col("url"), "date").alias("is_date"))


@query("v12_feature_quality", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(len(list_filter(v, lambda x: x = 0)) / 64.0::DOUBLE, 6) AS sparsity, 0.0::DOUBLE AS invalid, round(abs(list_avg(v)) / list_stddev_pop(v), 6) AS signal_to_noise FROM e")
def v12(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings").select("vec_id", V.feature_quality(F.col("embedding").cast("array<double>")).alias("q")).select("vec_id", "q.*")
    return df.select("vec_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


@query("v1_type_rules", "SELECT p_partkey, (CASE WHEN TRY_CAST(p_brand AS DOUBLE) IS NULL THEN 1 ELSE 0 END)::INTEGER AS n FROM part")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("p_size", "type", {"type": "numeric"}), V.Rule("p_brand", "type", {"type": "numeric", "parse": True}), V.Rule("p_name", "type", {"type": "text"})]
    return V.validate(_part(spark, sf), rules).select("p_partkey", F.size("errors").alias("n"))


@query("v5_first_error_only", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_acctbal' WHEN c_nationkey > 20 THEN 'c_nationkey' ELSE '' END AS field FROM customer")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("c_acctbal", "range", {"min": 0}), V.Rule("c_nationkey", "range", {"max": 20})]
    return V.validate(_customer(spark, sf), rules, stop_on_first=True).select("c_custkey", F.coalesce(F.get("errors", F.lit(0))["field"], F.lit("")).alias("field"))


@query("v7_substring_rule", "SELECT c_custkey FROM customer WHERE NOT contains(c_mktsegment, 'U')")
def v7(spark: SparkSession, sf: str) -> DataFrame:
    return V.split_valid(_customer(spark, sf), [V.Rule("c_mktsegment", "substring", {"text": "U"})])[1].select("c_custkey")


@query("v9_open_bounds_and_sizes", "SELECT vec_id, (CASE WHEN label <= 0 OR label >= 9 THEN 1 ELSE 0 END + CASE WHEN len(embedding) > 32 THEN 1 ELSE 0 END)::INTEGER AS n FROM embeddings")
def v9(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("label", "range", {"min": 0, "max": 9, "open": True}), V.Rule("embedding", "size", {"max": 32})]
    return V.validate(table(spark, sf, "embeddings"), rules).select("vec_id", F.size("errors").alias("n"))


@query("v6_rules_of_schema", "SELECT 'o_totalprice' AS field, 'range' AS rule, count(*) AS n FROM orders WHERE o_totalprice > 300000 HAVING count(*) > 0 UNION ALL SELECT 'o_orderstatus', 'enum', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0")
def v6_schema(spark: SparkSession, sf: str) -> DataFrame:
    df = _orders(spark, sf)
    return V.error_report(df, V.rules_of(df.schema, {"o_totalprice": {"max": 300000}, "o_orderstatus": {"allowed": ["O", "F"]}}))


@query("a3_grouped_batch_aggregates", "SELECT l_linestatus, round(sum(l_quantity), 2) AS total, strftime(max(l_shipdate), '%Y-%m-%d') AS latest, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf).groupBy("l_linestatus").agg(F.round(A.aggregate("sum", F.col("l_quantity")), 2).alias("total"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("u5_custom_stages", "SELECT o_orderkey, round(o_totalprice * 1.2, 4) AS gross FROM orders WHERE o_orderstatus = 'O'")
def u5(spark: SparkSession, sf: str) -> DataFrame:
    run = R.pipeline(lambda df: df.filter("o_orderstatus = 'O'"), lambda df: df.withColumn("gross", F.round(F.col("o_totalprice") * 1.2, 4)), lambda df: df.select("o_orderkey", "gross"))
    return run(_orders(spark, sf))


@query("r17_extract_fields", "SELECT n_name, n_regionkey FROM nation")
def r17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").transform(R.declared([R.Transformation("select", {"columns": ["n_name", "n_regionkey"]})]))


@query("f15_declared_filters", "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment NOT IN ('BUILDING') AND NOT contains(c_name, '99')")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    df = _customer(spark, sf)
    for column, op, value in (("c_acctbal", "greater_than_or_equal", 1000), ("c_mktsegment", "not_in", ["BUILDING"]), ("c_name", "not_contains", "99")):
        df = df.filter(connector_condition(column, op, value))
    return df.select("c_custkey")


@query("f16_filter_by_field", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return R.filter_by_field("o_orderstatus", "P")(_orders(spark, sf)).select("o_orderkey")


@query("a18_schema_merge", "SELECT * FROM (VALUES ('n_name', 'string'), ('n_nationkey', 'int'), ('n_regionkey', 'int'), ('r_name', 'string'), ('r_regionkey', 'int')) AS t(field, type)")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    merged = A.merge_schemas([table(spark, sf, "nation").schema, table(spark, sf, "region").schema])
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in merged], "field string, type string")


@query("v10_custom_rules", "SELECT o_orderkey, (CASE WHEN length(o_orderpriority) > 6 THEN 1 ELSE 0 END + CASE WHEN NOT o_totalprice > 50000 THEN 1 ELSE 0 END)::INTEGER AS n FROM orders")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("o_orderpriority", "length", {"max": 6}), V.Rule("o_totalprice", "expression", {"sql": "o_totalprice > 50000"})]
    return V.validate(_orders(spark, sf), rules).select("o_orderkey", F.size("errors").alias("n"))


@query("t24_mixed_features", "WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, [round(strlen(p_brand)::DOUBLE, 6), round(len(string_split(p_brand, ' '))::DOUBLE, 6), round(len(regexp_extract_all(p_brand, '[A-Z]'))::DOUBLE, 6), round((p_size - m1) / s1, 6), round((p_retailprice - m2) / s2, 6)] AS features FROM part, s")
def t24(spark: SparkSession, sf: str) -> DataFrame:
    df = R.mixed_features(_part(spark, sf).select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey")
    return df.withColumn("features", F.transform("features", lambda x: F.round(x, 6)))


@query("w5_chunked_iterator", "SELECT count(*) AS n FROM nation")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    sizes = [len(c) for c in database.chunks(table(spark, sf, "nation"), 7)]
    return spark.createDataFrame([(sum(sizes),)], "n bigint")


@query("v11_parsed_types", "SELECT page_id, (CASE WHEN TRY_CAST(url AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END)::INTEGER AS n FROM pages")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    rules = [V.Rule("url", "type", {"type": "datetime", "parse": True}), V.Rule("html", "type", {"type": "text", "allow_null": False})]
    return V.validate(table(spark, sf, "pages"), rules).select("page_id", F.size("errors").alias("n"))

import pytest
from pyspark.sql import functions as F

from vantloom.plans.predicates import Composite, Property, QueryParams, compile_condition, from_json, parse_column_filter, parse_expression

ROWS = [
    (1, '{"category":"electronics","price":85.5,"in_stock":true,"tags":["phone","mobile"],"n":5,"none":null,"mix":[1,2.5]}'),
    (2, '{"category":"clothing","price":"85.5","n":5.0}'),
    (3, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id bigint, meta string")


def _ids(rows, condition, **kw):
    return [r.id for r in rows.filter(compile_condition(F.col("meta"), condition, **kw)).orderBy("id").collect()]


@pytest.mark.parametrize(
    "condition, want",
    [
        (Property("category", "eq", "electronics"), [1]),
        (Property("price", "lt", 100), [1]),
        (Property("price", "eq", "85.5"), [2]),
        (Property("n", "eq", 5), [1, 2]),
        (Property("in_stock", "eq", True), [1]),
        (Property("in_stock", "ne", True), [2, 3]),
        (Property("in_stock", "gt", False), [1]),
        (Property("none", "eq", None), []),
        (Property("none", "ne", None), [1, 2, 3]),
        (Property("none", "lt", 3), [1]),
        (Property("none", "ge", None), [1]),
        (Property("none", "exists"), [1]),
        (Property("none", "not_exists"), [2, 3]),
        (Property("tags", "contains", "mobile"), [1]),
        (Property("tags", "not_contains", "mobile"), [2, 3]),
        (Property("mix", "contains", 1), [1]),
        (Property("mix", "contains", 2.5), [1]),
        (Property("mix", "contains", 2), []),
        (Property("category", "starts_with", "elec"), [1]),
        (Property("category", "ends_with", "ing"), [2]),
        (Property("category", "regex", "^c.*g$"), [2]),
        (Property("price", "in_range", [80, 90]), [1]),
        (Property("n", "in", [4, 5.0000001]), [1, 2]),
        (Property("n", "not_in", [5]), [3]),
        (Composite("and", (Property("category", "eq", "electronics"), Property("price", "lt", 100))), [1]),
        (Composite("or", (Property("n", "gt", 9), Property("price", "ge", 85.5))), [1]),
        (Composite("not", (Property("category", "eq", "clothing"), Property("price", "gt", 1000))), [1, 3]),
        (Composite("and", ()), [1, 2, 3]),
        (Composite("or", ()), []),
    ],
)
def test_conditions(rows, condition, want):
    assert _ids(rows, condition) == want


def test_regex_as_substring_and_json_form(rows):
    assert _ids(rows, Property("category", "regex", "^c"), regex=False) == []
    spec = {"logic": "AND", "conditions": [{"field": "n", "operator": "Eq", "value": 5}, {"field": "tags", "operator": "Exists"}]}
    assert _ids(rows, from_json(spec)) == [1]


def test_never_null(rows):
    for op, v in (("eq", 1), ("gt", 1), ("contains", "x"), ("regex", "x"), ("in", [1])):
        assert rows.select(compile_condition(F.col("meta"), Property("zz", op, v)).alias("c")).filter("c is null").count() == 0


def test_dialects(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, None, None), (3, "null", 7.0)], "id int, s string, x double")
    kinds = dict(df.dtypes)
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(parse_expression(kinds, "x > 5 OR s = x")) == [1, 3]
    assert ids(parse_expression(kinds, "missing != 3 AND x >= 5")) == [1, 3]
    assert ids(parse_expression(kinds, "s > 3")) == []
    assert ids(parse_column_filter("s", "is_null:")) == [2, 3]
    assert ids(parse_column_filter("x", "not_range:5,6")) == [2, 3]
    with pytest.raises(ValueError):
        parse_column_filter("x", "gt:abc")
    assert [r.id for r in QueryParams((("x", "is_not_null", None),), (("x", False),), 1, 1).apply(df).collect()] == [1]

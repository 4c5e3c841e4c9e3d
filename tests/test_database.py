import pytest

from vantloom.operators import database
from vantloom.operators.search import SearchOptions


def _rows(spark, ids, value=1.0):
    return spark.createDataFrame([(k, [float(k), value], None) for k in ids], "id bigint, vector array<float>, metadata string")


def test_verbs(spark, tmp_path):
    db = database.VectorDb(spark, str(tmp_path))
    db.create("a", 2, "euclidean", _rows(spark, range(10)))
    with pytest.raises(ValueError):
        db.create("a", 2)
    db.change("a", "insert", _rows(spark, [3, 20], 5.0))
    assert db.get("a").count() == 11
    db.change("a", "delete", _rows(spark, [0, 77]))
    db.change("a", "update", _rows(spark, [1, 88], 9.0))
    kept = {r.id: list(r.vector) for r in db.get("a").df.collect()}
    assert sorted(kept) == [*range(1, 10), 20] and kept[1] == [1.0, 9.0] and kept[3] == [3.0, 5.0]
    assert db.search("a", [20.0, 5.0], SearchOptions(limit=1, metric="euclidean")).first().id == 20
    assert db.batch_search("a", _rows(spark, [4]), 1).first().id == 4
    assert db.names() == ["a"]
    db.drop("a")
    with pytest.raises(KeyError):
        db.get("a")


def test_empty_collection(spark, tmp_path):
    db = database.VectorDb(spark, str(tmp_path))
    assert db.create("e", 3).stats().first().vectors == 0
    assert db.search("e", [0.0, 0.0, 0.0]).count() == 0


def test_chunks(spark):
    assert [len(c) for c in database.chunks(spark.range(10), 4)] == [4, 4, 2]
    assert list(database.chunks(spark.range(0), 4)) == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantloom.operators import aggregates as A
from vantloom.operators import ann, search
from vantloom.operators import records as R
from vantloom.operators import text as T
from vantloom.operators import validation as V
from vantloom.plans.predicates import Property
from vantloom.sources import files
from vantloom.streaming import streams


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist(), '{"g": %d}' % (k % 3)) for k in range(300)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>, metadata string")


def _vectors(df):
    return {r.id: np.array(r.vector) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan", "jaccard"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_knn_join_is_exact_either_way(emb, metric, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "GROUP_QUERIES", 2)
    v = _vectors(emb)
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids])
    found = {}
    for r in search.knn_join(emb.filter("id % 60 = 0"), emb, 4, metric, digits=9, broadcast_bytes=broadcast_bytes).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, got in found.items():
        s = np.round(search.score_matrix(v[q][None], m, metric)[0], 9)
        assert [i for _, i in sorted(got)] == ids[np.lexsort((ids, -s))[:4]].tolist()
    assert len(found) == 5


def test_search_options(emb):
    c = search.Collection("e", 8, emb)
    q = search.vector_of(c, 5)
    before = c.search(q, search.SearchOptions(limit=5, filter=Property("g", "eq", 1))).collect()
    after = c.search(q, search.SearchOptions(limit=5, filter=Property("g", "eq", 1), compat=True)).collect()
    assert len(before) == 5 and len(after) < 5
    for bad in (search.SearchOptions(limit=0), search.SearchOptions(score_threshold=2.0)):
        with pytest.raises(ValueError):
            c.search(q, bad)
    with pytest.raises(ValueError):
        c.search([1.0])
    with pytest.raises(KeyError):
        c.search(None, search.SearchOptions(from_vector_id=-5))
    assert c.search(None, search.SearchOptions(ids=(1, 2))).first().score == 1.0
    assert [r.id for r in c.search(q, search.SearchOptions(limit=3, sort="id_desc")).collect()] == sorted((r.id for r in c.search(q, search.SearchOptions(limit=3)).collect()), reverse=True)


def test_collection_changes(spark, emb):
    c = search.Collection("e", 8, emb)
    with pytest.raises(Exception, match="dimension must be 8"):
        c.upsert(spark.createDataFrame([(1, [1.0], None)], emb.schema)).df.collect()
    one = spark.createDataFrame([(1, [0.0] * 8, None), (9999, [1.0] * 8, None)], emb.schema)
    assert c.upsert(one).count() == 301 and c.update(one).count() == 300
    assert c.delete(one).count() == 299


def test_range_search(emb):
    v = _vectors(emb)
    q = v[0].tolist()
    want = sorted(i for i in v if np.linalg.norm(v[i] - v[0]) <= 2.5)
    assert sorted(r.id for r in search.range_search(emb, q, 2.5).collect()) == want
    pivots = [v[k].tolist() for k in (1, 2)]
    assert sorted(r.id for r in ann.pivot_range_search(ann.with_pivots(emb, pivots), pivots, q, 2.5).collect()) == want
    assert search.range_search(emb, q, 0.0).count() == 0
    with pytest.raises(ValueError):
        search.range_search(emb, q, -1.0)


def test_indexes_recall(emb):
    asked = emb.filter("id % 30 = 0")
    truth = search.knn_join(asked, emb, 5)
    full = ann.Ivf(emb, ann.IndexConfig("ivf", lists=6, probes=6)).join(asked, 5)
    assert ann.recall(full, truth).first().recall == 1.0
    some = ann.Ivf(emb, ann.IndexConfig("ivf", lists=6, probes=3)).join(asked, 5)
    assert ann.recall(some, truth).first().recall > 0.6
    q = _vectors(emb)[0].tolist()
    assert ann.Pq(emb, ann.IndexConfig("pq", "euclidean", subvectors=4, bits=4)).search(q, 3).first().id == 0
    assert ann.lsh_search(emb, q, 3, ann.IndexConfig("lsh")).first().id == 0
    graph = ann.knn_graph(emb, 3)
    assert graph.join(graph.selectExpr("src as dst", "dst as src"), ["src", "dst"], "left_anti").count() == 0
    assert ann.choose_index(100, 8) == "flat" and ann.IndexConfig().resolved(10_000, 64).lists == 32


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 7, 1000), rng.normal(size=997), np.zeros(10), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        s = np.sort(x)
        for q in (0.0, 0.25, 0.5, 0.75, 0.999):
            assert A.order_statistics(df, "x", {"v": q})["v"] == s[min(int(q * len(x)), len(x) - 1)]
    assert A.order_statistics(df.limit(0), "x", {"v": 0.5}) == {"v": None}


def test_ranks_and_splits(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as s")
    assert [r.id for r in A.with_rank(df, [-F.col("id")]).orderBy("_rank").limit(3).collect()] == [999, 998, 997]
    assert sorted(r._rank for r in A.with_rank(df, [F.col("s"), F.col("id")]).collect()) == list(range(1000))
    assert [p.count() for p in A.split(df, "id", [0.333, 0.333, 0.334], seed=1)] == [333, 333, 334]
    with pytest.raises(ValueError):
        A.split(df, "id", [0.5, 0.4])


def test_records(spark):
    df = spark.createDataFrame([(1, "yes", None), (2, "No", 4.0), (3, "maybe", 8.0)], "id int, flag string, x double")
    assert [r.flag for r in R.convert_types({"flag": "boolean"}, strict=False)(df).orderBy("id").collect()] == [True, False, None]
    with pytest.raises(Exception, match="cannot convert"):
        R.convert_types({"flag": "boolean"})(df).collect()
    assert [r.x for r in R.impute("x", "mean")(df).orderBy("id").collect()] == [6.0, 4.0, 8.0]
    assert [r.x for r in R.normalize("x", "minmax")(df).orderBy("id").collect()] == [None, 0.0, 1.0]
    constant = df.withColumn("x", F.lit(3.0))
    assert {r.x for r in R.normalize("x", "minmax")(constant).collect()} == {0.5} and {r.x for r in R.normalize("x", "zscore")(constant).collect()} == {0.0}
    with pytest.raises(ValueError):
        R.RecordTransformer(required=("nope",)).apply(df)
    with pytest.raises(ValueError):
        R.one_hot_encode("flag", limit=2)(df)
    schema = A.merge_schemas([df.schema, spark.createDataFrame([(1.5, "a")], "id double, y string").schema])
    assert schema["id"].dataType.simpleString() == "double" and schema["y"].nullable
    with pytest.raises(ValueError):
        A.merge_schemas([df.schema, df.select("id").schema], "strict")


def test_validation(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5), (2, "bad", None), (3, None, 99), (2, "10.0.0.1", 1)], "id int, s string, n int")
    rules = [V.Rule("s", "pattern", {"pattern": "email"}), V.Rule("n", "range", {"min": 0, "max": 10}), V.Rule("n", "not_null"), V.Rule("gone", "not_null")]
    found = {(r.id, r.s): [e.rule for e in r.errors] for r in V.validate(df, rules[:3]).collect()}
    assert found == {(1, "a@b.co"): [], (2, "bad"): ["pattern", "not_null"], (3, None): ["range"], (2, "10.0.0.1"): ["pattern"]}
    assert all(len(r.errors) == 1 for r in V.validate(df, rules[3:]).collect())
    assert [r.ok for r in spark.createDataFrame([("256.1.1.1",), ("1.2.3.4",)], "s string").select(V.matches(F.col("s"), "ip").alias("ok")).collect()] == [False, True]
    assert V.duplicates(df.withColumn("k", F.monotonically_increasing_id()), ["id"], "k").count() == 1
    with pytest.raises(Exception):
        V.require_valid(df, rules[:2]).collect()


def test_text(spark):
    df = spark.createDataFrame([(1, "I do not love this very bad, terrible film!"), (2, ""), (3, "sooooo goood teh")], "doc_id int, text string")
    s = df.select("doc_id", T.sentiment(F.col("text")).alias("s")).filter("doc_id = 1").first().s
    assert (s.positive, s.negative) == (0.0, 1.0) and s.intensity == pytest.approx((1 + 1.5 + 1) / 3)
    assert [r.c for r in df.select(T.clean(F.col("text")).alias("c")).collect()] == ["I do not love this very bad, terrible film!", None, "soo good the"]
    assert df.filter("doc_id = 3").select(T.char_ngrams(F.lit("abcd"), 2, 3)).first()[0] == ["ab", "bc", "cd", "abc", "bcd"]
    assert df.limit(1).select(T.word_ngrams(T.words(F.lit("a b")), 3)).first()[0] == []
    assert df.limit(1).select(T.stem_text(F.lit("Running quickly cats jumped as"))).first()[0] == "runn quick cat jump as"
    assert df.limit(1).select(T.half_width(F.lit("Ａ１　"))).first()[0] == "A1 "
    assert df.limit(1).select(T.strip_accents(F.lit("Été"))).first()[0] == "Ete"
    assert df.limit(1).select(T.detect_language(F.lit("это дом"))).first()[0] == "ru"
    v = df.limit(1).select(T.hash_embedding(T.words(F.lit("a b c")), 4)).first()[0]
    assert sum(x * x for x in v) == pytest.approx(1.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name;Age;Ok\nAlice;30;true\nBob;25;false\n")
    df = files.read_any(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"Name": "string", "Age": "int", "Ok": "boolean"}
    (tmp_path / "tie.csv").write_text("a,b;c\n")
    assert files.sniff_delimiter(spark, str(tmp_path / "tie.csv")) == ","
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_any(spark, str(tmp_path / "a.json")).count() == 2
    np.array([1.5, 2.5], "<f4").tofile(tmp_path / "t.bin")
    assert files.read_tensors(spark, str(tmp_path / "t.bin")).first().data == [1.5, 2.5]
    with pytest.raises(ValueError, match="no reader"):
        files.read_any(spark, str(tmp_path / "a.xlsx"), "hdf5")


def test_error_budget(spark):
    done = []

    def fn(batch, number):
        if number == 1:
            raise ValueError("bad batch")
        done.append(number)

    p = streams.Processor(fn, error_budget=0.4)
    for k in range(3):
        p(spark.range(5), k)
    assert done == [0, 2] and p.progress.errors == 1 and p.progress.rows == 10
    with pytest.raises(RuntimeError):
        strict = streams.Processor(fn, error_budget=0.01)
        for k in range(3):
            strict(spark.range(5), k)

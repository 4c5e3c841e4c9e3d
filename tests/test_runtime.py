import types

import pytest
from pyspark.sql import functions as F

from vantloom import runtime


def test_checkpoints_pass(spark):
    with runtime.passing_checkpoints(spark):
        df = runtime.checkpoint(spark.range(10))
        path = df._jdf.logicalPlan().rdd().getCheckpointFile().get()
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        exists = lambda: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
        assert df.count() == 10 and exists()
    assert not exists()
    kept = runtime.checkpoint(spark.range(3))
    assert kept.count() == 3


def test_few_splits_are_dealt_out(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dealt = runtime.spread(docs.select("doc_id"))
    assert dealt.rdd.getNumPartitions() == cores
    assert sorted(r.doc_id for r in dealt.collect()) == sorted(r.doc_id for r in docs.collect())
    wide = spark.range(0, 1000, 1, 4 * cores)
    assert runtime.spread(wide) is wide
    grouped = docs.groupBy("lang").agg(F.count(F.lit(1)))
    assert runtime.spread(grouped) is grouped


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        conf = types.SimpleNamespace(get=lambda key, default=None: folder)
        sc = types.SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
        return types.SimpleNamespace(sparkContext=sc, conf=conf)

    assert runtime.shared_folder(session("spark://x:7077", "s3a://b/c/")) == "s3a://b/c"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            runtime.shared_folder(session(master))
    local = session("local[2]")
    assert runtime.shared_folder(local) == runtime.shared_folder(local)


def test_shipped_files_are_found(spark, tmp_path):
    (tmp_path / "vocabulary.txt").write_text("seven")
    name = runtime.ship_file(spark, str(tmp_path / "vocabulary.txt"))
    assert runtime.ship_file(spark, str(tmp_path / "vocabulary.txt")) == name

    def read(batches):
        import pyarrow as pa

        for b in batches:
            with open(runtime.shipped_file(name)) as f:
                yield pa.RecordBatch.from_pydict({"t": [f.read()] * b.num_rows})

    runtime.ship(spark)
    assert [r.t for r in spark.range(2).coalesce(1).mapInArrow(read, "t string").collect()] == ["seven"] * 2

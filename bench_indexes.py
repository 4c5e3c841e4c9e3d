"""The baseline's index harness: 10,000 random vectors of 128 numbers, 100 queries, top 10, three repeats.

Prints one JSON line with, for each index: build ms, mean ms of a query when all are asked together,
queries a second, bytes on disk, and accuracy (overlap with the exact top k / (queries x k)).
BENCH_VECTORS, BENCH_DIM and BENCH_QUERIES set other sizes. Vectors are seeded.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vantloom.operators import ann, search

METRIC, K, REPEATS = "euclidean", 10, 3


def main() -> None:
    n, dim, asked_n = (int(os.environ.get(k, d)) for k, d in (("BENCH_VECTORS", "10000"), ("BENCH_DIM", "128"), ("BENCH_QUERIES", "100")))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="vantloom-bench-")
    rng = np.random.default_rng(42)

    def stored(name: str, count: int) -> DataFrame:
        rows = [(k, v) for k, v in enumerate(rng.random((count, dim), np.float32).tolist())]
        spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(int(cpus)).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    df, asked = stored("vectors", n), stored("queries", asked_n)
    sample = stored("sample", 50)
    truth = search.knn_join(asked, df, K, METRIC).cache()
    truth.count()
    config = ann.IndexConfig("ivf", METRIC, lists=32, probes=8)

    def ivf(path: str):
        ann.Ivf(df, config).save(path)
        return lambda: ann.Ivf.load(spark, path).join(asked, K)

    def tuned(path: str):
        ann.Ivf(df, config).tuned(sample, K, 0.95).save(path)
        return lambda: ann.Ivf.load(spark, path).join(asked, K)

    def certain(path: str):
        ann.Ivf(df, config).save(path)
        return lambda: ann.Ivf.load(spark, path).certain_join(asked, K)

    def pq(path: str):
        ann.Pq(df, ann.IndexConfig("pq", METRIC, subvectors=16, bits=6)).save(path)
        return lambda: ann.Pq.load(spark, path).certain_join(asked, K)

    def graph(kind: str):
        def build(path: str):
            g = ann.GraphConfig(kind, METRIC, ef=256)
            ann.Ivf(df, ann.IndexConfig("ivf", METRIC, lists=1, probes=1)).save(f"{path}/cells")
            cells = ann.Ivf.load(spark, f"{path}/cells")
            ann.build_graph(cells, g).write.partitionBy("cell").parquet(f"{path}/graph")
            return lambda: ann.graph_join(spark.read.parquet(f"{path}/graph"), cells, asked, K, g)

        return build

    def trees(path: str):
        found = ann.Trees.fit(df, trees=8, leaf_rows=100, leaves=64, metric=METRIC)
        found.assign(df).write.partitionBy("cell").parquet(path)
        return lambda: found.join(spark.read.parquet(path), asked, K)

    kinds = {"flat": lambda path: lambda: search.knn_join(asked, df, K, METRIC), "ivf": ivf, "ivf_tuned": tuned, "ivf_certain": certain, "pq_certain": pq, "hnsw": graph("hnsw"), "ngt": graph("ngt"), "graph": graph("graph"), "trees": trees}
    out = {}
    for name, build in kinds.items():
        path, began = f"{root}/{name}", time.perf_counter()
        run = build(path)
        built = time.perf_counter() - began
        run().count()
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        each = statistics.median(times) / asked_n
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
        out[name] = {"build_ms": round(1000 * built), "query_ms": round(1000 * each, 2), "qps": round(1 / each, 1), "index_bytes": size, "accuracy": round(ann.recall(run(), truth).first().recall, 4)}
    print(json.dumps({"vectors": n, "dim": dim, "queries": asked_n, "top_k": K, "metric": METRIC, "indexes": out}))
    spark.stop()
    shutil.rmtree(root)


if __name__ == "__main__":
    main()

import hashlib

import numpy as np
import test_line_dedup
import test_mixing
import test_near_copies

import corpus_pipeline
from vantloom.llm import bpe, mixing, quality


def test_every_stage_against_its_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{number}")
        kept.append(spark.read.parquet(f"{tmp_path}/{number}"))
    assert all(df.columns == columns for df in kept[:-1])
    rows = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in kept[:-1]]

    scores = {r.doc_id: r.score for r in quality.op5_quality(spark, sf).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r[0]] >= quality.THRESHOLD)

    texts = test_line_dedup._brute(rows[1])
    assert sorted(rows[2]) == sorted((i, texts[i, t]) for i, t in rows[1] if texts[i, t] or not t)

    label = test_near_copies._labels([t for _, t in rows[2]])
    heads = {}
    for (i, _), k in zip(rows[2], label):
        heads[k] = min(heads.get(k, i), i)
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] in heads.values())

    whole = [tuple(r) for r in kept[3].select("doc_id", "text", "lang", "source").collect()]
    assert sorted(str(i) for i, _ in rows[4]) == sorted(i for i, _ in test_mixing._brute(whole, mixing.PRODUCTION))

    enc = bpe.load_encoding(*bpe.production_ranks())
    want = []
    for i, t in rows[4]:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, kept[-1].collect())) == sorted(want)
    assert np.mean([i in dict(rows[1]) for i, _ in rows[0]]) > 0.5


def test_run_and_odd_rows(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "", "en", "src0", 0, 2), (None, "plain words in a row", "en", "src1", 20, 3), (3, "plain words in a row", None, "src1", 20, 4), (3, "plain words in a row", None, "src1", 20, 4)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, epochs bigint",
    )
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, sf)
            assert found.columns == docs.columns
            docs = spark.createDataFrame(found.collect(), found.schema)
        assert bpe.bpe_digests(docs, *bpe.production_ranks()).count() == docs.count()

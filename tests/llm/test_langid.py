import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vantloom.llm import langid


def _sample(lang, text):
    counts = langid.gram_counts(text)
    held = np.flatnonzero(counts)
    return lang, held.astype(np.uint16), counts[held].astype(np.uint32)


def _grams(text):
    """Counter of the letter n-grams of the text's words, as strings."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    joined = " " + " ".join(kept.split()) + " "
    return Counter(joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1))


def _bucket(gram):
    """The hashed bucket of one gram, letter by letter in plain integers."""
    h = ord(gram[0]) * 0x9E3779B1 % 2**32
    for c, (mix, out) in zip(gram[1:], ((0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1))):
        h = (h ^ ord(c) * mix % 2**32) * out % 2**32
    return h >> 19


def test_counts_idf_and_nearest_centroid_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    vectors = {}
    for i, text, _ in rows:
        total = Counter()
        for gram, n in _grams(text).items():
            total[_bucket(gram)] += n
        counts = langid.gram_counts(text)
        assert {k: int(counts[k]) for k in np.flatnonzero(counts)} == dict(total)
        vectors[i] = total
    model = langid.fit(docs.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1"))
    # So small a table is drawn whole: inverse document frequencies are those of all learnable rows.
    distinct = {(i, lang): vectors[i] for i, _, lang in kept}
    for k in range(0, langid.BUCKETS, 7):
        held = sum(k in v for v in distinct.values())
        assert model.idf[k] == pytest.approx(math.log((1 + len(distinct)) / (1 + held)) + 1, rel=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    assert sorted(Counter(model.owner.tolist()).values()) == [langid.CLUSTERS] * len(model.languages)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, _, _ in rows:
        tf = {k: math.log1p(n) * model.idf[k] for k, n in vectors[i].items()}
        size = math.sqrt(sum(x * x for x in tf.values()))
        near = [sum(x / size * float(c[k]) for k, x in tf.items()) for c in model.centroids]
        best = [max(n for n, o in zip(near, model.owner) if o == k) for k in range(len(model.languages))]
        top = max(best)
        assert found[i].nearest == model.languages[best.index(top)]
        assert found[i].cosine == pytest.approx(top, abs=1e-4)
        assert found[i].score == pytest.approx(1 / sum(math.exp(langid.SHARPNESS * (b - top)) for b in best), abs=2e-2)
        assert found[i].rejected == (found[i].cosine < model.floor[best.index(top)])


def test_the_commonest_languages_are_learned_and_repeats_teach_once(spark):
    rows = [(k, f"the cat number {'x' * (k % 9)}", f"l{k % 3}") for k in range(30)] + [(99, "le chat", "rare")] + [(200, "same row again", "l0")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.fit(docs, languages=3).languages == ["l0", "l1", "l2"]
    assert langid.fit(docs).languages == ["l0", "l1", "l2", "rare"]


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = "Été à Paris, 12 fois;  ça va?\n" * 300
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_PART", 97)
    assert (langid.gram_counts(text) == whole).all()
    # Runs of letters with one blank around each, in one to three grams.
    assert langid.gram_counts("ab!! c").sum() == sum(len(" ab c ") - k for k in range(3))


def test_no_letter_no_language():
    assert all(langid.gram_counts(t) is None for t in (None, "", "12 34 !!", " \n"))


def test_clusters_find_separate_directions():
    rng = np.random.default_rng(0)
    v = np.repeat(np.eye(4, 30), 25, axis=0) + rng.normal(0, 0.02, (100, 30))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert ((langid._cluster(v, 4) @ v.T).max(axis=0) > 0.95).all()


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op3_language_id(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog are in the house", "en"), (2, "le chat et le chien sont dans la maison", "fr"), (3, "the birds and the bees", "en"),
            (4, "les oiseaux et les abeilles", "fr"), (5, None, "en"), (6, "123", "fr"), (7, "the end", None), (7, "the end", None), (None, "the " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS nearest", "1 AS score")
    model = langid.fit(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert (by[5].nearest, by[5].score, by[6].nearest, by[6].score) == ("und", 0.0, "und", 0.0)
    assert (by[7].nearest, by[2].nearest, by[None].nearest) == ("en", "fr", "en")
    assert model.predict(["жук и кот " * 10])[0][3]
    blank = langid.fit(docs.filter("lang = 'xx'"))
    assert {r.nearest for r in langid.identify(docs, blank).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_prediction_does_not_depend_on_the_rest_of_the_batch(spark):
    texts = ["le chat noir", "the black cat", None, "der schwarze hund"]
    model = langid.train([_sample("en", "the black cat and dog"), _sample("fr", "le chat noir et chien"), _sample("de", "der schwarze hund und katze")])
    alone = [model.predict([t])[0] for t in texts]
    for a, b in zip(alone, model.predict(texts)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-5)

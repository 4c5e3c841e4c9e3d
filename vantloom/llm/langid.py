"""Language ID by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter n-grams (one to three letters, words marked
by blanks). Each language has several centroids, clustered by cosine from a bounded sample of
labelled rows; a text gets the language of its nearest centroid. Where even that is further
away than all but a small share of the language's own training texts, by a margin, the text is
rejected: ``rejected`` is true, and ``language`` is ``und``.

The fit reads every labelled row's language to set the sampling rates, and draws about
``SAMPLE_PER_LANGUAGE`` rows of each by hash, ``SAMPLE_ROWS`` in all; their grams and counts, not
their texts, come to the driver and stay sparse there but for one language's at a time. Languages
are a label vocabulary: the ``MAX_LANGUAGES`` commonest (ties by name) are learned, so the model
has MAX_LANGUAGES x CLUSTERS x BUCKETS floats at most.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
labelled row all are; rows with null language teach nothing; repeated rows teach once and give repeated rows;
an empty table gives an empty table; a very long text is counted in parts; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.runtime import table

BUCKETS = 8_192
SAMPLE_PER_LANGUAGE = 500
#: Rows of the whole sample, shared by many languages.
SAMPLE_ROWS = 20_000
CLUSTERS = 4
MAX_LANGUAGES = 500
#: Similarities are sharpened by this factor before they are normalised to a score.
SHARPNESS = 24.0
#: A text is rejected below this share of the similarity that REJECT_QUANTILE of training texts stay under.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.7
UNKNOWN = "und"
_PART = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text in BUCKETS buckets; None without a letter."""
    if not text:
        return None
    total = np.zeros(BUCKETS, np.int64)
    tail = np.array([32], np.uint32)
    lowered, known = text.lower(), _letters()
    for at in range(0, len(lowered), _PART):
        c = np.frombuffer(lowered[at : at + _PART].encode("utf-32-le"), np.uint32)
        c = np.where(known[c], c, np.uint32(32))
        last = at + _PART >= len(lowered)
        c = np.concatenate([tail, c, np.array([32] if last else [], np.uint32)])
        blank = c == 32
        c = c[np.r_[True, ~(blank[1:] & blank[:-1])]]
        a = c * np.uint32(0x9E3779B1)
        two = (a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        skip = 0 if at == 0 else 2  # grams wholly in the tail were counted with the last part
        for grams in (a[skip:], two[max(0, skip - 1) :], three):
            total += np.bincount(grams >> np.uint32(32 - 13), minlength=BUCKETS)
        tail = c[-2:]
    return total if total[np.arange(BUCKETS) != _blank_bucket()].any() else None


@functools.cache
def _blank_bucket() -> int:
    return int((np.array([32], np.uint32) * np.uint32(0x9E3779B1))[0] >> np.uint32(32 - 13))


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray  # [centroid, bucket], unit length
    idf: np.ndarray
    floor: np.ndarray  # by language: nearer than this or rejected

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.stack(counts)).astype(np.float32) * self.idf
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(nearest language, score, cosine, rejected) of each text."""
        out = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        counts = [gram_counts(t) for t in texts]
        with_letters = [k for k, c in enumerate(counts) if c is not None]
        if not with_letters or not self.languages:
            return out
        near = self.vectors([counts[k] for k in with_letters]) @ self.centroids.T
        best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1).astype(np.float64)
        odds = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
        choice = best.argmax(axis=1)
        score = odds.max(axis=1) / odds.sum(axis=1)
        for k, c, s, row in zip(with_letters, choice.tolist(), score.tolist(), best):
            out[k] = (self.languages[c], s, float(row[c]), bool(row[c] < self.floor[c]))
        return out


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    mean = v.mean(axis=0)
    centers = [v[(v @ mean).argmax()]]
    while len(centers) < min(k, len(v)):
        centers.append(v[np.max(v @ np.stack(centers).T, axis=1).argmin()])
    c = np.stack(centers)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def _dense(samples: list[tuple]) -> list[np.ndarray]:
    out = []
    for _, held, counts in samples:
        row = np.zeros(BUCKETS, np.int64)
        row[held] = counts
        out.append(row)
    return out


def train(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, buckets, counts) rows."""
    samples = sorted(samples, key=lambda s: (s[0], hashlib.sha256(s[1].tobytes() + s[2].tobytes()).digest()))
    languages = sorted({s[0] for s in samples})
    if not languages:
        return Model([], np.empty(0, int), np.empty((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.empty(0))
    df = np.zeros(BUCKETS, np.int64)
    for _, held, _ in samples:
        df[held] += 1
    model = Model(languages, np.empty(0, int), np.empty(0), (np.log((1 + len(samples)) / (1 + df)) + 1).astype(np.float32), np.empty(0))
    owner, centroids, floor = [], [], []
    for k, (_, own) in enumerate(itertools.groupby(samples, key=lambda s: s[0])):
        v = model.vectors(_dense(list(own)))
        c = _cluster(v, CLUSTERS)
        owner += [k] * len(c)
        centroids.append(c)
        floor.append(REJECT_SHARE * float(np.quantile((v @ c.T).max(axis=1), REJECT_QUANTILE)))
    model.owner, model.centroids, model.floor = np.array(owner), np.concatenate(centroids).astype(np.float32), np.array(floor)
    return model


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, languages: int = MAX_LANGUAGES) -> Model:
    """Fit on a sample of about ``per_language`` rows of each language, drawn by hash of the id and the text."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return train([])
    per_language = min(per_language, max(20, SAMPLE_ROWS // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(1_000_000))
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1_000_000, 1_000_000 * per_language // n + 1)))), F.col("lang"))
    # Equal rows have one draw and teach once, or very many of them could crowd the sample.
    drawn = rows.filter(draw < rate).withColumn("th", F.xxhash64("text")).dropDuplicates(["lang", "id", "th"])

    def make():
        def fn(langs, texts):
            found = [(lang, c) for lang, t in zip(langs, texts) if (c := gram_counts(t)) is not None]
            held = [np.flatnonzero(c) for _, c in found]
            return [x[0] for x in found], [h.astype(np.uint16).tobytes() for h in held], [x[1][h].astype(np.uint32).tobytes() for x, h in zip(found, held)]

        return fn

    sample = map_rows(drawn.select("lang", "text"), make, "lang string, buckets binary, counts binary")
    return train([(r["lang"], np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in sample.collect()])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nearest, language, score, cosine, rejected) of every whole text; one narrow pass."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def fn(ids, texts):
            found = own.predict(texts)
            return ids, [f[0] for f in found], [UNKNOWN if f[3] else f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found]

        return fn

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, nearest string, language string, score double, cosine double, rejected boolean", step=64)


def fold(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.filter(~held_out))
    found = identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "cosine", "rejected")

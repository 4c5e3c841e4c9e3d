"""Quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are binned counts and ratios of
its characters and words, those of the line before and the line after. Forward-backward gives
each line's probability of being good; weighted by length and averaged, it is the document's
share of good text, which a fitted logistic curve turns into the score: the probability that
``labels.quality`` is 1.

Labels mark documents, so line labels are learned in rounds: lines start with their document's
label; after each fit, lines of bad documents that the field takes for good are relabelled good,
but for the document's worst line. The fit uses a bounded sample: about ``SAMPLE_PER_CLASS``
labelled documents of each class, drawn by hash, weighted back to all labelled rows. Their
feature codes, one byte for each line and feature, come to the driver, not their texts: documents in
order of a hash, as many as have ``FIT_LINES`` lines together.

Defined results: null and empty texts are one empty line; a document labelled twice with
different labels teaches both; equal rows teach once; without labels of both classes the score is the share of label 1
(0.5 if there is no label); repeated rows give repeated rows; an empty table gives an empty
table; a very long text is a chain like any other, in memory in proportion to it; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.llm.langid import fold
from vantloom.runtime import checkpoint, ship, spread, table

SAMPLE_PER_CLASS = 1_500
#: Lines that the sample has at most; a document with more than DOCUMENT_LINES teaches nothing, though it is scored.
FIT_LINES = 400_000
DOCUMENT_LINES = 20_000
THRESHOLD = 0.3
ROUNDS = 3
STEPS = 150

# Character classes.
SPACE, LOWER, UPPER, DIGIT, BANG, PIPE, SYMBOL, STOP, OTHER = range(9)
CLASSES = 9
# Bin edges of ratios and of lengths.
RATIO_EDGES = np.array([1e-9, 0.005, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
LENGTH_EDGES = np.array([1, 2, 3, 5, 8, 12, 20, 35, 60, 100, 180, 320, 600, 1500, 4000])
BINS = 16
FEATURES = 14


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point; whole Unicode, so no letter counts as a symbol."""
    table_ = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            table_[c] = SPACE
        elif ch.isalpha():
            table_[c] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            table_[c] = DIGIT
    for chars, kind in (("!?", BANG), ("|", PIPE), ("$%&*#@^~=+<>{}[]\\_`", SYMBOL), (".,;:", STOP)):
        for ch in chars:
            table_[ord(ch)] = kind
    return table_


def line_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes [line, feature] of uint8, length of each line in characters) of the whole text."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(c == 10)
    n = len(breaks) + 1
    begins, ends = np.r_[0, breaks + 1], np.r_[breaks, len(c)]
    length = ends - begins
    kinds = _classes()[c]
    line = np.repeat(np.arange(n), np.r_[np.diff(np.r_[0, breaks + 1]), len(c) - begins[-1]])
    count = np.bincount(line * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    solid = kinds != SPACE
    first = solid & np.r_[True, ~solid[:-1]] if len(c) else solid
    words = np.bincount(line[first], minlength=n).astype(np.float64)
    title = np.bincount(line[first & (kinds == UPPER)], minlength=n)
    bare = np.bincount(line[first & (kinds != UPPER) & (kinds != LOWER)], minlength=n)
    # A word is known by the sum of its characters' random values: enough to tell repeats.
    at = np.flatnonzero(first)
    repeats = np.zeros(n)
    if len(at):
        mixed = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        sums = np.add.reduceat(np.where(solid, mixed, np.uint64(0)), at)
        owner = line[at]
        same = (sums[1:] == sums[:-1]) & (owner[1:] == owner[:-1])
        repeats += np.bincount(owner[1:][same], minlength=n)
    chars, some = np.maximum(1, count.sum(axis=1) - count[:, SPACE]), np.maximum(1, words)
    letters = np.maximum(1, count[:, LOWER] + count[:, UPPER])
    ratios = np.stack(
        [
            count[:, UPPER] / letters,
            count[:, DIGIT] / chars,
            count[:, BANG] / some,
            count[:, PIPE] / some,
            count[:, SYMBOL] / chars,
            count[:, STOP] / some,
            count[:, OTHER] / chars,
            title / some,
            bare / some,
            repeats / some,
            (count[:, LOWER] + count[:, UPPER]) / chars,
        ],
        axis=1,
    )
    codes = np.empty((n, FEATURES), np.uint8)
    codes[:, :11] = np.searchsorted(RATIO_EDGES, ratios, "right")
    codes[:, 11] = np.searchsorted(LENGTH_EDGES, words, "right")
    codes[:, 12] = np.searchsorted(LENGTH_EDGES, chars / some * 4, "right")
    codes[:, 13] = np.minimum(BINS - 1, np.searchsorted(LENGTH_EDGES, n, "right"))
    return codes, np.maximum(1, length)


@dataclass
class Field:
    """Weights of state good against bad; ``weights`` is [previous, own, next] by feature and bin."""

    weights: np.ndarray
    edge: np.ndarray  # weight of a missing previous and next line
    bias: float
    move: np.ndarray  # [from, to] over (bad, good)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def emissions(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of good of every line; ``starts`` are the first lines of the documents."""
        f = np.arange(FEATURES)
        before, own, after = (self.weights[k][f, codes].sum(axis=1) for k in range(3))
        score = own + self.bias
        first = np.zeros(len(codes), bool)
        first[starts] = True
        last = np.r_[first[1:], True]
        score[1:] += np.where(first[1:], self.edge[0], before[:-1])
        score[0] += self.edge[0]
        score[:-1] += np.where(last[:-1], self.edge[1], after[1:])
        score[-1] += self.edge[1]
        return score


def forward_backward(odds: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good of every line, expected moves [from, to] of every document's chain summed)."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    emit = np.exp(np.clip(np.stack([-odds / 2, odds / 2], axis=1), -40, 40))
    hop = np.exp(np.clip(move, -20, 20))
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), "right")
    for t, m in enumerate(active):
        at = starts[:m] + t
        a = emit[at] if t == 0 else alpha[at - 1] @ hop * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    total = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        back = beta[at] * emit[at]
        joint = alpha[at - 1][:, :, None] * hop[None] * back[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = back @ hop.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), total


def _batch(lines: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c, _ in lines])
    return np.concatenate([c for c, _ in lines]), np.concatenate([n for _, n in lines]).astype(np.float64), sizes, np.cumsum(sizes) - sizes


def good_share(field: Field, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, one value for each document."""
    codes, length, sizes, starts = _batch(lines)
    good, _ = forward_backward(field.emissions(codes, starts), field.move, sizes)
    return np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)


def scores(field: Field, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(lines), field.constant)
    share = np.clip(good_share(field, lines), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(field.slope * np.log(share / (1 - share)) + field.shift)))


def _adam(params: list[np.ndarray], gradient, steps: int, rate: float = 0.05) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient()):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], prior: dict[int, float]) -> Field:
    """A field from (label, codes, lengths) rows; ``prior`` is each class's share of all labelled rows."""
    empty = Field(np.zeros((3, FEATURES, BINS)), np.zeros(2), 0.0, np.zeros((2, 2)))
    labels = np.array([s[0] for s in samples], int)
    if len(set(labels.tolist())) < 2:
        empty.constant = prior.get(1, 0.0) / sum(prior.values()) if sum(prior.values()) else 0.5
        return empty
    samples = [samples[k] for k in sorted(range(len(samples)), key=lambda k: (samples[k][0], len(samples[k][1]), samples[k][1].tobytes(), samples[k][2].tobytes()))]
    labels = np.array([s[0] for s in samples], int)
    lines = [(s[1], s[2]) for s in samples]
    codes, length, sizes, starts = _batch(lines)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # A document's lines weigh by length and share one unit, so long documents don't rule the fit.
    weight = length / np.add.reduceat(length, starts)[doc]
    target = labels[doc].astype(np.float64)
    first = np.zeros(len(codes), bool)
    first[starts] = True
    last = np.r_[first[1:], True]
    slots = (np.arange(FEATURES) * BINS + codes).astype(np.int64)
    w, edge, bias, move = np.zeros((3, FEATURES * BINS)), np.zeros(2), np.zeros(1), np.zeros((2, 2))

    def tally(residual: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(slots[rows].ravel(), np.repeat(residual, FEATURES), minlength=FEATURES * BINS)

    inner_next, inner_prev = np.flatnonzero(~last), np.flatnonzero(~first)

    def gradient():
        field = Field(w.reshape(3, FEATURES, BINS), edge, float(bias[0]), move)
        good, moves = forward_backward(field.emissions(codes, starts), move, sizes)
        r = (good - target) * weight
        scale = 1 / len(sizes)
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[inner_next].astype(int), target[inner_next + 1].astype(int)), 1.0)
        pairs = max(1, len(inner_next))
        return [
            np.stack([tally(r[inner_prev], inner_prev - 1), tally(r, np.arange(len(codes))), tally(r[inner_next], inner_next + 1)]) * scale + 1e-4 * w,
            np.array([r[first].sum(), r[last].sum()]) * scale,
            np.array([r.sum() * scale]),
            (moves - seen) / pairs + 1e-2 * move,
        ]

    for step in range(ROUNDS):
        _adam([w, edge, bias, move], gradient, STEPS)
        if step + 1 < ROUNDS:
            field = Field(w.reshape(3, FEATURES, BINS), edge, float(bias[0]), move)
            good, _ = forward_backward(field.emissions(codes, starts), move, sizes)
            worst = good <= np.minimum.reduceat(good, starts)[doc] + 1e-12
            target = np.where(labels[doc] == 1, 1.0, ((good > 0.5) & ~worst).astype(np.float64))
    field = Field(w.reshape(3, FEATURES, BINS).copy(), edge.copy(), float(bias[0]), move.copy())
    share = np.clip(good_share(field, lines), 1e-6, 1 - 1e-6)
    x, y = np.log(share / (1 - share)), labels.astype(np.float64)
    counts = np.bincount(labels, minlength=2)
    each = np.array([prior.get(k, 0.0) / max(1, counts[k]) for k in (0, 1)])[labels]
    each /= each.sum()
    slope, shift = np.ones(1), np.zeros(1)

    def curve():
        r = (1 / (1 + np.exp(-(slope[0] * x + shift[0]))) - y) * each
        return [np.array([(r * x).sum()]) + 1e-3 * (slope - 0.5), np.array([r.sum()])]

    _adam([slope, shift], curve, 600)
    field.slope, field.shift = float(max(1e-3, slope[0])), float(shift[0])
    return field


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, lines: int = FIT_LINES) -> Field:
    """Fit on about ``per_class`` labelled documents of each class; labels other than 0 and 1 are passed over."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in marked.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return train([], counts)
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("_label_id")), F.lit(1_000_000))
    rate = {k: min(1_000_000, 1_000_000 * per_class // n + 1) for k, n in counts.items()}
    drawn = marked.filter(draw < F.when(F.col("_label") == 1, rate[1]).otherwise(rate[0])).distinct()
    # The drawn labels are about 2 * per_class rows of a few bytes, whatever the tables' sizes.
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = named.join(F.broadcast(drawn), F.col("id") == F.col("_label_id")).select(F.col("_label").alias("label"), F.xxhash64("id", "text").alias("key"), "text")

    def make():
        def fn(marks, keys, texts):
            found = [(m, k, *line_codes(t)) for m, k, t in zip(marks, keys, texts) if (t or "").count("\n") < DOCUMENT_LINES]
            return [f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found], [f[2].tobytes() for f in found], [f[3].astype(np.int64).tobytes() for f in found]

        return fn

    sample = checkpoint(map_rows(rows, make, "label int, key bigint, n bigint, codes binary, lengths binary", step=64))
    left, chosen = lines, []
    for r in sample.select("key", "label", "n").distinct().orderBy("key", "label").limit(4 * per_class).collect():
        if r.n <= left:
            left -= r.n
            chosen.append((r.key, r.label))
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "key bigint, label int"))
    taught = sample.join(picked, ["key", "label"]).dropDuplicates(["key", "label"])
    return train([(r["label"], np.frombuffer(r["codes"], np.uint8).reshape(-1, FEATURES), np.frombuffer(r["lengths"], np.int64)) for r in taught.collect()], counts)


def score_documents(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of every whole text; one narrow pass."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        own = sent.value
        return lambda ids, texts: (ids, scores(own, [line_codes(t) for t in texts]) if ids else [])

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, score double", step=512)


def label_lines(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, good double) of every line: the marginals themselves."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def fn(ids, texts):
            out = []
            for t in texts:
                codes, _ = line_codes(t)
                good, _ = forward_backward(field.emissions(codes, np.array([0])), field.move, np.array([len(codes)]))
                out.append(good.tolist())
            return ids, out

        return fn

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, good array<double>", step=64).select(id_col, F.posexplode("good").alias("line_no", "good"))


def drop_rejected(docs: DataFrame, field: Field, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold, in one narrow pass."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept = scores(sent.value, [line_codes(t) for t in part.column(where).to_pylist()]) >= threshold
                yield part.filter(pa.array(kept))

    return spread(docs).mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` outside the held-out fold."""
    return labels.filter(fold("doc_id", 5) != 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, learnable(table(spark, sf_dir, "labels")))
    found = score_documents(docs, field)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

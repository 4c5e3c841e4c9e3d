import itertools
import zlib

import numpy as np

from vantloom.llm import quality


def _enumerated(odds, move):
    """Marginals of good and expected moves by summing over every labelling."""
    n = len(odds)
    good, moves, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o / 2 if s else -o / 2 for o, s in zip(odds, path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        good += w * np.array(path)
        for a, b in zip(path, path[1:]):
            moves[a, b] += w
    return good / total, moves / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 5, 3, 7, 1])
    odds, move = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    good, moves = quality.forward_backward(odds, move, sizes)
    at, want = 0, np.zeros((2, 2))
    for s in sizes:
        g, m = _enumerated(odds[at : at + s], move)
        assert np.allclose(good[at : at + s], g)
        want += m
        at += s
    assert np.allclose(moves, want)


def test_codes_of_lines():
    codes, length = quality.line_codes("Good line here.\nBAD!! WORSE!!\n\n12 12 12 | |")
    assert codes.shape == (4, quality.FEATURES) and length.tolist() == [15, 13, 1, 12]
    assert codes[1, 0] > codes[0, 0] and codes[1, 2] > codes[0, 2] and codes[3, 3] > 0 and codes[3, 9] > 0 and codes[3, 1] > 0
    assert codes.max() < quality.BINS
    one, _ = quality.line_codes("")
    none, _ = quality.line_codes(None)
    assert (one == none).all() and len(one) == 1


def _codes_by_hand(text):
    """(codes, length) of each line, character by character."""
    lines = (text or "").split("\n")
    out = []
    for line in lines:
        words, word = [], ""
        for ch in line + " ":
            if ch.isspace():
                words += [word] if word else []
                word = ""
            else:
                word += ch
        upper = sum(ch.isalpha() and ch.isupper() for ch in line)
        lower = sum(ch.isalpha() and not ch.isupper() for ch in line)
        digits = sum(not ch.isalpha() and ch.isdigit() for ch in line)
        kinds = {k: sum(ch in k for ch in line) for k in ("!?", "|", "$%&*#@^~=+<>{}[]\\_`", ".,;:")}
        bang, pipe, symbol, stop = kinds.values()
        solid = sum(not ch.isspace() for ch in line)
        chars, some, letters = max(1, solid), max(1, len(words)), max(1, upper + lower)
        ratios = [upper / letters, digits / chars, bang / some, pipe / some, symbol / chars, stop / some,
                  (solid - upper - lower - digits - bang - pipe - symbol - stop) / chars,
                  sum(w[0].isalpha() and w[0].isupper() for w in words) / some, sum(not w[0].isalpha() for w in words) / some,
                  sum(sorted(a) == sorted(b) for a, b in zip(words, words[1:])) / some, (upper + lower) / chars]
        code = [sum(r >= e for e in quality.RATIO_EDGES) for r in ratios]
        code += [sum(x >= e for e in quality.LENGTH_EDGES) for x in (len(words), chars / some * 4, len(lines))]
        out.append(([*code[:-1], min(quality.BINS - 1, code[-1])], max(1, len(line))))
    return out


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, quality.learnable(labels))
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r.score for r in quality.op5_quality(spark, sf).collect()}
    seen = 0
    for i, text in rows.items():
        by_hand = _codes_by_hand(text)
        codes, length = quality.line_codes(text)
        assert codes.tolist() == [c for c, _ in by_hand] and length.tolist() == [n for _, n in by_hand]
        if len(by_hand) > 10:
            continue
        seen += 1
        weight = lambda k, line: sum(field.weights[k][f, c] for f, c in enumerate(by_hand[line][0]))  # noqa: B023, E731
        last = len(by_hand) - 1
        odds = [field.bias + weight(1, n) + (weight(0, n - 1) if n else field.edge[0]) + (weight(2, n + 1) if n < last else field.edge[1]) for n in range(last + 1)]
        good, _ = _enumerated(odds, field.move)
        share = np.clip(sum(g * n for g, (_, n) in zip(good, by_hand)) / sum(n for _, n in by_hand), 1e-6, 1 - 1e-6)
        assert abs(found[i] - 1 / (1 + np.exp(-(field.slope * np.log(share / (1 - share)) + field.shift)))) < 1e-6
    assert seen > 50


def test_fit_holds_its_line_bound(spark):
    rows = [(k, "\n".join(f"line {j} of {k}" for j in range(50))) for k in range(60)] + [(1, "same\nrow")] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    seen = []
    whole, quality_train = quality.train, quality.train
    try:
        quality.train = lambda samples, prior: seen.append(samples) or whole(samples[:0], prior)
        quality.fit(docs, labels, lines=520)
        quality.fit(docs, labels)
    finally:
        quality.train = quality_train
    assert 470 < sum(len(s[1]) for s in seen[0]) <= 520
    assert sum(len(s[1]) for s in seen[1]) == 60 * 50 + 2


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(0, 0.3, (3, quality.FEATURES, quality.BINS)), rng.normal(0, 1, 2), 0.1, rng.normal(0, 1, (2, 2)))
    lines = [quality.line_codes(t) for t in ("a\nb\nc", "", "X!! Y!!", "one two\n" * 400, "z")]
    together = quality.scores(field, lines)
    assert np.allclose(together, [quality.scores(field, [x])[0] for x in lines])


def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_edges(spark):
    rows = [(k, "Fine prose stands here.\nAnd it goes on." if k % 2 else "BUY!! NOW!!\nCHEAP!! $$$ ###") for k in range(40)] + [(50, None), (51, ""), (None, "word " * 50_000), (1, "Fine prose stands here.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "5 AS score", "'l' AS _label")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (1, 1)], "doc_id bigint, quality int")
    field = quality.fit(docs, labels)
    found = [(r.doc_id, r.score) for r in quality.score_documents(docs, field).collect()]
    assert len(found) == len(rows)
    assert all((s >= 0.5) == bool(i % 2) for i, s in found if i is not None and i < 40)
    kept = quality.drop_rejected(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(40) if k % 2}
    assert not {r.doc_id for r in kept.collect()} & {k for k in range(40) if not k % 2}
    assert quality.label_lines(docs.filter("doc_id = 3"), field).count() == 2
    only = quality.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.score_documents(docs, only).collect()} == {1.0}
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), field).count() == 0 == quality.drop_rejected(docs.limit(0), field).count()

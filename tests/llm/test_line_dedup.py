import random
import re
from collections import defaultdict

from vantloom.llm import line_dedup as L


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_gives_common_subsequences():
    rnd = random.Random(0)
    for _ in range(400):
        a, b = ([rnd.randint(0, 12) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) <= _lcs(a, b) and bool(pairs) == bool(set(a) & set(b))
    for _ in range(200):  # where every item is unique in both, the alignment is a longest one
        a, b = (rnd.sample(range(20), 10) for _ in range(2))
        assert len(L.patience(a, b)) <= _lcs(a, b)
    assert len(L.patience([1, 2, 3, 4], [9, 1, 2, 3, 4])) == 4


def _brute(rows):
    """(id, text) -> text after deletion, from the alignments with all earlier documents."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    items, holders = {}, defaultdict(list)
    for d in docs:
        worded = [(n, x, len(re.findall(r"[^ \t\n\x0b\f\r]+", x))) for n, x in enumerate(d[1].split("\n"))]
        items[d] = [(k, n, x, words) for k, (n, x, words) in enumerate(w for w in worded if w[2])]
        for line in {x[2] for x in items[d]}:
            holders[line].append(d)
    items = {d: [x for x in own if len(holders[x[2]]) > 1] for d, own in items.items()}
    found = {}
    for d in docs:
        gone = set()
        for other in {e for x in items[d] for e in holders[x[2]] if e < d}:
            gone |= set(L.common_blocks(items[d], items[other]))
        kept = "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in gone)
        found[d] = d[1] if not gone else kept if kept.strip() else ""
    return found


def _whole(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((r.doc_id, r.text) for r in L.dedup_lines(docs).collect())


def test_against_brute_force(spark):
    rnd = random.Random(7)
    lines = [" ".join(rnd.choice("abcdef") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 9))) for _ in range(60)] + ["", " "]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(30)] + [(3, rows[3][1]), (None, rows[3][1]), (400, None), (401, ""), (402, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'e' AS th", "7 AS line", "8 AS id", "9 AS _GONE", "10 AS _gone_id", "11 AS _lines", "12 AS _deleted")
    out = L.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__deleted"]
    found = out.collect()
    assert len(found) == len(rows)
    want = _brute(rows)
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].add(r.text)
        assert r[2:9] == ("e", 7, 8, 9, 10, 11, 12)
    for (i, t), text in want.items():
        assert got[i] == {text}, i
    assert got[None] == {rows[3][1]} and got[400] == {None}
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_a_document_added_undoes_no_deletion(spark):
    x, y = "one two three", "four five six"
    rows = [(1, f"{x}\nfoo\n{y}"), (2, f"{x}\n{y}"), (3, f"{x}\nbar\n{y}"), (4, f"{x}\n{y}")]
    assert dict(_whole(spark, rows))[4] == "" and dict(_whole(spark, [rows[1], rows[3]]))[4] == ""


def test_long_passage_goes_from_later_documents_only(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"Own words of document {k} stand first\n{passage}\nand last {k}") for k in range(40)] + [(99, "Nothing in common here at all")]
    found = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[0] == rows[0][1] and found[99] == rows[-1][1]
    assert all(found[k] == f"Own words of document {k} stand first\nand last {k}" for k in range(1, 40))


def test_short_common_lines_stay(spark):
    rows = [(1, "Of.\nA first text of its own"), (2, "Of.\nA second text of its own")]
    found = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == dict(rows)


def test_all_earlier_documents_are_met(spark):
    rnd = random.Random(7)
    lines = [" ".join(rnd.choice("abcdef") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 9))) for _ in range(60)] + ["", " "]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))) for k in range(150)]
    few = [" ".join("pqrs"[k] + str(j) for j in range(2 + k)) for k in range(4)]  # every line hot, many repeats
    rows += [(1000 + k, "\n".join(rnd.choice(few) for _ in range(rnd.randint(1, 6)))) for k in range(150)]
    want = _brute(rows)
    assert _whole(spark, rows) == sorted((i, want[i, t]) for i, t in rows)


def test_crossing_passages_and_hot_short_lines(spark):
    p, q = "one two three four five", "six seven eight nine ten"
    crossed = [(1, f"{q}\n{p}")] + [(k, f"{p}\n{q}") for k in range(2, 41)]
    assert [t for _, t in _whole(spark, crossed)][2:] == [""] * 38
    short = ["a b", "c d", "e f"]
    apart = [(k, "\nown words here\n".join(short)) for k in range(20)]
    together = [(k, "\n".join(short)) for k in range(100, 120)]
    found = dict(_whole(spark, apart + together))
    assert found[100] == "\n".join(short) and all(found[k] == "" for k in range(101, 120))


def test_repeated_windows_meet_the_first_that_repeats_them(spark):
    p = "one two three four five"
    rows = [(k, f"{p}\nown {k}") for k in range(60)] + [(100 + k, f"{p}\nmine {k}\n{p}") for k in range(40)]
    want = _brute(rows)
    assert _whole(spark, rows) == sorted((i, want[i, t]) for i, t in rows)


def test_ranks_over_many_ranges(spark):
    rows = [(k % 3 if k % 7 else 0, k * 7919 % 1000, k) for k in range(600)]
    held = spark.createDataFrame(rows, "w bigint, id bigint, th bigint").repartition(5)
    got = {(r.w, r.id, r.th): r["rank"] for r in L._ranked(held).collect()}
    for w in range(3):
        assert [got[x] for x in sorted(x for x in rows if x[0] == w)] == list(range(1, sum(x[0] == w for x in rows) + 1))


def test_windows_cover_every_block():
    rnd = random.Random(3)
    for _ in range(500):
        ordinals = sorted(rnd.sample(range(12), rnd.randint(1, 10)))
        items = [(o, o, 0, rnd.randint(1, 7)) for o in ordinals]
        found = L._windows(items)
        assert all(sum(x[3] for x in items[i:k]) >= L.BLOCK_WORDS and items[k - 1][0] - items[i][0] == k - 1 - i for i, k in found)
        for i in range(len(items)):
            for k in range(i + 1, len(items) + 1):
                if items[k - 1][0] - items[i][0] == k - 1 - i and sum(x[3] for x in items[i:k]) >= L.BLOCK_WORDS:
                    assert {j for a, b in found if i <= a and b <= k for j in range(a, b)} == set(range(i, k))


def test_the_query_meets_all_earlier_documents(spark, tmp_path):
    p, q = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{q}\n{p}")] + [(k, f"{p}\n{q}") for k in range(2, 41)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.text for r in L.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert all(found[k] == "" for k in range(3, 41))


def test_the_stage_meets_all_earlier_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = _brute(rows)
    found = corpus_pipeline.remove_lines(spark, docs, sf).select("doc_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted((i, want[i, t]) for i, t in rows if want[i, t] or not t)

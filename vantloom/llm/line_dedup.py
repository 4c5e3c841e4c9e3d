"""Line dedup by pairwise alignment.

Lines are hashed, and every line that two documents or more hold is shared. Linked documents are
aligned with patience diff over their shared lines, and runs of aligned lines with
``BLOCK_WORDS`` words or more are deleted from the later one.

Deletions are those of the alignments with all earlier documents. Documents of equal shared lines
fold to the first of them. The shortest runs of ``BLOCK_WORDS`` words are windows; whatever an
alignment deletes lies in windows that both documents hold. So each document meets the first
holder of its windows, and for those windows that still have a line left the next holders, four
times as many each round, until every line is deleted or every earlier holder has been met.

Documents are ordered by (id, text hash); lines without a word are never shared and don't break
a run. Equality of lines is equality of their 64-bit hashes and word counts.

Defined results: rows with null id or null text pass unchanged and lend no lines; a document
whose every worded line is deleted gets the empty text; rows with equal id and text are one
document and fare alike; an empty table gives an empty table; extra columns are kept, and an added
column whose name is taken gets one more underscore; a very long text is one row of hashed lines.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantloom.llm.batches import fresh, map_rows
from vantloom.runtime import checkpoint, shuffle_width, spread, table

BLOCK_WORDS = 5
#: Holders that a window's documents meet are this many times more each round.
WIDEN = 4


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (ordered by the first) that rises in the second."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        if at:
            back[k] = ends[at - 1]
        if at == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences.

    Equal heads and tails align; between them, items that are unique in both and rise in both
    are anchors, and the gaps between anchors are aligned the same way. A gap without anchors
    takes each item's next occurrence, from left to right.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, i_end, j, j_end = gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        where: dict = {}
        for k in range(j, j_end):
            where[b[k]] = -1 if b[k] in where else k
        seen: dict = {}
        for k in range(i, i_end):
            seen[a[k]] = -1 if a[k] in seen else k
        anchors = _increasing([(k, where[x]) for x, k in seen.items() if k >= 0 and where.get(x, -1) >= 0])
        if anchors:
            found += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
            continue
        places: dict = {}
        for k in range(j, j_end):
            places.setdefault(b[k], []).append(k)
        for k in range(i, i_end):
            spots = places.get(a[k])
            if spots and (at := bisect_left(spots, j)) < len(spots):
                found.append((k, spots[at]))
                j = spots[at] + 1
    return sorted(found)


def common_blocks(later: list[tuple], earlier: list[tuple], block_words: int = BLOCK_WORDS) -> list[int]:
    """Line numbers of ``later`` to delete. Items are (ordinal, line number, hash, words)."""
    gone: list[int] = []
    run: list[tuple] = []
    words, last = 0, None
    pairs = patience([(x[2], x[3]) for x in later], [(x[2], x[3]) for x in earlier])
    for i, j in [*pairs, (None, None)]:
        here = None if i is None else (later[i][0], earlier[j][0])
        if last is None or here is None or here != (last[0] + 1, last[1] + 1):
            if words >= block_words:
                gone += [x[1] for x in run]
            run, words = [], 0
        if i is not None:
            run.append(later[i])
            words += later[i][3]
        last = here
    return gone


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text hash, ordinal among worded lines, line number, hash, words) of every worded line."""
    x = F.col(text_col)
    listed = docs.filter(F.col(id_col).isNotNull() & x.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(x).alias("th"), F.split(x, "\n").alias("lines"))
    hashed = listed.select("id", "th", F.transform("lines", lambda s, i: F.struct(i.alias("line"), F.xxhash64(s).alias("h"), F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))).alias("words"))).alias("lines"))
    worded = hashed.select("id", "th", F.posexplode(F.filter("lines", lambda s: s["words"] > 0)).alias("ordinal", "s"))
    return worded.select("id", "th", "ordinal", "s.line", "s.h", "s.words")


def _key(prefix: str = "") -> Column:
    return F.struct(F.col("id").alias(f"{prefix}id"), F.col("th").alias(f"{prefix}th"))


def _windows(items: list[tuple], block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(from, to) of the shortest runs of adjacent items with ``block_words`` words, from each item on and up to each.

    A run of adjacent items with so many words is the union of the windows within it.
    """
    found: set[tuple[int, int]] = set()
    start = 0
    for end in range(1, len(items) + 1):
        if end < len(items) and items[end][0] == items[end - 1][0] + 1:
            continue
        words, i = 0, start
        for k in range(start, end):
            words += items[k][3]
            while words >= block_words:
                found.add((i, k + 1))
                words, i = words - items[i][3], i + 1
        words, k = 0, end
        for i in range(end - 1, start - 1, -1):
            words += items[i][3]
            while words >= block_words:
                found.add((i, k))
                words, k = words - items[k - 1][3], k - 1
        start = end
    return sorted(found)


def _rows(items) -> list[tuple]:
    return [(s["ordinal"], s["line"], s["h"], s["words"]) for s in items]


def _digest(items: list[tuple]) -> bytes:
    """Of hashes, word counts and where items are adjacent."""
    numbers = np.array([(h, words, k > 0 and ordinal == items[k - 1][0] + 1) for k, (ordinal, _, h, words) in enumerate(items)], np.int64)
    return xxhash.xxh128_digest(numbers.tobytes())


def _window_hashes(items: list[tuple], gone: set[int], block_words: int, repeats: bool) -> list[int]:
    """Of the windows that have a line outside ``gone``; with ``repeats`` also one for each further occurrence.

    A document with a window twice thereby meets the first holder that has it twice, too.
    """
    times: dict[bytes, int] = {}
    for i, k in _windows(items, block_words):
        if any(x[1] not in gone for x in items[i:k]):
            found = _digest(items[i:k])
            times[found] = times.get(found, 0) + 1
    out = [x[:8] for x in times]
    if repeats:
        out += [xxhash.xxh64_digest(x + n.to_bytes(8, "little")) for x, most in times.items() for n in range(1, most)]
    return [int.from_bytes(x, "little", signed=True) for x in out]


def _every_partner(listed: DataFrame, kind: str, block_words: int) -> DataFrame:
    """(id, th, gone array<int>) from the alignments with all earlier documents."""
    key = f"id {kind}, th bigint"
    shapes = checkpoint(map_rows(listed, lambda: lambda ids, hashes, items: (ids, hashes, [_digest(_rows(x)) for x in items]), f"{key}, shape binary"))
    firsts = checkpoint(shapes.groupBy("shape").agg(F.min(_key()).alias("first")))
    placed = shapes.join(firsts, "shape").withColumn("copy", _key() != F.col("first")).select("id", "th", "copy")
    placed = checkpoint(listed.join(placed, ["id", "th"]))
    heads = placed.filter("not copy").select("id", "th", "items")

    def align():
        def fn(ids, hashes, later, earlier):
            return ids, hashes, [common_blocks(_rows(a), _rows(b), block_words) for a, b in zip(later, earlier)]

        return fn

    def windows(df: DataFrame, repeats: bool = False) -> DataFrame:
        def left():
            def fn(ids, hashes, items, gone):
                return ids, hashes, [_window_hashes(_rows(x), set(g or ()), block_words, repeats) for x, g in zip(items, gone)]

            return fn

        return map_rows(df, left, f"{key}, w array<bigint>").select("id", "th", F.explode(F.array_distinct("w")).alias("w"))

    # A copy's alignment with its head is whole, so no other one can add to it.
    own = placed.filter("copy").select("id", "th", "items", F.col("items").alias("same"))
    found = [map_rows(own, align, f"{key}, gone array<int>")]
    partner = heads.select(F.col("id").alias("other_id"), F.col("th").alias("other_th"), F.col("items").alias("other_items"))

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(partner, ["other_id", "other_th"]).join(heads, ["id", "th"]).select("id", "th", "items", "other_items")
        return checkpoint(map_rows(both, align, f"{key}, gone array<int>").filter(F.size("gone") > 0))

    def still_open(docs: DataFrame) -> DataFrame:
        so_far = functools.reduce(DataFrame.unionByName, found[1:]).groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        return windows(heads.join(docs, ["id", "th"]).join(so_far, ["id", "th"], "left").select("id", "th", "items", "gone"))

    held = checkpoint(windows(heads.withColumn("gone", F.array().cast("array<int>")), repeats=True))
    # Written first, as elsewhere: the first holder of a window comes from partial sums, not from ordering its holders.
    leading = checkpoint(held.groupBy("w").agg(F.min(_key()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    asked = checkpoint(held.join(leading, "w").filter(_key() != F.col("first")))
    found.append(aligned(asked.select("id", "th", F.col("first.id").alias("other_id"), F.col("first.th").alias("other_th")).distinct()))
    asked = checkpoint(still_open(asked.filter("n > 2").select("id", "th").distinct()).join(leading.filter("n > 2"), "w").filter(_key() != F.col("first")).select("id", "th", "w"))
    if not asked.isEmpty():
        ranked = _ranked(held.join(asked.select("w").distinct(), "w", "left_semi"))
        at = ranked.select("w", F.col("rank").alias("at"), F.col("id").alias("other_id"), F.col("th").alias("other_th"))
        low, high = 2, WIDEN + 1
        asked = checkpoint(asked.join(ranked, ["id", "th", "w"]).filter(F.col("rank") > low))
        while not asked.isEmpty():
            turns = asked.select("id", "th", "w", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("rank") - 1))).alias("at"))
            found.append(aligned(turns.join(at, ["w", "at"]).select("id", "th", "other_id", "other_th").distinct()))
            low, high = high + 1, high * WIDEN + 1
            more = asked.filter(F.col("rank") > low)
            asked = checkpoint(more.join(still_open(more.select("id", "th").distinct()), ["id", "th", "w"]))
    return functools.reduce(DataFrame.unionByName, found)


def _ranked(held: DataFrame) -> DataFrame:
    """``held`` with each holder's rank in its window, from 1; a window of any size is ranked by many tasks.

    Rows are dealt out by ranges of (w, id, th); a rank is a row's place in its range after what earlier ranges hold.
    """
    spark = held.sparkSession
    dealt = checkpoint(held.select("w", "id", "th").repartitionByRange(shuffle_width(spark), "w", "id", "th").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("w").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(dealt.groupBy("w", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("w", "part", "before"))
    place = F.row_number().over(Window.partitionBy("w", "part").orderBy("id", "th"))
    return checkpoint(dealt.withColumn("place", place).join(starts, ["w", "part"]).select("w", "id", "th", (F.col("before") + F.col("place")).cast("int").alias("rank")))


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, th, gone array<boolean>): which lines of which documents go; line numbers beyond the array stay."""
    kind = dict(docs.dtypes)[id_col]
    lines = checkpoint(_lines(spread(docs.select(id_col, text_col)), id_col, text_col))
    held = lines.groupBy("h", "words").agg(F.min(_key()).alias("first"), F.max(_key()).alias("final"), F.count(F.lit(1)).alias("n"))
    # Written first: a join of two fresh exchanges is one whose crowded lines can be split.
    common = checkpoint(held.filter("first <> final").select("h", "words", "first", "n"))
    shared = checkpoint(lines.join(common, ["h", "words"]).dropDuplicates(["id", "th", "ordinal"]))
    # Written before the joins for the same reason: one document may be the first of very many.
    listed = checkpoint(shared.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("ordinal", "line", "h", "words"))).alias("items")))
    found = _every_partner(listed, kind, block_words).filter(F.size("gone") > 0)
    joined = found.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    def mask():
        def one(numbers):
            out = [False] * (max(numbers) + 1)
            for k in numbers:
                out[k] = True
            return out

        return lambda ids, hashes, gone: (ids, hashes, [one(g) for g in gone])

    return map_rows(joined, mask, f"id {kind}, th bigint, gone array<boolean>")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the deletions made, and columns _lines and _deleted (counts of lines) added at the end."""
    lines, deleted, gone_id, gone_th, gone = fresh(docs.columns, "_lines", "_deleted", "_gone_id", "_gone_th", "_gone")
    marks = removals(docs, id_col=id_col, text_col=text_col, block_words=block_words).toDF(gone_id, gone_th, gone)
    x, mask = docs[text_col], F.col(gone)
    joined = docs.join(marks, (docs[id_col] == F.col(gone_id)) & (F.xxhash64(x) == F.col(gone_th)), "left")
    kept = F.array_join(F.filter(F.split(x, "\n"), lambda s, i: ~F.coalesce(F.get(mask, i), F.lit(False))), "\n")
    kept = F.when(mask.isNull(), x).when(kept.rlike(r"\S"), kept).otherwise(F.lit(""))
    columns = [kept.alias(c) if c == text_col else docs[c] for c in docs.columns]
    total = F.coalesce(F.size(F.split(x, "\n")), F.lit(0)).cast("bigint")
    removed = F.when(mask.isNull(), 0).otherwise(F.size(F.filter(mask, lambda g: g))).cast("bigint")
    return joined.select(*columns, total.alias(lines), removed.alias(deleted))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), "text")

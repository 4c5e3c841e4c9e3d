"""Exact top-k by inner product over a bit-sliced index.

Every attribute (vector component, quantised to an integer) of a block of rows is stored as
bitmaps, one for each of its ``TOP_SLICES`` most significant bits above the block's own minimum.
For a query, weighted slices are added with bitmap arithmetic: the query's component is written
in signed digits, each digit shifts an attribute's slices, and carry-save adders fold all the
shifted bitmaps of one weight into a bit-sliced sum. The k best lower-slice-free sums come from
walking that sum from its most significant slice downward. The bits left out of the slices are
worth no more than a bound known for each query and block, so the rows within the bound of the
k-th sum are the boundary rows; they are resolved by their exact integer inner products.

Rows are dealt into blocks of bounded size and queries into groups of bounded size; each block
meets each group once, under a plain equi-join key. Each pair keeps k rows a query at most. Rows
equal in id and vector are folded first, to as many as k ranks can hold, so no repeated row crowds
a block.

Bitmap sums must stay in 64 bits. Vectors with a component beyond ``MAX_COMPONENT`` in size, and
queries with one, are scored apart: components are split into limbs of ``LIMB`` bits, products of
limbs are added in 64 bits, and carries make digits that compare exactly.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows
without an id, take no part; only vectors of equal length are compared; a query meets no row of
its own id; repeated query ids are one query (the smallest vector stands); repeated candidate
rows are ranked each; ties go to the smaller id; ids are of any type that orders; components
beyond a long after quantisation are the nearest long, and so is a score beyond one, though ranks
go by the exact score; an empty table gives an empty table; other columns are not read, whatever
their names; vectors may be long, as long as a block of them fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantloom.runtime import checkpoint, ship, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Rows of a block, and queries of a group.
BLOCK_ROWS = 16_384
GROUP_QUERIES = 16_384
TOP_SLICES = 6
#: Queries that one pass of bitmap arithmetic handles.
PASS_QUERIES = 32
MAX_COMPONENT = 1 << 20
LIMB = 21


class Slices:
    """Bit-sliced index of one block: bitmaps [attribute, slice, word] and the exact rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: int = TOP_SLICES):
        self.ids, self.rows = ids, rows
        self.low = rows.min(axis=0)
        above = rows - self.low
        self.bits = max(1, int(above.max()).bit_length())
        self.cut = max(0, self.bits - top)
        words = -(-len(rows) // 64)
        held = np.zeros((words * 64, rows.shape[1]), np.int64)
        held[: len(rows)] = above >> self.cut
        held = np.ascontiguousarray(held.T)
        self.maps = np.stack([np.packbits((held >> b & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for b in range(self.bits - self.cut)], axis=1)
        self.valid = np.packbits(np.arange(words * 64) < len(rows), bitorder="little").view(np.uint64)


def signed_digits(values: np.ndarray) -> list[np.ndarray]:
    """Non-adjacent form: digits[w] in {-1, 0, 1}, sum of digits[w] << w equals the values."""
    left, out = values.astype(np.int64), []
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        out.append(digit)
        left = (left - digit) >> 1
    return out


def _columns(index: Slices, queries: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Bitmaps of each weight as [query, word] arrays.

    A negative digit adds the complement of its slice, which is the slice's value subtracted
    plus one unit of the weight. Those units are the same for every row of a query, so sums
    stay comparable and are never negative.
    """
    columns: dict[int, list[np.ndarray]] = {}
    ones = ~np.uint64(0)
    for w, digit in enumerate(signed_digits(queries)):
        for d in np.flatnonzero(digit.any(axis=0)):
            use = np.where(digit[:, d] != 0, ones, np.uint64(0))[:, None]
            flip = np.where(digit[:, d] < 0, ones, np.uint64(0))[:, None]
            for b in range(index.maps.shape[1]):
                columns.setdefault(w + b, []).append((index.maps[d, b][None] ^ flip) & use)
    return columns


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Fold bitmaps of each weight with carry-save adders; one bitmap for each weight is left."""
    out, weight = [], 0
    while columns:
        stack = columns.pop(weight, [])
        carries = columns.setdefault(weight + 1, []) if len(stack) > 1 else []
        while len(stack) > 2:
            a, b, c = stack.pop(), stack.pop(), stack.pop()
            half = a ^ b
            stack.insert(0, half ^ c)
            carries.append((a & b) | (half & c))
        if len(stack) == 2:
            a, b = stack
            stack = [a ^ b]
            carries.append(a & b)
        out.append(stack[0] if stack else None)
        weight += 1
    return out


def _count(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)


def kth_sum(sums: list[np.ndarray], live: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th largest sliced sum among the ``live`` rows of each query, slice by slice from the top."""
    equal, found, value = live.copy(), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    for weight in range(len(sums) - 1, -1, -1):
        if sums[weight] is None:
            continue
        ones = equal & sums[weight]
        n = _count(ones)
        take = found + n >= k  # the k-th row has this bit set
        equal = np.where(take[:, None], ones, equal & ~sums[weight])
        value += take.astype(np.int64) << weight
        found += np.where(take, 0, n)
    return value


def at_least(sums: list[np.ndarray], live: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bitmap of the ``live`` rows whose sliced sum is ``value`` or more."""
    equal, above = live.copy(), np.zeros_like(live)
    for weight in range(max(len(sums), int(value.max(initial=0)).bit_length()) - 1, -1, -1):
        bit = (value >> weight & 1).astype(bool)[:, None]
        here = sums[weight] if weight < len(sums) and sums[weight] is not None else np.zeros_like(live)
        above |= np.where(bit, np.uint64(0), equal & here)
        equal &= np.where(bit, here, ~here)
    return above | equal


def top_rows(index: Slices, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
    """(query id, row id, score): the k best rows of the block for every query, exactly."""
    for at in range(0, len(queries), PASS_QUERIES):
        q, qid = queries[at : at + PASS_QUERIES], query_ids[at : at + PASS_QUERIES]
        live = np.repeat(index.valid[None], len(q), axis=0)
        # Rows of the query's own id are no candidates.
        order = np.argsort(index.ids, kind="stable")
        lo, hi = np.searchsorted(index.ids, qid, "left", sorter=order), np.searchsorted(index.ids, qid, "right", sorter=order)
        for j in np.flatnonzero(hi > lo):
            for r in order[lo[j] : hi[j]]:
                live[j, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sums = add_slices(_columns(index, q))
        slack = ((1 << index.cut) - 1) * np.abs(q).sum(axis=1)  # what the left-out bits can move a score
        want = np.minimum(k, _count(live))
        bar = kth_sum(sums, live, want) - (slack >> index.cut)
        chosen = at_least(sums, live, np.maximum(bar, 0))
        who, row = np.nonzero(np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little"))
        # Boundary rows, a bounded number at a time.
        scores = np.concatenate([np.einsum("ij,ij->i", q[who[b : b + 65_536]], index.rows[row[b : b + 65_536]]) for b in range(0, len(who), 65_536)] or [np.empty(0, np.int64)])
        ids = index.ids[row]
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        best = rank < k
        yield qid[who[best]], ids[best], scores[best]


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Digits of LIMB bits, the lowest first; the last one carries the sign."""
    low = (1 << LIMB) - 1
    return [values & low, values >> LIMB & low, values >> 2 * LIMB & low, values >> 3 * LIMB]


def wide_products(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Inner products of any longs as digits [query, row] of LIMB bits, the highest (signed) first."""
    ours, theirs = _limbs(queries), _limbs(rows)
    sums = [np.zeros((len(queries), len(rows)), np.int64) for _ in range(len(ours) + len(theirs) - 1)]
    for i, a in enumerate(ours):
        for j, b in enumerate(theirs):
            if a.any() and b.any():
                sums[i + j] += a @ b.T
    for k in range(len(sums) - 1):
        sums[k + 1] += sums[k] >> LIMB
        sums[k] &= (1 << LIMB) - 1
    return sums[::-1]


def _as_long(digits: list[np.ndarray]) -> np.ndarray:
    found = []
    for parts in zip(*(d.tolist() for d in digits)):
        value = 0
        for part in parts:
            value = (value << LIMB) + part
        found.append(max(-(1 << 63), min((1 << 63) - 1, value)))
    return np.array(found, np.int64)


def wide_top_rows(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
    """(query id, row id, score, digits [row, digit]) as ``top_rows``, for vectors of any longs."""
    step = max(1, 1_000_000 // max(1, len(rows)))
    for at in range(0, len(queries), step):
        qid = query_ids[at : at + step]
        digits = wide_products(queries[at : at + step], rows)
        who, row = np.nonzero(qid[:, None] != ids[None])
        flat = [d[who, row] for d in digits]
        order = np.lexsort((ids[row], *(-d for d in flat[::-1]), who))
        who, row = who[order], row[order]
        best = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
        chosen = [d[order][best] for d in flat]
        yield qid[who[best]], ids[row[best]], _as_long(chosen), np.stack(chosen, axis=1)


def _digits(scores: np.ndarray) -> np.ndarray:
    """Digits of longs, as those of ``wide_products``."""
    low = (1 << LIMB) - 1
    sign = scores >> 63
    return np.stack([sign, sign & low, sign & low, scores >> 3 * LIMB & low, scores >> 2 * LIMB & low, scores >> LIMB & low, scores & low], axis=1)


def best_rows(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
    """(query id, row id, score, digits): sliced where sums stay in 64 bits, by limbs elsewhere; k each."""

    def within(values: np.ndarray) -> np.ndarray:
        return ((values <= MAX_COMPONENT) & (values >= -MAX_COMPONENT)).all(axis=1)

    plain_rows, plain_queries = within(rows), within(queries)
    if plain_rows.any() and plain_queries.any():
        for qid, rid, score in top_rows(Slices(ids[plain_rows], rows[plain_rows]), query_ids[plain_queries], queries[plain_queries], k):
            yield qid, rid, score, _digits(score)
    if not plain_rows.all() and plain_queries.any():
        yield from wide_top_rows(ids[~plain_rows], rows[~plain_rows], query_ids[plain_queries], queries[plain_queries], k)
    if not plain_queries.all():
        yield from wide_top_rows(ids, rows, query_ids[~plain_queries], queries[~plain_queries], k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int = K, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, id, score) by integer inner product; ``vectors`` and ``queries`` hold arrays of bigint."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]

    def usable(df: DataFrame) -> DataFrame:
        named = df.select(F.col(id_col).cast(kind).alias("id"), F.col(vector_col).alias("v"))
        return named.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    rows = checkpoint(usable(vectors).groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")))
    asked = usable(queries).groupBy("id").agg(F.min(F.struct(F.size("v").alias("dim"), "v")).alias("s")).select("id", "s.v")
    asked = checkpoint(asked)
    n_blocks = max(1, -(-rows.count() // block_rows))
    n_groups = max(1, -(-asked.count() // group_queries))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        # One row in each block or group of its own, once for every group or block of the others.
        spread = df.withColumn("dim", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n_own)))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))

    left = dealt(rows, "block", n_blocks, "part", n_groups).groupBy("dim", "block", "part")
    right = dealt(asked, "part", n_groups, "block", n_blocks).groupBy("dim", "block", "part")
    width = len(_digits(np.zeros(1, np.int64))[0])

    def search(key, own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            empty = own.schema.field("id").type
            return pa.table({"query_id": pa.array([], empty), "id": pa.array([], empty), "score": pa.array([], pa.int64()), "digits": pa.array([], pa.list_(pa.int64()))})
        theirs, ours = own.column("id").to_pylist(), other.column("id").to_pylist()
        known = sorted({*theirs, *ours})
        number = {x: i for i, x in enumerate(known)}  # orders and compares as the ids do
        copies = own.column("n").to_numpy()
        ids = np.repeat(np.array([number[x] for x in theirs], np.int64), copies)
        matrix = np.repeat(_matrix(own.column("v")), copies, axis=0)
        found = list(best_rows(ids, matrix, np.array([number[x] for x in ours], np.int64), _matrix(other.column("v")), k))
        qid, rid, score, digits = (np.concatenate(x) if found else np.empty((0, width) if i == 3 else 0, np.int64) for i, x in enumerate(zip(*found) if found else [()] * 4))
        names = pa.array(known, own.schema.field("id").type)
        offsets = pa.array(np.arange(len(digits) + 1, dtype=np.int32) * width)
        return pa.table({"query_id": names.take(pa.array(qid)), "id": names.take(pa.array(rid)), "score": pa.array(score), "digits": pa.ListArray.from_arrays(offsets, pa.array(digits.ravel()))})

    ship(spark)
    best = left.cogroup(right).applyInArrow(search, f"query_id {kind}, id {kind}, score bigint, digits array<bigint>")
    order = Window.partitionBy("query_id").orderBy(F.desc("digits"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def quantised(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """floor(scale * x) of every component; vectors with a null or non-finite component are dropped."""
    x = F.col(vector_col)
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.filter(x.isNotNull() & (F.size(x) > 0) & finite).select(id_col, F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

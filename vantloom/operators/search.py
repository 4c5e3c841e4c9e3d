"""Exact vector search over a DataFrame of (id, vector, metadata).

One query vector is a handful of literals: scores unroll into codegen arithmetic, filters go
before the top k and down to the scan, and ``orderBy.limit`` plans as TakeOrderedAndProject.
Many queries are a k-NN join: a matrix product in Arrow batches with a top k for each batch,
merged by a ranked window. Query sets within ``BROADCAST_BYTES`` are broadcast; larger ones are
dealt into blocks that meet blocks of rows under an equi-join key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantloom.functions import kernels
from vantloom.plans.predicates import Composite, Property, compile_condition
from vantloom.runtime import ship

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 65_536
GROUP_QUERIES = 4_096
MANHATTAN_CELLS = 4_000_000


@dataclass(frozen=True)
class SearchOptions:
    """``compat`` keeps the order top k, ids, threshold, sort, filter; else filters come first."""

    limit: int = 10
    metric: str = "cosine"
    score_threshold: float | None = None
    sort: str = "score_desc"  # score_desc, score_asc, id_asc, id_desc, or a metadata field after "field:"
    filter: Property | Composite | None = None
    pre_filter_ids: tuple = ()
    ids: tuple = ()
    from_vector_id: Any = None
    rerank_field: str | None = None
    include_metadata: bool = True
    include_vectors: bool = False
    compat: bool = False

    def validate(self) -> None:
        if self.limit < 1:
            raise ValueError("limit must be 1 or more")
        if self.score_threshold is not None and not 0 <= self.score_threshold <= 1:
            raise ValueError("score_threshold must lie within 0 and 1")


@dataclass
class Collection:
    """A named set of vectors. Every change gives a new collection; the DataFrame is never mutated."""

    name: str
    dimension: int
    df: DataFrame
    metric: str = "cosine"
    id_col: str = "id"
    vector_col: str = "vector"
    metadata_col: str = "metadata"
    schema: dict[str, str] = field(default_factory=dict)

    def with_rows(self, df: DataFrame) -> Collection:
        return Collection(self.name, self.dimension, df, self.metric, self.id_col, self.vector_col, self.metadata_col, self.schema)

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` with an error raised for vectors of another dimension."""
        v = F.col(self.vector_col)
        wrong = F.raise_error(F.concat(F.lit(f"dimension must be {self.dimension}, not "), F.size(v).cast("string")))
        return df.withColumn(self.vector_col, F.when(F.size(v) == self.dimension, v).otherwise(wrong.cast(df.schema[self.vector_col].dataType)))

    def upsert(self, rows: DataFrame) -> Collection:
        """Add rows; those of a known id take its place."""
        return self.with_rows(self.df.join(rows.select(self.id_col), self.id_col, "left_anti").unionByName(self.checked(rows), allowMissingColumns=True))

    def update(self, rows: DataFrame) -> Collection:
        """Replace rows of known ids; others are passed over."""
        return self.upsert(rows.join(self.df.select(self.id_col), self.id_col, "left_semi"))

    def delete(self, ids: DataFrame) -> Collection:
        return self.with_rows(self.df.join(ids.select(self.id_col), self.id_col, "left_anti"))

    def get(self, ids: list) -> DataFrame:
        return self.df.filter(F.col(self.id_col).isin(ids))

    def count(self) -> int:
        return self.df.count()

    def stats(self) -> DataFrame:
        n = F.size(self.vector_col)
        return self.df.agg(F.count(F.lit(1)).alias("vectors"), F.avg(n).alias("avg_dim"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"))

    def search(self, vector: list[float] | None = None, options: SearchOptions | None = None) -> DataFrame:
        return search(self, vector, options or SearchOptions(metric=self.metric))


def exact_knn(df: DataFrame, vector: list[float], k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance): the k nearest rows, ties by id."""
    return df.select(id_col, kernels.distance_with(F.col(vector_col), vector, metric).alias("distance")).orderBy("distance", id_col).limit(k)


def top_by_similarity(df: DataFrame, vector: list[float], k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score): the k rows of the highest collection score, ties by id."""
    return df.select(id_col, kernels.score_with(F.col(vector_col), vector, metric).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def vector_of(c: Collection, ident: Any) -> list[float]:
    """The stored vector of one id; a missing id is an error."""
    found = c.df.filter(F.col(c.id_col) == ident).select(c.vector_col).head(1)
    if not found:
        raise KeyError(ident)
    return [float(x) for x in found[0][0]]


def _ordered(df: DataFrame, c: Collection, sort: str) -> list[Column]:
    plain = {"score_desc": [F.desc("score"), F.asc(c.id_col)], "score_asc": [F.asc("score"), F.asc(c.id_col)], "id_asc": [F.asc(c.id_col)], "id_desc": [F.desc(c.id_col)]}
    if sort in plain:
        return plain[sort]
    name = sort.removeprefix("field:")
    # Fields compare by their JSON text; a missing one comes first.
    return [F.asc_nulls_first(F.get_json_object(c.metadata_col, f"$.{name}")), F.asc(c.id_col)]


def search(c: Collection, vector: list[float] | None, o: SearchOptions) -> DataFrame:
    """Rows (id, score[, metadata][, vector]) by the options; scores are similarities for every size."""
    o.validate()
    if vector is not None and len(vector) != c.dimension:
        raise ValueError(f"dimension must be {c.dimension}, not {len(vector)}")
    if o.from_vector_id is not None:
        vector = vector_of(c, o.from_vector_id)
    df = c.df
    matches = compile_condition(F.coalesce(F.col(c.metadata_col), F.lit("{}")), o.filter) if o.filter is not None else None
    score = kernels.score_with(F.col(c.vector_col), vector, o.metric) if vector is not None else F.lit(1.0)
    if o.ids:
        df = df.filter(F.col(c.id_col).isin(list(o.ids)))
        df = (df if matches is None else df.filter(matches)).withColumn("score", score)
        return _projected(df.orderBy(F.desc("score"), c.id_col), c, o)
    if vector is None:
        raise ValueError("a vector, ids or from_vector_id is needed")
    steps = {
        "ids": lambda d: d.filter(F.col(c.id_col).isin(list(o.pre_filter_ids))) if o.pre_filter_ids else d,
        "threshold": lambda d: d.filter(F.col("score") >= o.score_threshold) if o.score_threshold is not None else d,
        "filter": lambda d: d.filter(matches) if matches is not None else d,
    }
    top = lambda d: d.orderBy(F.desc("score"), c.id_col).limit(o.limit)
    df = df.withColumn("score", score)
    if o.compat:
        df = top(df)
        for name in ("ids", "threshold", "filter"):
            df = steps[name](df)
    else:
        for name in ("ids", "filter", "threshold"):
            df = steps[name](df)
        df = top(df)
    if o.rerank_field:
        boost = F.coalesce(F.get_json_object(c.metadata_col, f"$.{o.rerank_field}").try_cast("double"), F.lit(1.0))
        return _projected(df.withColumn("score", F.col("score") * boost).orderBy(F.desc("score"), c.id_col), c, o)
    return _projected(df.orderBy(*_ordered(df, c, o.sort)), c, o)


def _projected(df: DataFrame, c: Collection, o: SearchOptions) -> DataFrame:
    return df.select(c.id_col, "score", *([c.metadata_col] if o.include_metadata else []), *([c.vector_col] if o.include_vectors else []))


def refine_results(results: DataFrame, o: SearchOptions, *, id_col: str = "id", metadata_col: str = "metadata") -> DataFrame:
    """Options applied to rows that carry a score: threshold, filter, ids, sort, limit."""
    if o.score_threshold is not None:
        results = results.filter(F.col("score") >= o.score_threshold)
    if o.filter is not None:
        results = results.filter(compile_condition(F.coalesce(F.col(metadata_col), F.lit("{}")), o.filter))
    if o.ids:
        results = results.filter(F.col(id_col).isin(list(o.ids)))
    c = Collection("", 0, results, id_col=id_col, metadata_col=metadata_col)
    return results.orderBy(*_ordered(results, c, o.sort)).limit(o.limit)


def range_search(df: DataFrame, vector: list[float], radius: float, metric: str = "euclidean", max_elements: int | None = None, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance) of every row within the radius, ascending; exact, no candidate limit."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    found = df.select(id_col, kernels.distance_with(F.col(vector_col), vector, metric).alias("distance"))
    found = found.filter((F.col("distance") <= radius) & F.lit(radius > 0)).orderBy("distance", id_col)
    return found if max_elements is None else found.limit(max_elements)


def dynamic_range_search(df: DataFrame, vector: list[float], wanted: int, metric: str = "euclidean", *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance) of the ``wanted`` nearest rows: the radius that holds so many, found by one top k."""
    return exact_knn(df, vector, wanted, metric, id_col=id_col, vector_col=vector_col)


def radius_density(df: DataFrame, vector: list[float], radius: float, metric: str = "euclidean", *, vector_col: str = "vector") -> DataFrame:
    """One row: the share of rows within the radius."""
    inside = kernels.distance_with(F.col(vector_col), vector, metric) <= radius
    return df.agg((F.count_if(inside) / F.count(F.lit(1))).alias("density"))


def filter_after_search(df: DataFrame, vector: list[float], k: int, equals: dict[str, str], metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", metadata_col: str = "metadata", compat: bool = False) -> DataFrame:
    """Search with AND of string equalities on metadata: before the top k, or after it with ``compat``."""
    keep = F.lit(True)
    for name, value in equals.items():
        keep = keep & F.coalesce(F.get_json_object(metadata_col, f"$.{name}") == value, F.lit(False))
    df = df.withColumn("distance", kernels.distance_with(F.col(vector_col), vector, metric))
    top = lambda d: d.orderBy("distance", id_col).limit(k)
    return (top(df).filter(keep) if compat else top(df.filter(keep))).select(id_col, "distance", metadata_col)


# -- Many queries ---------------------------------------------------------------------------


def score_matrix(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Similarity (larger is closer) of every query and row."""
    if metric == "dot":
        return q @ m.T
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
        return np.divide(q @ m.T, norms, out=np.zeros((len(q), len(m))), where=norms != 0)
    if metric in ("euclidean", "manhattan"):
        out = np.empty((len(q), len(m)))
        step = max(1, MANHATTAN_CELLS // max(1, m.size))
        for at in range(0, len(q), step):  # differences, not expanded squares: no cancellation
            d = q[at : at + step, None] - m[None]
            out[at : at + step] = -np.sqrt((d * d).sum(axis=2)) if metric == "euclidean" else -np.abs(d).sum(axis=2)
        return out
    if metric == "jaccard":
        a, b = (q > 0.5).astype(float), (m > 0.5).astype(float)
        both = a @ b.T
        any_ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - both
        return np.divide(both, any_, out=np.zeros_like(both), where=any_ != 0)
    raise ValueError(f"unknown metric {metric}")


def _dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, metric: str, k: int | None, floor: float | None, digits: int | None) -> pa.RecordBatch:
    s = score_matrix(q, m, metric)
    if digits is not None:
        s = np.round(s, digits)
    if k is not None and k < len(ids):
        kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        who, row = np.nonzero(s >= kth[:, None])
    elif floor is not None:
        who, row = np.nonzero(s >= floor)
    else:
        who, row = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((ids[row], -s[who, row], who))
    who, row = who[order], row[order]
    if k is not None:
        kept = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
        who, row = who[kept], row[kept]
    return pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(ids[row]), pa.array(s[who, row])], names=["query_id", "id", "score"])


def _joined(queries: DataFrame, rows: DataFrame, metric: str, k: int | None, floor: float | None, digits: int | None, id_col: str, vector_col: str, broadcast_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    kind = dict(rows.dtypes)[id_col]
    schema = f"query_id {dict(queries.dtypes)[id_col]}, id {kind}, score double"
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    asked, held = queries.filter(usable).select(id_col, vector_col), rows.filter(usable).select(id_col, vector_col)
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vector_col)), F.lit(0))).first()
    if size[1] * 8 <= broadcast_bytes:
        t = asked.toArrow() if size[0] else None
        sent = spark.sparkContext.broadcast((t.column(0).to_numpy(), _dense(t.column(1))) if size[0] else (np.empty(0), np.empty((0, 1))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            for b in batches:
                if b.num_rows and len(qids):
                    m = _dense(b.column(1))
                    for at in range(0, len(qids), GROUP_QUERIES):
                        yield _best(qids[at : at + GROUP_QUERIES], q[at : at + GROUP_QUERIES], b.column(0).to_numpy(zero_copy_only=False), m, metric, k, floor, digits)

        return held.mapInArrow(scan, schema)
    n_blocks, n_groups = max(1, -(-held.count() // BLOCK_ROWS)), max(1, -(-size[0] // GROUP_QUERIES))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint")))).groupBy("block", "part")

    def meet(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return pa.table({"query_id": other.column(id_col).slice(0, 0), "id": own.column(id_col).slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([_best(other.column(id_col).to_numpy(), _dense(other.column(vector_col)), own.column(id_col).to_numpy(), _dense(own.column(vector_col)), metric, k, floor, digits)])

    rows_side, query_side = dealt(held, "block", n_blocks, "part", n_groups), dealt(asked, "part", n_groups, "block", n_blocks)
    return rows_side.cogroup(query_side).applyInArrow(lambda a, b: meet(a, b), schema)


def knn_join(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", digits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the highest similarity for each query, ties by id."""
    best = _joined(queries, rows, metric, k, None, digits, id_col, vector_col, broadcast_bytes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def batch_range_search(queries: DataFrame, rows: DataFrame, radius: float, metric: str = "euclidean", *, id_col: str = "id", vector_col: str = "vector", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, distance) of the rows within the radius of each query."""
    if metric not in ("euclidean", "manhattan"):
        raise ValueError("a range join takes a true distance")
    found = _joined(queries, rows, metric, None, -radius, None, id_col, vector_col, broadcast_bytes)
    return found.select("query_id", "id", (-F.col("score")).alias("distance"))


def similarity_matrix(queries: DataFrame, rows: DataFrame, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, score) of every query and row: a stated query set against all rows, in blocks."""
    return _joined(queries, rows, metric, None, None, None, id_col, vector_col, broadcast_bytes)


def pairwise_similarity(pairs: DataFrame, a: str, b: str, metric: str = "cosine") -> DataFrame:
    """``pairs`` with the similarity of two of its vector columns."""
    return pairs.withColumn("score", kernels.SIMILARITY[metric](F.col(a), F.col(b)))

"""Approximate indexes as layouts: a column to prune by, then exact scores over what is left.

Inverted lists (IVF) put every row in the cell of its nearest centroid. ``save`` writes the rows
partitioned by cell, with each cell's size and radius, and ``load`` reads them back: a search
reads its cells' folders only. Hashes and product codes are columns of the rows. Many queries
meet rows in blocks of bounded size under an equi-join key, where one matrix pass per block leaves
each query's k best; nothing is joined row by row.

The ``*_join`` functions with ``certain`` or ``sure`` in their names read on until the k-th score is
settled: by the triangle inequality over cells, by each row's own quantisation error, or
(signatures only bound a score in probability) until each true neighbour is missed with a chance
of ``miss`` at most. For cosine and Euclidean scores.
"""

from __future__ import annotations

import copy
import heapq
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from math import comb, log10, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantloom.functions import kernels
from vantloom.operators import vectors
from vantloom.operators.search import BLOCK_ROWS, GROUP_QUERIES, _dense, exact_knn, knn_join, score_matrix
from vantloom.runtime import ship

#: Query and row pairs that a kernel scores at a time.
PASS_PAIRS = 1 << 22


@dataclass(frozen=True)
class IndexConfig:
    """Zero means chosen from the data's size."""

    kind: str = "flat"
    metric: str = "cosine"
    lists: int = 0
    probes: int = 0
    subvectors: int = 0
    bits: int = 0
    hashes: int = 32
    seed: int = 42

    def resolved(self, n: int, dim: int) -> IndexConfig:
        lists = self.lists or max(8, round(8 * log10(max(n, 10))))
        bits = self.bits or (8 if n < 100_000 else 10 if n < 1_000_000 else 12)
        return IndexConfig(self.kind, self.metric, lists, self.probes or max(1, lists // 4), self.subvectors or max(1, min(dim, round(4 * sqrt(dim)))), bits, self.hashes, self.seed)


def choose_index(n: int, dim: int, target: str = "balanced") -> str:
    """Rule table by what matters (speed, memory, accuracy, build or balanced), size and dimension."""
    if n < 10_000 or target == "accuracy":
        return "flat"
    if target == "memory":
        return "ivfpq" if n >= 1_000_000 else "pq"
    if target == "build":
        return "lsh"
    if target == "speed":
        return "ivf" if dim > 10 else "vptree"
    return "ivfpq" if n >= 1_000_000 and dim > 100 else "ivf"


# -- Queries meet blocks of rows -----------------------------------------------------------


def exact_kernel(metric: str) -> Callable:
    """Scores of every row of a block; (query number, row number, score) of those at ``need`` or above."""

    def run(own: pa.Table, m: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
        s = score_matrix(q, m, metric)
        who, row = np.nonzero(s >= np.maximum(need, _kth(s, k))[:, None])
        return who, row, s[who, row]

    return run


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row of ``scores``; minus infinity where there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if k <= n else np.full(len(scores), -np.inf)


def _score_pairs(q: np.ndarray, m: np.ndarray, who: np.ndarray, row: np.ndarray, metric: str) -> np.ndarray:
    """Scores of chosen pairs, a bounded number at a time."""
    out = np.empty(len(who))
    step = max(1, PASS_PAIRS // max(1, m.shape[1]))
    for at in range(0, len(who), step):
        x, y = q[who[at : at + step]], m[row[at : at + step]]
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            out[at : at + step] = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size != 0)
        else:
            out[at : at + step] = -np.sqrt(((x - y) ** 2).sum(axis=1))
    return out


def block_search(rows: DataFrame, asked: DataFrame, k: int, kernel: Callable, *, sizes: dict[int, int] | None = None, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES, copies: bool = False) -> DataFrame:
    """(query_id, rank, id, score): each query's k best of the rows that ``kernel`` finds in the blocks it meets.

    ``rows`` (id, v, ...) and ``asked`` (query_id, q, need, ...) meet under ``cell`` if both have it.
    Cells are parted into blocks by their ``sizes``, and each cell's queries into groups, so no task
    holds more than one of both. With ``copies`` a row may stand in several cells and counts once.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = asked.filter(F.col("query_id").isNotNull() & F.col("q").isNotNull())
    if "cell" not in rows.columns:
        rows, asked, sizes = rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), None
    wanted = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    if sizes is None:
        sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    cells = sorted(c for c in wanted if sizes.get(c))
    rows = rows.filter(F.col("cell").isin(cells))
    kind, other = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    schema = f"query_id {other}, id {kind}, score double"
    if not cells:
        return spark.createDataFrame([], schema.replace(", id", ", rank int, id"))

    def parts(counts: dict[int, int], bound: int) -> Column:
        many = {c: -(-counts[c] // bound) for c in cells if counts[c] > bound}
        found = F.element_at(F.create_map(*(F.lit(x) for c, n in many.items() for x in (c, n))), F.col("cell")) if many else F.lit(None)
        return F.coalesce(found, F.lit(1)).cast("bigint")

    blocks, groups = parts(sizes, block_rows), parts(wanted, group_queries)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("part", every(groups))
    right = asked.filter(F.col("cell").isin(cells)).withColumn("part", F.pmod(F.xxhash64("query_id"), groups)).withColumn("block", every(blocks))

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        found: list = []
        if own.num_rows and others.num_rows:
            m, q = _dense(own.column("v")), _dense(others.column("q"))
            need = others.column("need").to_numpy() if "need" in others.column_names else np.full(len(q), -np.inf)
            ids = own.column("id").combine_chunks() if isinstance(own.column("id"), pa.ChunkedArray) else own.column("id")
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            step = max(1, PASS_PAIRS // len(m))
            for at in range(0, len(q), step):
                who, row, score = kernel(own, m, q[at : at + step], need[at : at + step], k)
                order = np.lexsort((place[row], -score, who))
                who, row, score = who[order], row[order], score[order]
                best = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
                found.append((who[best] + at, row[best], score[best]))
        who, row, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        return pa.table({"query_id": others.column("query_id").take(pa.array(who)), "id": own.column("id").take(pa.array(row)), "score": pa.array(score)})

    ship(spark)
    keys = ["cell", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b), schema)
    return top_ranked(found.dropDuplicates(["query_id", "id"]) if copies else found, k)


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def asked_of(queries: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))


# -- Inverted lists -------------------------------------------------------------------------


class Ivf:
    """Centroids fitted on a bounded sample; every row is assigned a cell.

    ``cells_of`` takes vectors [n, dim] and gives each one's cells, the nearest first.
    """

    def __init__(self, df: DataFrame, config: IndexConfig, *, id_col: str = "id", vector_col: str = "vector", centroids: np.ndarray | None = None, stats: dict | None = None):
        self.config, self.id_col, self.vector_col = config, id_col, vector_col
        if centroids is None:
            self.centroids = vectors.fit_kmeans(df, config.lists, "euclidean", vector_col=vector_col, seed=config.seed)
            self.rows = vectors.assign(df, self.centroids, "euclidean", vector_col=vector_col, out="cell")
        else:
            self.centroids, self.rows = centroids, df
        self._stats = stats

    @property
    def stats(self) -> dict[int, tuple[int, float]]:
        """Rows and radius of each cell that has rows; one row a cell comes to the driver."""
        if self._stats is None:
            ship(self.rows.sparkSession)
            metric, centroids = self.config.metric, self.rows.sparkSession.sparkContext.broadcast(self.centroids)

            @F.pandas_udf("double")
            def away(v: pd.Series, cell: pd.Series) -> pd.Series:
                x, known = _placed(v, metric)
                return pd.Series(np.where(known, np.linalg.norm(x - centroids.value[cell.to_numpy()], axis=1), np.inf))

            found = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(away(self.vector_col, "cell")).alias("r"))
            self._stats = {r.cell: (r.n, r.r) for r in found.collect()}
        return self._stats

    def save(self, path: str) -> None:
        """Rows partitioned by cell, and one row a cell with centroid, size and radius."""
        spark = self.rows.sparkSession
        self.rows.repartition("cell", F.pmod(F.xxhash64(self.id_col), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        cells = [(c, x.tolist(), *self.stats.get(c, (0, None)), json.dumps(asdict(self.config))) for c, x in enumerate(self.centroids)]
        spark.createDataFrame(cells, "cell int, centroid array<double>, n bigint, radius double, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, id_col: str = "id", vector_col: str = "vector") -> Ivf:
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        stats = {r.cell: (r.n, r.radius) for r in cells if r.n}
        return cls(spark.read.parquet(f"{path}/rows"), IndexConfig(**json.loads(cells[0].config)), id_col=id_col, vector_col=vector_col, centroids=np.array([r.centroid for r in cells]), stats=stats)

    def probing(self, probes: int) -> Ivf:
        """The same index with another number of probes."""
        return Ivf(self.rows, replace(self.config, probes=probes), id_col=self.id_col, vector_col=self.vector_col, centroids=self.centroids, stats=self._stats)

    def tuned(self, queries: DataFrame, k: int, target: float = 0.9) -> Ivf:
        """With the fewest probes whose recall over ``queries`` (a bounded sample) is ``target`` or more."""
        truth = self.certain_join(queries, k).cache()
        try:
            probes = 1
            while probes < len(self.centroids) and recall(self.probing(probes).join(queries, k), truth).first().recall < target:
                probes = min(len(self.centroids), probes * 2)
        finally:
            truth.unpersist()
        return self.probing(probes)

    def cells_of(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-score_matrix(q, self.centroids, "euclidean"), axis=1, kind="stable")[:, : self.config.probes]

    def cells(self, q: list[float]) -> list[int]:
        return self.cells_of(np.array([q], float))[0].tolist()

    def search(self, q: list[float], k: int) -> DataFrame:
        return exact_knn(self.rows.filter(F.col("cell").isin(self.cells(q))), q, k, self.config.metric, id_col=self.id_col, vector_col=self.vector_col)

    def near(self, asked: DataFrame) -> DataFrame:
        """``asked`` once for each of a query's cells."""
        ship(asked.sparkSession)
        slim = Ivf(None, self.config, centroids=self.centroids) if type(self) is Ivf else self._slim()
        sent = asked.sparkSession.sparkContext.broadcast(slim)

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            return pd.Series([c.tolist() for c in sent.value.cells_of(np.stack(v.to_numpy()).astype(float))])

        return asked.withColumn("cell", F.explode(cells("q")))

    def own_rows(self) -> DataFrame:
        return self.rows.withColumnsRenamed({self.id_col: "id", self.vector_col: "v"})

    def sizes(self) -> dict[int, int]:
        return {c: n for c, (n, _) in self.stats.items()}

    def join(self, queries: DataFrame, k: int, kernel: Callable | None = None) -> DataFrame:
        """(query_id, rank, id, score): each query meets the rows of its cells under the cell key."""
        asked = self.near(asked_of(queries, self.id_col, self.vector_col))
        return block_search(self.own_rows(), asked, k, kernel or exact_kernel(self.config.metric), sizes=self.sizes())

    def certain_cells(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q, need, cell): every cell that may hold one of the k nearest, and a score they have at least.

        The k-th score within the nearest ``probes`` cells bounds the true one from below; a cell
        goes only where its centroid's distance less its radius is beyond that.
        """
        metric = _bounded_metric(self.config.metric)
        sent = queries.sparkSession.sparkContext.broadcast(self.centroids)
        radii = np.array([self.stats[c][1] if c in self.stats else -np.inf for c in range(len(self.centroids))])

        @F.pandas_udf("array<int>")
        def within(q: pd.Series, score: pd.Series) -> pd.Series:
            x, known = _placed(q, metric)
            least = -score_matrix(x, sent.value, "euclidean") - radii
            most = np.sqrt(np.maximum(2 - 2 * score.to_numpy(), 0)) if metric == "cosine" else -score.to_numpy()
            kept = (least <= most[:, None] + 1e-6) | (~known[:, None] & np.isfinite(radii)) | (radii == np.inf)
            return pd.Series([np.flatnonzero(r).tolist() for r in kept])

        kth = self.join(queries, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("need"))
        wide = asked_of(queries, self.id_col, self.vector_col).join(kth, "query_id", "left").withColumn("need", F.coalesce("need", F.lit(float("-inf"))))
        return wide.withColumn("cell", F.explode(within("q", "need"))).withColumn("need", F.col("need") - 1e-9)

    def certain_join(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score): the k nearest, all of them."""
        return block_search(self.own_rows(), self.certain_cells(queries, k), k, exact_kernel(self.config.metric), sizes=self.sizes())


class Hierarchy(Ivf):
    """Cells under levels of clusters: a search descends by the ``beam`` nearest clusters of each level.

    Levels merge the centroids bottom-up; a cluster is the mean of its cells weighted by their rows,
    so merging is over cells and never over the rows.
    """

    def __init__(self, ivf: Ivf, levels: tuple[int, ...] = (4, 16), beam: int = 3, linkage: str = "centroid"):
        super().__init__(ivf.rows, ivf.config, id_col=ivf.id_col, vector_col=ivf.vector_col, centroids=ivf.centroids, stats=ivf.stats)
        self.beam = beam
        weights = np.array([ivf.stats.get(c, (0, 0.0))[0] for c in range(len(ivf.centroids))], float)
        self.levels: list[tuple[np.ndarray, list[np.ndarray]]] = []
        points, size = ivf.centroids, weights
        for n in sorted({x for x in levels if x < len(ivf.centroids)}, reverse=True):
            label = vectors.merge_points(points, n, linkage, size)
            children = [np.flatnonzero(label == j) for j in range(label.max() + 1)]
            points = np.array([np.average(points[c], axis=0, weights=size[c] if size[c].sum() else None) for c in children])
            size = np.array([size[c].sum() for c in children])
            self.levels.append((points, children))

    def _slim(self) -> Hierarchy:
        slim = object.__new__(Hierarchy)
        slim.config, slim.centroids, slim.levels, slim.beam = self.config, self.centroids, self.levels, self.beam
        return slim

    def with_beam(self, beam: int) -> Hierarchy:
        other = object.__new__(Hierarchy)
        other.__dict__ = {**self.__dict__, "beam": beam}
        return other

    def tuned_beam(self, queries: DataFrame, k: int, target: float = 0.9) -> Hierarchy:
        """With the least beam whose recall over ``queries`` (a bounded sample) is ``target`` or more."""
        truth = self.certain_join(queries, k).cache()
        most = max([len(points) for points, _ in self.levels], default=1)
        beam = 1
        try:
            while beam < most and recall(self.with_beam(beam).join(queries, k), truth).first().recall < target:
                beam = min(most, beam * 2)
        finally:
            truth.unpersist()
        return self.with_beam(beam)

    def cells_of(self, q: np.ndarray) -> list[np.ndarray]:
        out = []
        for x in q:
            at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.centroids))
            for points, children in reversed(self.levels):
                near = at[np.argsort(((points[at] - x) ** 2).sum(axis=1), kind="stable")[: self.beam]]
                at = np.concatenate([children[c] for c in near])
            out.append(at[np.argsort(((self.centroids[at] - x) ** 2).sum(axis=1), kind="stable")[: self.config.probes]])
        return out


def sharded_join(df: DataFrame, queries: DataFrame, shards: int, k: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): rows routed to shards by id, every query sent to every shard, answers merged."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = asked_of(queries, id_col, vector_col).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return block_search(rows, asked, k, exact_kernel(metric))


def best_layer(layers: list[Ivf], sample: DataFrame, k: int, target: float = 0.9) -> Ivf:
    """Of indexes of several granularities, each tuned to the recall, the one that reads the fewest centroids and rows."""

    def cost(ivf: Ivf) -> float:
        sizes = [n for n, _ in ivf.stats.values()]
        return len(ivf.centroids) + ivf.config.probes * sum(sizes) / max(1, len(sizes))

    return min((layer.tuned(sample, k, target) for layer in layers), key=cost)


def _bounded_metric(metric: str) -> str:
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no bounds for metric {metric}")
    return metric


def _placed(v: pd.Series, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as points whose distance orders them by ``metric``, and whether they are (a zero vector has no direction)."""
    x = np.stack(v.to_numpy()).astype(float)
    if metric != "cosine":
        return x, np.ones(len(x), bool)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms != 0), norms[:, 0] != 0


# -- Hyperplane signatures ------------------------------------------------------------------


def planes(dim: int, hashes: int, seed: int = 42) -> np.ndarray:
    p = np.random.default_rng(seed).normal(size=(hashes, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def lsh_signature(v: Column, p: np.ndarray) -> Column:
    """One bit for each hyperplane, set where the vector lies on its positive side or in it."""

    @F.pandas_udf("bigint")
    def signature(x: pd.Series) -> pd.Series:
        sides = np.stack(x.to_numpy()).astype(float) @ p.T >= 0
        return pd.Series((sides.astype(np.int64) << np.arange(len(p))).sum(axis=1))

    return signature(v)


def lsh_search(df: DataFrame, q: list[float], k: int, config: IndexConfig, *, id_col: str = "id", vector_col: str = "vector", min_agreement: float = 0.5) -> DataFrame:
    """(id, bit_distance, distance): rows that agree in over ``min_agreement`` of the bits, by exact distance."""
    p = planes(len(q), config.hashes, config.seed)
    own = sum(1 << j for j, plane in enumerate(p) if float(plane @ np.array(q)) >= 0)
    differ = F.bit_count(lsh_signature(F.col(vector_col), p).bitwiseXOR(F.lit(own).cast("bigint")))
    found = df.withColumn("bit_distance", differ / config.hashes).filter(1 - F.col("bit_distance") > min_agreement)
    return found.select(id_col, "bit_distance", kernels.distance_with(F.col(vector_col), q, config.metric).alias("distance")).orderBy("distance", id_col).limit(k)


def _agreement_limits(hashes: int, miss: float) -> list[float]:
    """For 0, 1, ... differing bits: the largest chance of a bit to differ at which more bits differ with ``miss`` at most."""
    out = []
    for bits in range(hashes):
        low, high = 0.0, 1.0
        for _ in range(50):
            p = (low + high) / 2
            beyond = sum(comb(hashes, j) * p**j * (1 - p) ** (hashes - j) for j in range(bits + 1, hashes + 1))
            low, high = (p, high) if beyond <= miss else (low, p)
        out.append(low)
    return out


def with_signatures(df: DataFrame, config: IndexConfig, dim: int, *, vector_col: str = "vector") -> DataFrame:
    """``df`` with its rows' ``signature``: the column that ``sure_lsh_join`` reads."""
    ship(df.sparkSession)
    return df.withColumn("signature", lsh_signature(F.col(vector_col), planes(dim, config.hashes, config.seed)))


def sure_lsh_join(signed: DataFrame, queries: DataFrame, k: int, config: IndexConfig, *, id_col: str = "id", vector_col: str = "vector", miss: float = 0.01) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest by exact cosine of the rows within enough bits.

    A bit differs with a chance of angle over pi. In each block, the k rows of fewest differing bits
    bound the k-th angle from above; bits are enough where a row within that angle is missed with
    a chance of ``miss`` at most. Fewer than k rows are all read.
    """
    if config.metric != "cosine":
        raise ValueError("signatures are of angles")
    limits, hashes, seed = np.array(_agreement_limits(config.hashes, miss)), config.hashes, config.seed

    def kernel(own: pa.Table, m: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
        p = planes(q.shape[1], hashes, seed)
        mine = ((q @ p.T >= 0).astype(np.int64) << np.arange(hashes)).sum(axis=1)
        differ = np.bitwise_count(mine[:, None] ^ own.column("signature").to_numpy()[None])
        if len(m) <= k:
            who, row = (x.ravel() for x in np.indices(differ.shape))
            return who, row, _score_pairs(q, m, who, row, "cosine")
        nearest = np.argpartition(differ, k - 1, axis=1)[:, :k]
        first = _score_pairs(q, m, np.repeat(np.arange(len(q)), k), nearest.ravel(), "cosine").reshape(len(q), k).min(axis=1)
        chance = np.arccos(np.clip(np.maximum(first, need), -1, 1)) / pi
        bits = (limits[None] < chance[:, None]).sum(axis=1)
        who, row = np.nonzero(differ <= bits[:, None])
        return who, row, _score_pairs(q, m, who, row, "cosine")

    rows = signed.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "signature")
    return block_search(rows, asked_of(queries, id_col, vector_col), k, kernel)


class Pq:
    """Product quantisation: a code for each subvector, distances by table lookups."""

    def __init__(self, df: DataFrame, config: IndexConfig, *, id_col: str = "id", vector_col: str = "vector", fit_rows: int = 20_000):
        self.id_col, self.vector_col, self.config = id_col, vector_col, config
        sample = vectors._bounded(df, vector_col, fit_rows, config.seed)
        self.cuts = np.array_split(np.arange(sample.shape[1]), config.subvectors)
        rng = np.random.default_rng(config.seed)
        self.books = [self._book(sample[:, c], min(1 << config.bits, len(sample)), rng) for c in self.cuts]
        books, cuts = df.sparkSession.sparkContext.broadcast(self.books), self.cuts
        ship(df.sparkSession)

        @F.pandas_udf("array<int>")
        def encode(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(float)
            return pd.Series(np.stack([score_matrix(b, x[:, c], "euclidean").argmax(axis=0) for b, c in zip(books.value, cuts)], axis=1).tolist())

        self.codes = df.withColumn("codes", encode(vector_col))

    @staticmethod
    def _book(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            own = score_matrix(c, x, "euclidean").argmax(axis=0)
            c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        return c

    def adc(self, q: list[float]) -> Column:
        """Sum of squared subspace distances, from one table of each subspace."""
        tables = [((b - np.array(q)[c]) ** 2).sum(axis=1).tolist() for b, c in zip(self.books, self.cuts)]
        return kernels._sum([F.element_at(F.array(*(F.lit(x) for x in t)), F.get("codes", F.lit(j)) + 1) for j, t in enumerate(tables)])

    def search(self, q: list[float], k: int, rerank: int = 4, rows: DataFrame | None = None) -> DataFrame:
        """(id, adc, distance): the ``rerank`` x k best by lookups, then by exact distance."""
        best = (self.codes if rows is None else rows).withColumn("adc", self.adc(q)).orderBy("adc", self.id_col).limit(k * rerank)
        return best.select(self.id_col, "adc", kernels.distance_with(F.col(self.vector_col), q, self.config.metric).alias("distance")).orderBy("distance", self.id_col).limit(k)


    def save(self, path: str) -> None:
        """Rows with codes and errors, and one row a subspace with its book."""
        cells = ["cell"] if "cell" in self.codes.columns else []
        self.with_error(self.codes).write.mode("overwrite").partitionBy(*cells).parquet(f"{path}/rows")
        books = [(j, c.tolist(), b.tolist(), json.dumps(asdict(self.config))) for j, (c, b) in enumerate(zip(self.cuts, self.books))]
        self.codes.sparkSession.createDataFrame(books, "part int, dims array<int>, book array<array<double>>, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, id_col: str = "id", vector_col: str = "vector") -> Pq:
        found = object.__new__(cls)
        books = spark.read.parquet(f"{path}/books").orderBy("part").collect()
        found.id_col, found.vector_col, found.config = id_col, vector_col, IndexConfig(**json.loads(books[0].config))
        found.cuts, found.books = [np.array(r.dims) for r in books], [np.array(r.book) for r in books]
        found.codes = spark.read.parquet(f"{path}/rows")
        return found

    def with_error(self, rows: DataFrame) -> DataFrame:
        """``rows`` with column error: each vector's distance from the one its codes stand for."""
        if "error" in rows.columns:
            return rows
        books, cuts = rows.sparkSession.sparkContext.broadcast(self.books), self.cuts

        @F.pandas_udf("double")
        def error(v: pd.Series, codes: pd.Series) -> pd.Series:
            x, code = np.stack(v.to_numpy()).astype(float), np.stack(codes.to_numpy())
            return pd.Series(np.sqrt(sum(((x[:, c] - b[code[:, j]]) ** 2).sum(axis=1) for j, (b, c) in enumerate(zip(books.value, cuts)))))

        return rows.withColumn("error", error(self.vector_col, "codes"))

    def certain_kernel(self) -> Callable:
        """Lookups give the score of what the codes stand for, and the error how far the true one can be.

        A row is passed over only where its best is below the k-th of the worst ones.
        """
        metric, books, cuts = _bounded_metric(self.config.metric), self.books, self.cuts

        def run(own: pa.Table, m: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
            code, error = _dense(own.column("codes")).astype(np.int64), own.column("error").to_numpy()
            near = np.zeros((len(q), len(m)))
            for j, (b, c) in enumerate(zip(books, cuts)):
                table = q[:, c] @ b.T if metric == "cosine" else ((q[:, None, c] - b[None]) ** 2).sum(axis=2)
                near += table[:, code[:, j]]
            if metric == "euclidean":
                near, spread = -np.sqrt(near), error
            else:
                norms = np.linalg.norm(m, axis=1)
                whole = np.linalg.norm(q, axis=1)[:, None] * norms
                near = np.divide(near, whole, out=np.zeros_like(near), where=whole != 0)
                spread = np.divide(error, norms, out=np.zeros(len(m)), where=norms != 0)  # a zero vector scores 0
            least = np.maximum(need, _kth(near - spread - 1e-6, k))
            who, row = np.nonzero(near + spread + 1e-6 >= least[:, None])
            return who, row, _score_pairs(q, m, who, row, metric)

        return run

    def own_rows(self) -> DataFrame:
        return self.with_error(self.codes).withColumnsRenamed({self.id_col: "id", self.vector_col: "v"})

    def certain_join(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score): the k nearest rows of each query, all of them."""
        return block_search(self.own_rows().drop("cell"), asked_of(queries, self.id_col, self.vector_col), k, self.certain_kernel())


def certain_ivfpq_join(ivf: Ivf, pq: Pq, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): lookups in every cell that may hold one of the k nearest. ``pq`` is built on ``ivf.rows``."""
    return block_search(pq.own_rows(), ivf.certain_cells(queries, k), k, pq.certain_kernel(), sizes=ivf.sizes())


def ivfpq_search(ivf: Ivf, pq: Pq, q: list[float], k: int, rerank: int = 4) -> DataFrame:
    """Inverted lists over coded rows: lookups in the probed cells only. ``pq`` is built on ``ivf.rows``."""
    return pq.search(q, k, rerank, pq.codes.filter(F.col("cell").isin(ivf.cells(q))))


# -- Pivots ---------------------------------------------------------------------------------


def pivot_range_search(df: DataFrame, pivots: list[list[float]], q: list[float], radius: float, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact range search pruned by the triangle inequality over distances from pivots.

    ``df`` carries those distances in columns pivot_0, pivot_1, ...; read from where ``save_pivots``
    wrote them, the pruning is a range predicate that reaches the scan and skips row groups.
    """
    for k, p in enumerate(pivots):
        d = float(np.linalg.norm(np.array(p) - np.array(q)))
        df = df.filter(F.col(f"pivot_{k}").between(d - radius - 1e-9, d + radius + 1e-9))
    return df.select(id_col, kernels.distance_with(F.col(vector_col), q, "euclidean").alias("distance")).filter(F.col("distance") <= radius).orderBy("distance", id_col)


def with_pivots(df: DataFrame, pivots: list[list[float]], vector_col: str = "vector") -> DataFrame:
    return df.withColumns({f"pivot_{k}": kernels.distance_with(F.col(vector_col), p, "euclidean") for k, p in enumerate(pivots)})


def save_pivots(df: DataFrame, pivots: list[list[float]], path: str, *, vector_col: str = "vector", row_group_bytes: int = 1 << 20) -> None:
    """Rows with their distances, in order of the first pivot's, in small row groups."""
    placed = with_pivots(df, pivots, vector_col)
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(width, "pivot_0").sortWithinPartitions("pivot_0").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


# -- A forest of random-projection trees ----------------------------------------------------


class Trees:
    """Trees whose nodes part the space halfway between two sampled points; rows stand in a leaf of each.

    Trees are grown on a bounded sample; every row is assigned. A search pops nodes of all trees in
    order of margin, the widest first, until it has ``leaves`` leaves, and scores their rows exactly.
    """

    def __init__(self, dim: int, trees: int = 6, leaf_rows: int = 64, leaves: int = 12, metric: str = "cosine", seed: int = 42):
        self.dim, self.trees, self.leaf_rows, self.leaves, self.metric, self.seed = dim, trees, leaf_rows, leaves, metric, seed
        self.normals, self.offsets, self.children = np.empty((0, dim)), np.empty(0), np.empty((0, 2), np.int64)
        self.roots: list[int] = []
        self.n_leaves = 0

    @classmethod
    def fit(cls, df: DataFrame, *, vector_col: str = "vector", fit_rows: int = 20_000, **options) -> Trees:
        sample = vectors._bounded(df, vector_col, fit_rows, options.get("seed", 42))
        found = cls(sample.shape[1] if sample.size else 1, **options)
        sample = sample[np.lexsort(sample.T[::-1])] if len(sample) else sample
        normals, offsets, children = [], [], []
        rng = np.random.default_rng(found.seed)
        for _ in range(found.trees):
            found.roots.append(found._grow(sample, rng, normals, offsets, children))
        if normals:
            found.normals, found.offsets, found.children = np.array(normals), np.array(offsets), np.array(children)
        return found

    def _plane(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """(normal, offset) halfway between two rows drawn."""
        a, b = x[rng.choice(len(x), 2, replace=False)]
        if self.metric == "cosine":
            return a / (np.linalg.norm(a) or 1) - b / (np.linalg.norm(b) or 1), 0.0
        return a - b, float((a - b) @ (a + b) / 2)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, normals: list, offsets: list, children: list) -> int:
        """Number of the node over ``x``; leaves are numbered downward from -1."""
        if len(x) > self.leaf_rows:
            normal, offset = self._plane(x, rng)
            right = x @ normal >= offset
            if 0 < right.sum() < len(x):
                at = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                children[at] = [self._grow(x[~right], rng, normals, offsets, children), self._grow(x[right], rng, normals, offsets, children)]
                return at
        self.n_leaves += 1
        return -self.n_leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """[row, tree] leaf numbers from 0."""
        out = np.empty((len(x), self.trees), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = (x[inner] * self.normals[at]).sum(axis=1) >= self.offsets[at]
                node[inner] = self.children[at, right.astype(int)]
            out[:, t] = -node - 1
        return out

    def probed(self, q: np.ndarray) -> list[int]:
        heap = [(-np.inf, root) for root in self.roots]
        out: list[int] = []
        while heap and len(out) < self.leaves:
            margin, node = heapq.heappop(heap)
            while node >= 0:
                gap = float(self.normals[node] @ q - self.offsets[node])
                near, far = self.children[node, int(gap >= 0)], self.children[node, int(gap < 0)]
                heapq.heappush(heap, (max(margin, abs(gap)), int(far)))
                node = int(near)
            out.append(-node - 1)
        return out

    def tuned(self, assigned: DataFrame, queries: DataFrame, truth: DataFrame, k: int, target: float = 0.9, *, id_col: str = "id", vector_col: str = "vector") -> Trees:
        """With the fewest leaves whose recall against ``truth`` over ``queries`` (a bounded sample) is ``target`` or more."""
        truth, found = truth.cache(), copy.copy(self)
        try:
            while found.leaves < self.n_leaves and recall(found.join(assigned, queries, k, id_col=id_col, vector_col=vector_col), truth).first().recall < target:
                found = copy.copy(found)
                found.leaves = min(self.n_leaves, 2 * found.leaves)
        finally:
            truth.unpersist()
        return found

    def assign(self, df: DataFrame, *, vector_col: str = "vector") -> DataFrame:
        """``df`` once for each tree, with ``cell``: the row's leaf there."""
        ship(df.sparkSession)
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<int>")
        def leaves(v: pd.Series) -> pd.Series:
            return pd.Series(sent.value.leaf_of(np.stack(v.to_numpy()).astype(float)).tolist())

        return df.filter(F.col(vector_col).isNotNull()).withColumn("cell", F.explode(leaves(vector_col)))

    def parts(self, x: np.ndarray, seed: int = 0) -> np.ndarray:
        """Part of each row, from 0: leaves of a tree of their own, of ``leaf_rows`` rows at most.

        Rows that several pairs of points don't part (equal ones do not) are cut in halves by position.
        """
        rng = np.random.default_rng((self.seed, seed))
        out, done, todo = np.zeros(len(x), np.int32), 0, [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) <= self.leaf_rows:
                out[rows] = done
                done += 1
                continue
            right = np.arange(len(rows)) >= len(rows) // 2
            for _ in range(8):
                normal, offset = self._plane(x[rows], rng)
                found = x[rows] @ normal >= offset
                if 0 < found.sum() < len(rows):
                    right = found
                    break
            todo += [rows[~right], rows[right]]
        return out

    def parted(self, assigned: DataFrame, *, id_col: str = "id", vector_col: str = "vector", crowd: int = 16_384) -> DataFrame:
        """``assigned`` with ``part``: no (cell, part) has more than ``leaf_rows`` rows, however many the sample stood for.

        Cells of more rows go on growing within a task; those of more than ``crowd`` are dealt out to several first.
        """
        ship(assigned.sparkSession)
        sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))  # a row a leaf of the sample's trees
        met = assigned.join(F.broadcast(sizes), "cell")
        deals = F.ceil(F.col("_rows") / crowd)
        full = met.filter(F.col("_rows") > self.leaf_rows).withColumn("_deal", F.pmod(F.xxhash64(id_col), deals).cast("int"))
        columns = assigned.columns
        fields = [f"`{c}` {kind}" for c, kind in assigned.dtypes]

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(id_col, ignore_index=True)
            out = pdf[columns].copy()
            part = self.parts(np.stack(pdf[vector_col].to_numpy()).astype(float), int(key[0]))
            # Deals of one cell number their parts apart: a deal has fewer parts than rows.
            out["part"] = part.astype(np.int64) * int(pdf["_deals"].iloc[0]) + int(key[1])
            return out

        grown = full.withColumn("_deals", deals).groupBy("cell", "_deal").applyInPandas(grow, ", ".join([*fields, "part bigint"]))
        return met.filter(F.col("_rows") <= self.leaf_rows).select(*columns, F.lit(0).cast("bigint").alias("part")).unionByName(grown)

    def join(self, assigned: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
        """(query_id, rank, id, score) over the rows of each query's leaves."""
        sent = queries.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<int>")
        def leaves(q: pd.Series) -> pd.Series:
            return pd.Series([sent.value.probed(np.asarray(x, float)) for x in q])

        asked = asked_of(queries, id_col, vector_col).filter("q is not null").withColumn("cell", F.explode(leaves("q")))
        rows = assigned.withColumnsRenamed({id_col: "id", vector_col: "v"})
        return block_search(rows, asked, k, exact_kernel(self.metric), copies=True)


# -- Neighbour graphs -----------------------------------------------------------------------


def nearest_in(points: np.ndarray, m: int, metric: str) -> np.ndarray:
    """[row, <= m] numbers of each row's nearest others, a bounded number of pairs at a time."""
    n = len(points)
    m = min(m, n - 1)
    out = np.empty((n, m), np.int64)
    step = max(1, PASS_PAIRS // max(1, n))
    half = (points * points).sum(axis=1) / 2
    for at in range(0, n, step):
        # For distances one product orders rows as well, to rounding, which is enough for links.
        s = points[at : at + step] @ points.T - half if metric == "euclidean" else score_matrix(points[at : at + step], points, metric)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.empty((len(s), 0), np.int64)
        out[at : at + step] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _both_ways(near: np.ndarray, rng: np.random.Generator, most: int, strays: int) -> list[list[int]]:
    """Lists of the nearest, of who names the row among theirs (``most`` in all), and a few strays that join far parts."""
    n = len(near)
    links = [list(x) for x in near.tolist()]
    for i, row in enumerate(near.tolist()):
        for j in row:
            if len(links[j]) < most and i not in links[j]:
                links[j].append(i)
    for i, extra in enumerate(rng.integers(0, n, (n, strays)).tolist()):
        links[i] += [j for j in dict.fromkeys(extra) if j != i and j not in links[i]]
    return links


@dataclass(frozen=True)
class GraphConfig:
    """``hnsw`` descends levels and keeps ``ef`` rows in view; ``graph`` has one level; ``ngt`` looks on within (1 + epsilon) times the k-th distance."""

    kind: str = "hnsw"
    metric: str = "cosine"
    degree: int = 16
    ef: int = 64
    epsilon: float = 0.1
    shard_rows: int = 16_384
    seed: int = 42


def build_graph(ivf: Ivf, config: GraphConfig) -> DataFrame:
    """(id, v, cell, block, pos, links): each block's rows numbered, with their neighbours' numbers on every level.

    A block is a cell, or a part of one of ``shard_rows`` rows or so; its graph is built by one task in
    bounded memory. Levels halve by hash of the id, geometrically.
    """
    rows = ivf.own_rows().filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", "cell")
    many = {c: -(-n // config.shard_rows) for c, n in ivf.sizes().items()}
    parts = F.element_at(F.create_map(*(F.lit(x) for c, n in many.items() for x in (c, n))), F.col("cell"))
    draw = F.pmod(F.xxhash64(F.lit(config.seed), "id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    level = F.floor(-F.log(F.greatest(draw, F.lit(1e-9))) / float(np.log(config.degree))).cast("int") if config.kind == "hnsw" else F.lit(0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), parts)).withColumn("level", level)
    kinds = dict(rows.dtypes)

    def build(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block.column("id")))
        points, levels = _dense(block.column("v")), block.column("level").to_numpy()
        rng = np.random.default_rng(config.seed)
        links: list[list[list[int]]] = [[] for _ in range(len(points))]
        for depth in range(int(levels.max(initial=0)) + 1):
            here = np.flatnonzero(levels >= depth)
            m = config.degree if depth else 2 * config.degree
            near = nearest_in(points[here], m, config.metric) if len(here) > 1 else np.empty((len(here), 0), np.int64)
            for i, row in zip(here.tolist(), _both_ways(near, rng, 2 * m, 2 if len(here) > 1 else 0)):
                links[i].append(here[row].tolist() if row else [])
        return pa.table({**{c: block.column(c) for c in ("id", "v", "cell", "block")}, "pos": pa.array(np.arange(len(points), dtype=np.int32)), "links": pa.array(links, pa.list_(pa.list_(pa.int32())))})

    ship(rows.sparkSession)
    return rows.groupBy("cell", "block").applyInArrow(lambda t: build(t), f"id {kinds['id']}, v {kinds['v']}, cell int, block {kinds['block']}, pos int, links array<array<int>>")


def best_first(points: np.ndarray, links: list[list[np.ndarray]], q: np.ndarray, k: int, config: GraphConfig) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, scores) found by walking the graph from its top level's rows to the query's neighbours."""
    sim = lambda at: score_matrix(q[None], points[at], config.metric)[0]
    depth = max(len(x) for x in links) - 1
    at = np.flatnonzero([len(x) > depth for x in links])[:1] if depth else np.arange(min(4, len(points)))
    for d in range(depth, 0, -1):  # greedy on the upper levels
        here = at[sim(at).argmax()]
        while len(near := links[here][d]) and (s := sim(near)).max() > sim(np.array([here]))[0]:
            here = near[s.argmax()]
        at = np.array([here])
    seen, opened = np.zeros(len(points), bool), np.zeros(len(points), bool)
    seen[at] = True
    rows, score = at, sim(at)
    keep = max(k, config.ef)
    while True:
        if config.kind == "ngt" and len(rows) >= k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            reach = (1 + config.epsilon) * kth if kth < 0 else kth - config.epsilon * (1 - kth)
            near = rows[score >= reach]
        else:
            near = rows
        turn = near[~opened[near]]
        if not len(turn):
            return rows, score
        opened[turn] = True
        found = np.unique(np.concatenate([links[i][0] for i in turn.tolist()]))
        found = found[~seen[found]]
        seen[found] = True
        rows, score = np.concatenate([rows, found]), np.concatenate([score, sim(found)]) if len(found) else score
        if config.kind != "ngt" and len(rows) > keep:
            best = np.argpartition(-score, keep - 1)[:keep]
            rows, score = rows[best], score[best]


def graph_kernel(config: GraphConfig) -> Callable:
    def run(own: pa.Table, m: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
        order = np.argsort(own.column("pos").to_numpy())
        lists = own.column("links").to_pylist()
        links = [[np.array(x, np.int64) for x in lists[i]] for i in order]
        points = m[order]
        found = [best_first(points, links, x, k, config) for x in q]
        who = np.repeat(np.arange(len(q)), [len(f[0]) for f in found])
        return who, order[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])

    return run


def graph_join(graph: DataFrame, ivf: Ivf, queries: DataFrame, k: int, config: GraphConfig) -> DataFrame:
    """(query_id, rank, id, score): each query walks the graphs of its cells' blocks."""
    asked = ivf.near(asked_of(queries, ivf.id_col, ivf.vector_col))
    return block_search(graph.drop("block"), asked, k, graph_kernel(config), sizes=ivf.sizes(), block_rows=config.shard_rows)


def knn_graph(df: DataFrame, degree: int, metric: str = "cosine", *, id_col: str = "id", vector_col: str = "vector", both_ways: bool = True, ivf: Ivf | None = None) -> DataFrame:
    """(src, dst, score): each row's ``degree`` nearest others, exactly.

    Without ``ivf`` every row meets every other; with it, only the cells that may hold one of its nearest.
    """
    near = (knn_join(df, df, degree + 1, metric, id_col=id_col, vector_col=vector_col) if ivf is None else ivf.certain_join(df, degree + 1)).filter("query_id <> id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    edges = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= degree).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")).dropDuplicates(["src", "dst"]) if both_ways else edges


# -- Measures -------------------------------------------------------------------------------


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, recall: the share of the true (query_id, id) pairs that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tuning_score(accuracy: float, query_ms: float, build_ms: float = 0.0, memory: float = 0.0, target: str = "balanced") -> float:
    """Score that a parameter search maximises."""
    return {"balanced": 0.7 * accuracy - 0.3 * query_ms / 100, "speed": -query_ms, "build": -build_ms, "memory": -memory, "accuracy": accuracy}[target]

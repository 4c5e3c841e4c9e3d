"""Vector transforms, scalers, statistics, clustering and reduction.

Per-dimension statistics need no exploding: ``posexplode`` and one grouped aggregate give a row
for each dimension, which is small and is turned back into array literals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantloom.functions import kernels
from vantloom.functions.binding import let
from vantloom.operators.search import score_matrix
from vantloom.runtime import ship

#: Rows that a model is fitted on at most; the rest only goes through it.
FIT_ROWS = 100_000


def normalized(v: Column, kind: str = "l2", zero: float | None = None) -> Column:
    """Divide by the L1, L2, max or mean of absolutes; null components stay and count for nothing.

    Zero vectors stay, or each component of theirs becomes ``zero``.
    """
    a = F.filter(F.transform(kernels.as_double(v), lambda x: F.abs(x)), lambda x: x.isNotNull())
    by = {"l1": kernels.total(a), "l2": kernels.l2_norm(a), "max": F.array_max(a), "mean": kernels.total(a) / F.nullif(F.size(a), F.lit(0))}[kind]
    still = kernels.as_double(v) if zero is None else F.transform(kernels.as_double(v), lambda x: F.when(x.isNotNull(), F.lit(zero)))
    return let(by, lambda n: F.when(n == 0, still).otherwise(F.transform(kernels.as_double(v), lambda x: x / n)))


def weighted(v: Column, weights: list[float]) -> Column:
    return F.zip_with(kernels.as_double(v), F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w)


def dimension_stats(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row a dimension: dim, n, mean, population deviation, min, max."""
    cells = df.select(F.posexplode(kernels.as_double(F.col(vector_col))).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / scale, dimension by dimension."""

    shift: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, v: Column) -> Column:
        params = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(self.shift, self.scale)))
        return F.zip_with(kernels.as_double(v), params, lambda x, p: (x - p["a"]) / p["b"])


def standard_scaler(df: DataFrame, vector_col: str = "vector") -> Scaler:
    """Population variance; a variance under 1e-10 counts as 1."""
    rows = dimension_stats(df, vector_col).orderBy("dim").collect()  # a row for each dimension
    return Scaler(tuple(r["mean"] for r in rows), tuple(r["std"] if r["std"] ** 2 >= 1e-10 else 1.0 for r in rows))


def minmax_scaler(df: DataFrame, vector_col: str = "vector") -> Scaler:
    rows = dimension_stats(df, vector_col).orderBy("dim").collect()
    return Scaler(tuple(r["min"] for r in rows), tuple((r["max"] - r["min"]) or 1.0 for r in rows))


def vector_features(v: Column) -> Column:
    """Struct of mean, population deviation, min, max, median and interquartile range."""
    x = kernels.as_double(v)
    n = F.size(x)
    mean = kernels.total(x) / n
    s = F.array_sort(x)
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    spread = F.get(s, F.floor(n * 3 / 4).cast("int")) - F.get(s, F.floor(n / 4).cast("int"))
    std = F.sqrt(let(mean, lambda m: kernels.total(F.transform(x, lambda y: (y - m) * (y - m)))) / n)
    return F.struct(mean.alias("mean"), std.alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), mid.alias("median"), spread.alias("iqr"))


def vector_average(df: DataFrame, by: list[str], vector_col: str = "vector") -> DataFrame:
    """(by..., mean array): elementwise mean of each group's vectors, pre-aggregated by dimension."""
    cells = df.select(*by, F.posexplode(kernels.as_double(F.col(vector_col))).alias("dim", "x"))
    means = cells.groupBy(*by, "dim").agg(F.avg("x").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def random_projection(v: Column, dim: int, out_dim: int, seed: int = 42) -> Column:
    """Product with the projection matrix."""
    return F.array(*(kernels.dot_with(v, row.tolist()) for row in projection_matrix(dim, out_dim, seed)))


def projection_matrix(dim: int, out_dim: int, seed: int = 42) -> np.ndarray:
    """Seeded Gaussian numbers scaled by 1/sqrt(out_dim), [out_dim, dim]."""
    return np.random.default_rng(seed).normal(0, 1 / np.sqrt(out_dim), (out_dim, dim))


def _bounded(df: DataFrame, vector_col: str, rows: int, seed: int) -> np.ndarray:
    """At most about ``rows`` vectors, drawn by hash; the bound is a parameter of the fit."""
    n = df.count()
    if n > rows:
        df = df.filter(F.pmod(F.xxhash64(F.lit(seed), vector_col), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return np.array([r[0] for r in df.select(kernels.as_double(F.col(vector_col))).collect()], float)


def fit_kmeans(df: DataFrame, k: int, metric: str = "euclidean", *, vector_col: str = "vector", seed: int = 42, rounds: int = 100, tol: float = 1e-3, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centroids [k, dim] by k-means++ and Lloyd's rounds; an empty cluster's centroid is zero."""
    x = _bounded(df, vector_col, fit_rows, seed)
    if not 1 <= k <= len(x):
        raise ValueError(f"k must lie within 1 and {len(x)}")
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centers)
    for _ in range(rounds):
        own = score_matrix(c, x, metric).argmax(axis=0)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else np.zeros(x.shape[1]) for j in range(k)])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)).max()
        c = new
        if moved < tol:
            break
    return c


def assign(df: DataFrame, centroids: np.ndarray, metric: str = "euclidean", *, vector_col: str = "vector", out: str = "cluster") -> DataFrame:
    """``df`` with the number of the nearest centroid; ties to the smaller number."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(centroids)  # k x dim numbers

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(score_matrix(sent.value, np.stack(v.to_numpy()).astype(float), metric).argmax(axis=0).astype(np.int32))

    return df.withColumn(out, nearest(F.col(vector_col)))


def fit_pca(df: DataFrame, k: int, *, vector_col: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components [k, dim]) from sums of outer products by partition; signs make the largest entry positive."""
    ship(df.sparkSession)
    d = len(df.select(vector_col).first()[0])

    def moments(frames):
        n, s, c = 0, np.zeros(d), np.zeros((d, d))
        for f in frames:
            x = np.stack(f[vector_col].to_numpy()).astype(float)
            n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    # d x d sums of each partition, folded by dimension on the executors: one row comes back.
    parts = df.select(kernels.as_double(F.col(vector_col)).alias(vector_col)).mapInPandas(moments, "n bigint, s array<double>, c array<double>")
    cells = parts.select("n", F.posexplode(F.concat("s", "c")).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("p").collect()
    n, flat = cells[0]["n"], np.array([r["x"] for r in cells])
    mean = flat[:d] / n
    values, vectors = np.linalg.eigh(flat[d:].reshape(d, d) / n - np.outer(mean, mean))
    top = vectors[:, np.argsort(-values)[:k]].T
    return mean, top * np.sign(top[np.arange(k), np.abs(top).argmax(axis=1)])[:, None]


def project(v: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    return F.array(*(kernels.dot_with(v, c.tolist()) - F.lit(float(mean @ c)) for c in components))


def merge_points(x: np.ndarray, clusters: int, linkage: str = "average", weights: np.ndarray | None = None) -> np.ndarray:
    """Cluster number of each point after merging the closest clusters until ``clusters`` are left.

    Distances between clusters are updated, not recomputed: a merge is one pass over a row of the
    matrix. Weights count as so many rows at a point, in average and centroid linkage.
    """
    n = len(x)
    size = np.ones(n) if weights is None else np.maximum(np.asarray(weights, float), 1e-12)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) if n * n * x.shape[1] <= 1 << 26 else np.array([((x - p) ** 2).sum(axis=1) for p in x])
    d = d if linkage == "centroid" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    label, live = np.arange(n), np.ones(n, bool)
    nearest, gap = d.argmin(axis=1), d.min(axis=1)
    for _ in range(n - max(1, clusters)):
        a = int(np.where(live, gap, np.inf).argmin())
        a, b = sorted((a, int(nearest[a])))
        if linkage == "single":
            row = np.minimum(d[a], d[b])
        elif linkage == "complete":
            row = np.maximum(d[a], d[b])
        else:
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            if linkage == "centroid":
                row = row - size[a] * size[b] * d[a, b] / (size[a] + size[b]) ** 2
        row[~live] = row[a] = row[b] = np.inf
        size[a] += size[b]
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        live[b] = False
        label[label == b] = a
        stale = np.flatnonzero(live & ((nearest == a) | (nearest == b)))
        nearest[stale], gap[stale] = d[stale].argmin(axis=1), d[stale].min(axis=1)
        nearest[a], gap[a] = row.argmin(), row.min()
        closer = live & (row < gap)
        nearest[closer], gap[closer] = a, row[closer]
    return np.unique(label, return_inverse=True)[1]


def agglomerative(df: DataFrame, clusters: int, linkage: str = "average", *, id_col: str = "id", vector_col: str = "vector", group_cols: list[str] | None = None) -> DataFrame:
    """(group..., id, cluster): merges the closest clusters of each group until ``clusters`` are left.

    Quadratic in a group's rows by nature, so groups must be small; without group columns the
    whole table is one group.
    """
    keys = group_cols or []
    fields = [f"`{c}` {dict(df.dtypes)[c]}" for c in [*keys, id_col]]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, ignore_index=True)
        out = pdf[[*keys, id_col]].copy()
        out["cluster"] = merge_points(np.stack(pdf[vector_col].to_numpy()).astype(float), clusters, linkage).astype(np.int32)
        return out

    ship(df.sparkSession)
    grouped = df.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"]))
    return grouped.applyInPandas(merge, ", ".join([*fields, "cluster int"]))


def mean_and_std(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    return dimension_stats(df, vector_col).select("dim", "mean", "std")


def agglomerate_cells(df: DataFrame, cells: int, clusters: int, linkage: str = "average", *, vector_col: str = "vector", seed: int = 42) -> DataFrame:
    """``df`` with ``cell`` and ``cluster``: cells by k-means, then the cells merged bottom-up.

    A cell stands for its rows at its centroid, so linkages weigh cells by their rows. Merging is
    quadratic in the cells, never in the rows, so tables of any size have a hierarchy.
    """
    centroids = fit_kmeans(df, cells, vector_col=vector_col, seed=seed)
    placed = assign(df, centroids, vector_col=vector_col, out="cell")
    rows = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    merged = merge_points(centroids, clusters, linkage, np.array([rows.get(k, 0) for k in range(len(centroids))]))
    lookup = F.array(*(F.lit(int(c)) for c in merged))
    return placed.withColumn("cluster", F.get(lookup, F.col("cell")))


def nonlinear(v: Column) -> Column:
    """A vector followed by tanh(2x) and the logistic of x / 2 of each component: what a projection's features gain."""
    bent = [F.transform(kernels.as_double(v), lambda x: F.tanh(2 * x)), F.transform(kernels.as_double(v), lambda x: 1 / (1 + F.exp(-x / 2)))]
    return F.concat(kernels.as_double(v), *bent)


def _affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities whose rows have the given perplexity."""
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    p, want = np.zeros_like(d), np.log(perplexity)
    for i in range(len(x)):
        near = np.delete(d[i], i) - np.delete(d[i], i).min()
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-near * beta)
            entropy = np.log(w.sum()) + beta * (near * w).sum() / w.sum()
            if abs(entropy - want) < 1e-6:
                break
            low, high = (beta, high) if entropy > want else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(len(x)) != i] = w / w.sum()
    return np.maximum((p + p.T) / (2 * len(x)), 1e-12)


def _spread_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
    np.fill_diagonal(w, 0)
    return w, np.maximum(w / w.sum(), 1e-12)


def tsne(df: DataFrame, dims: int = 2, *, id_col: str = "id", vector_col: str = "vector", rows: int = 500, perplexity: float = 20.0, steps: int = 300, seed: int = 42) -> tuple[DataFrame, float, float]:
    """((id, y array<double>), divergence at first, divergence at last): a t-SNE map of a sample.

    Every row's place depends on every other's, so the map is of ``rows`` rows drawn by hash, and is
    computed on the driver in memory quadratic in that bound.
    """
    found = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(rows).select(id_col, kernels.as_double(F.col(vector_col))).collect()
    ids, x = [r[0] for r in found], np.array([r[1] for r in found], float)
    p = _affinities(x, min(perplexity, max(2.0, (len(x) - 1) / 3)))
    y = np.random.default_rng(seed).normal(0, 1e-2, (len(x), dims))
    divergence = lambda: float((p * np.log(p / _spread_of(y)[1])).sum())
    first, speed, gain = divergence(), np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        w, q = _spread_of(y)
        force = (p * (4 if step < steps // 3 else 1) - q) * w
        slope = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(0.01, np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2))
        speed = (0.5 if step < steps // 3 else 0.8) * speed - max(len(x) / 12, 20.0) * gain * slope
        y = y + speed
        y -= y.mean(axis=0)
    kind = dict(df.dtypes)[id_col]
    return df.sparkSession.createDataFrame(list(zip(ids, y.tolist())), f"`{id_col}` {kind}, y array<double>"), first, divergence()

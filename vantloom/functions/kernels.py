"""Similarity and distance kernels over two array columns, accumulated in double.

All are built-in higher-order functions, so they compose with any plan. Where one side is a
constant, the ``*_with`` forms unroll into plain arithmetic, which whole-stage codegen compiles.
Arrays of unequal length give null distances rather than an error, unless noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantloom.functions.binding import let

Kernel = Callable[[Column, Column], Column]


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def rounded(x: Column) -> Column:
    """Six decimals, half away from zero, as the queries' SQL rounds doubles: a small negative number becomes -0.0."""
    y = x * 1e6
    near = F.rint(y)
    z = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near) / 1e6
    return F.when(F.isnan(z) | (F.abs(z) == float("inf")), x).otherwise(z)


def _pairs(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(as_double(a), as_double(b), fn)


def dot(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(a), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.aggregate(_pairs(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))


def minkowski(p: float) -> Kernel:
    return lambda a, b: F.pow(total(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def jaccard_similarity(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Over the sets of positions above the threshold; 0 if both are empty."""
    both = total(_pairs(a, b, lambda x, y: ((x > threshold) & (y > threshold)).cast("double")))
    any_ = total(_pairs(a, b, lambda x, y: ((x > threshold) | (y > threshold)).cast("double")))
    return F.when(any_ == 0, 0.0).otherwise(both / any_)


def hamming_bits(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return total(_pairs(a, b, lambda x, y: ((x > threshold) != (y > threshold)).cast("double")))


def hamming_similarity(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return 1 - total(_pairs(a, b, lambda x, y: (F.abs(x - y) > tolerance).cast("double"))) / F.size(a)


def weighted_cosine(weights: list[float]) -> Kernel:
    def fn(a: Column, b: Column) -> Column:
        w = F.array(*(F.lit(float(x)) for x in weights))
        scale = lambda v: F.zip_with(as_double(v), w, lambda x, y: x * F.sqrt(y))
        return cosine_similarity(scale(a), scale(b))

    return fn


def pearson_similarity(a: Column, b: Column) -> Column:
    """(r + 1) / 2; r is 0 where a side has no variance."""
    n = F.size(a).cast("double")
    sa, sb = total(as_double(a)), total(as_double(b))
    cov = n * dot(a, b) - sa * sb
    var = (n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)
    return (F.when(var <= 0, 0.0).otherwise(cov / F.sqrt(var)) + 1) / 2


def index_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of positions above zero."""
    return jaccard_similarity(a, b, 0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length of two strings; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def normalize_l2(v: Column) -> Column:
    """Unit vector; a zero vector is an error."""
    norm = l2_norm(v)
    checked = F.when(norm == 0, F.raise_error(F.lit("cannot normalize a zero vector")).cast("double")).otherwise(norm)
    return let(checked, lambda n: F.transform(as_double(v), lambda x: x / n))


def scaled(v: Column, factor: float) -> Column:
    return F.transform(as_double(v), lambda x: x * factor)


def inverse_score(distance: Column) -> Column:
    return 1 / (1 + distance)


#: Larger is closer: the similarity forms of the metrics.
SIMILARITY: dict[str, Kernel] = {
    "cosine": cosine_similarity,
    "euclidean": lambda a, b: -euclidean(a, b),
    "dot": dot,
    "manhattan": lambda a, b: -manhattan(a, b),
    "jaccard": jaccard_similarity,
}
#: Smaller is closer: the distances that indexes use.
INDEX_DISTANCE: dict[str, Kernel] = {
    "cosine": lambda a, b: 1 - cosine_similarity(a, b),
    "euclidean": euclidean,
    "dot": lambda a, b: -dot(a, b),
    "manhattan": manhattan,
    "jaccard": lambda a, b: 1 - jaccard_similarity(a, b),
    "chebyshev": chebyshev,
    "hamming": hamming_bits,
}
#: Smaller is closer: the distances of exact search.
FLAT_DISTANCE: dict[str, Kernel] = INDEX_DISTANCE | {"dot": lambda a, b: 1 - dot(a, b)}
#: Larger is closer: the scores of a collection.
COLLECTION_SCORE: dict[str, Kernel] = {
    "cosine": cosine_similarity,
    "euclidean": lambda a, b: inverse_score(euclidean(a, b)),
    "dot": dot,
    "manhattan": lambda a, b: inverse_score(manhattan(a, b)),
    "jaccard": jaccard_similarity,
}


def clamped_cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, with the cosine held within [-1, 1]; 1 where a norm is 0."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b)))


def hash_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


# -- One constant side ---------------------------------------------------------------------


def _sum(terms: list[Column]) -> Column:
    """Balanced sum, so that long vectors don't make deep expressions."""
    while len(terms) > 1:
        terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def _cells(v: Column, n: int) -> list[Column]:
    return [F.get(v, F.lit(k)).cast("double") for k in range(n)]


def dot_with(v: Column, q: list[float]) -> Column:
    return _sum([x * F.lit(float(c)) for x, c in zip(_cells(v, len(q)), q)])


def _cosine_with(v: Column, q: list[float]) -> Column:
    own = sum(c * c for c in map(float, q)) ** 0.5
    norms = F.sqrt(_sum([x * x for x in _cells(v, len(q))])) * F.lit(own)
    return F.when(norms == 0, 0.0).otherwise(dot_with(v, q) / norms)


def _euclidean_with(v: Column, q: list[float]) -> Column:
    return F.sqrt(_sum([(x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(_cells(v, len(q)), q)]))


def _manhattan_with(v: Column, q: list[float]) -> Column:
    return _sum([F.abs(x - F.lit(float(c))) for x, c in zip(_cells(v, len(q)), q)])


def _jaccard_with(v: Column, q: list[float]) -> Column:
    return jaccard_similarity(v, F.array(*(F.lit(float(c)) for c in q)))


def score_with(v: Column, q: list[float], metric: str) -> Column:
    """Collection score of a column of vectors against one constant vector."""
    return {
        "cosine": _cosine_with,
        "euclidean": lambda a, b: inverse_score(_euclidean_with(a, b)),
        "dot": dot_with,
        "manhattan": lambda a, b: inverse_score(_manhattan_with(a, b)),
        "jaccard": _jaccard_with,
    }[metric](v, q)


def distance_with(v: Column, q: list[float], metric: str) -> Column:
    """Exact-search distance of a column of vectors from one constant vector."""
    return {
        "cosine": lambda a, b: 1 - _cosine_with(a, b),
        "euclidean": _euclidean_with,
        "dot": lambda a, b: 1 - dot_with(a, b),
        "manhattan": _manhattan_with,
        "jaccard": lambda a, b: 1 - _jaccard_with(a, b),
    }[metric](v, q)

"""Named collections of vectors over Parquet folders: the verbs of a vector database."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from vantloom.operators.search import Collection, SearchOptions, knn_join
from vantloom.sources.files import Tables


class VectorDb:
    """Collections by name. A change is written as a new version, and then becomes the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)
        self.collections: dict[str, tuple[Collection, int]] = {}

    def create(self, name: str, dimension: int, metric: str = "cosine", rows: DataFrame | None = None, schema: str = "id bigint, vector array<float>, metadata string") -> Collection:
        if name in self.collections:
            raise ValueError(f"{name} exists")
        empty = self.spark.createDataFrame([], schema)
        c = Collection(name, dimension, empty, metric)
        return self._store(c if rows is None else c.upsert(rows), 0)

    def _store(self, c: Collection, version: int) -> Collection:
        self.tables.put(c.name, c.df, f"v{version}")
        kept = c.with_rows(self.tables.get(c.name, f"v{version}"))
        self.collections[c.name] = (kept, version)
        return kept

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise KeyError(name)
        return self.collections[name][0]

    def names(self) -> list[str]:
        return sorted(self.collections)

    def drop(self, name: str) -> None:
        self.collections.pop(name)

    def change(self, name: str, how: str, rows: DataFrame) -> Collection:
        """insert, update or delete a batch of rows."""
        c, version = self.get(name), self.collections[name][1]
        verbs = {"insert": c.upsert, "update": c.update, "delete": c.delete}
        return self._store(verbs[how](rows), version + 1)

    def search(self, name: str, vector: list[float], options: SearchOptions | None = None) -> DataFrame:
        return self.get(name).search(vector, options)

    def batch_search(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        c = self.get(name)
        return knn_join(queries, c.df, k, c.metric, id_col=c.id_col, vector_col=c.vector_col)


def chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, a partition at a time: the driver never holds the table."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

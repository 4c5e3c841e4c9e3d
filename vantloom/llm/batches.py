"""Row-wise Python work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from vantloom.runtime import ship, spread


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from ``columns`` (case counts for nothing)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, step: int = 256) -> DataFrame:
    """Apply a function of column lists to ``df`` in slices of ``step`` rows.

    ``make`` runs once in each Python task (models and vocabularies load there) and returns
    a function that takes one list for each column of ``df`` and returns one list for each
    column of ``schema``. Memory is bounded by one Arrow batch plus one slice. No shuffle, but for a
    scan of fewer splits than the cluster has cores, whose rows are dealt out first.
    """
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(parsed)
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    ship(df.sparkSession)
    return spread(df).mapInArrow(run, parsed)

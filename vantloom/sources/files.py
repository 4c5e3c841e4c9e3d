"""File sources and sinks: CSV, JSON, Parquet, text, TSV, fixed width, XML, ORC, YAML, TOML, binary, tensors."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vantloom.runtime import ship

DELIMITERS = (",", ";", "\t", "|")
# Extensions of the formats.
EXTENSIONS = {
    "csv": "csv",
    "tsv": "tsv",
    "json": "json",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "parquet": "parquet",
    "orc": "orc",
    "txt": "text",
    "xml": "xml",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "avro": "avro",
    "xlsx": "excel",
    "bin": "binary",
}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter found most often in the first ten lines; a comma on a tie or without any."""
    lines = [r[0] for r in spark.read.text(path).limit(10).collect()]
    counts = {d: sum(line.count(d) for line in lines) for d in DELIMITERS}
    best = max(counts.values())
    winners = [d for d in DELIMITERS if counts[d] == best]
    return winners[0] if best and len(winners) == 1 else ","


def _head(spark: SparkSession, path: str, size: int = 8) -> bytes:
    """First bytes of a file, or of a folder's first data file, by Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        if not names:
            return b""
        where = spark._jvm.org.apache.hadoop.fs.Path(names[0])
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


class JoinedFiles:
    """A folder's data files as one run of bytes, read by Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        where = self.path(folder)
        self.fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        listed = sorted((s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(where) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        self.names, self.ends, self.size = [n for n, _ in listed], [], 0
        for _, length in listed:
            self.size += length
            self.ends.append(self.size)

    def read(self, begin: int, end: int) -> bytes:
        out = []
        for name, stop, start in zip(self.names, self.ends, [0, *self.ends]):
            a, b = max(begin, start), min(end, stop)
            if a < b:
                stream = self.fs.open(self.path(name))
                try:
                    stream.seek(a - start)
                    out.append(bytes(stream.readNBytes(b - a)))
                finally:
                    stream.close()
        return b"".join(out)


def detect_format(spark: SparkSession, path: str) -> str:
    """By extension, else by content: magic bytes, then the look of the first lines."""
    known = EXTENSIONS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if known:
        return known
    raw = _head(spark, path)
    if raw.startswith(b"PAR1"):
        return "parquet"
    if raw.startswith(b"ORC"):
        return "orc"
    first = next((r[0].strip() for r in spark.read.text(path).limit(10).collect() if r[0].strip()), "")
    if first.startswith(("{", "[")):
        try:
            json.loads(first)
            return "jsonl" if first.startswith("{") else "json"
        except ValueError:
            return "json"
    if first.startswith("<"):
        return "xml"
    return "csv" if any(d in first for d in DELIMITERS) else "text"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, delimiter: str | None = None, header: bool = True, bad_rows: str = "PERMISSIVE") -> DataFrame:
    """CSV by its schema, or with types inferred (integers, then floats, then booleans, then text)."""
    reader = spark.read.option("header", header).option("sep", delimiter or sniff_delimiter(spark, path)).option("mode", bad_rows)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, multiline: bool | None = None) -> DataFrame:
    """One object or array over many lines, or one object a line; told apart by the first line."""
    if multiline is None:
        first = next((r[0].strip() for r in spark.read.text(path).limit(10).collect() if r[0].strip()), "{}")
        try:
            multiline = not isinstance(json.loads(first), dict)
        except ValueError:
            multiline = True
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]]) -> DataFrame:
    """(name, start, length) fields of every line, trimmed; starts count from 0."""
    return spark.read.text(path).select(*(F.trim(F.substring("value", a + 1, n)).alias(name) for name, a, n in fields))


def read_lines(spark: SparkSession, path: str, parser: Callable | None = None) -> DataFrame:
    """Lines of text; ``parser`` takes the line's Column and gives what to select."""
    df = spark.read.text(path)
    return df if parser is None else df.select(parser(F.col("value")))


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def decode_tensors(df: DataFrame, column: str, dtype: str = "<f4") -> DataFrame:
    """``df`` with data array<double>: the bytes of a column as numbers of one kind and byte order."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, dtype).astype(float))

    return df.withColumn("data", decode(column))


def read_tensors(spark: SparkSession, path: str, dtype: str = "<f4", pattern: str | None = None) -> DataFrame:
    """(path, data array<double>) of binary files."""
    return decode_tensors(read_binary(spark, path, pattern), "content", dtype).select("path", "data")


def _parsed(spark: SparkSession, path: str, schema: StructType | str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """Rows of whole files: each is parsed by one task, many files by many tasks. Fields go by name."""
    ship(spark)
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = parse(raw)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pydict({"json": [json.dumps(r, default=str) for r in rows[at : at + 10_000]]})

    found = read_binary(spark, path).select("content").mapInArrow(run, "json string")
    return found.select(F.from_json("json", target).alias("r")).select("r.*")


def read_yaml(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """YAML files that hold a list of mappings, or one mapping."""

    def parse(raw: bytes) -> list[dict]:
        import yaml

        found = yaml.safe_load(raw) or []
        return [r for r in (found if isinstance(found, list) else [found]) if isinstance(r, dict)]

    return _parsed(spark, path, schema, parse)


def read_toml(spark: SparkSession, path: str, schema: StructType | str, table: str = "row") -> DataFrame:
    """TOML files with an array of tables ``[[table]]``; without one, the file is one row."""

    def parse(raw: bytes) -> list[dict]:
        import tomllib

        found = tomllib.loads(raw.decode())
        return found[table] if isinstance(found.get(table), list) else [found]

    return _parsed(spark, path, schema, parse)


def _scalar(name: str, kind: str):
    """JSON text of a scalar, which YAML and TOML read alike; null for null. YAML's exponents have a sign."""
    found = F.regexp_replace(F.to_json(F.struct(F.col(name).alias("x"))), r'^\{("x":)?|\}$', "")
    return F.regexp_replace(found, r"E(\d)", r"E+$1") if kind in ("double", "float") else found


def write_yaml(df: DataFrame, path: str, mode: str = "error") -> None:
    """A list item a row; nulls are left out."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), _scalar(c, k))) for c, k in df.dtypes]
    df.select(F.concat(F.lit("- "), F.concat_ws("\n  ", *fields)).alias("value")).write.mode(mode).text(path)


def write_toml(df: DataFrame, path: str, table: str = "row", mode: str = "error") -> None:
    """A table of the array ``[[table]]`` a row; nulls are left out."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = "), _scalar(c, k))) for c, k in df.dtypes]
    df.select(F.concat(F.lit(f"[[{table}]]\n"), F.concat_ws("\n", *fields)).alias("value")).write.mode(mode).text(path)


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """By format; those without a reader here raise an error that names them."""
    from vantloom.sources import formats

    kind = kind or detect_format(spark, path)
    readers = {
        "csv": lambda: read_csv(spark, path, **options),
        "tsv": lambda: read_csv(spark, path, delimiter="\t", **options),
        "json": lambda: read_json(spark, path, **options),
        "jsonl": lambda: read_json(spark, path, multiline=False, **options),
        "parquet": lambda: spark.read.parquet(path),
        "orc": lambda: spark.read.orc(path),
        "text": lambda: read_lines(spark, path),
        "xml": lambda: spark.read.format("xml").options(**options).load(path),
        "binary": lambda: read_binary(spark, path),
        "yaml": lambda: read_yaml(spark, path, **options),
        "toml": lambda: read_toml(spark, path, **options),
        "avro": lambda: formats.read_avro(spark, path, **options),
        "excel": lambda: formats.read_excel(spark, path, **options),
    }
    if kind not in readers:
        raise ValueError(f"no reader for {kind}")
    return readers[kind]()


def read_memory(spark: SparkSession, records: list[dict], schema: StructType | str | None = None, cache: bool = False) -> DataFrame:
    df = spark.createDataFrame(records, schema) if schema is not None else spark.createDataFrame(pd.DataFrame(records))
    return df.cache() if cache else df


def write(df: DataFrame, path: str, kind: str = "parquet", *, mode: str = "error", rows_per_file: int | None = None, partition_by: list[str] | None = None, **options) -> None:
    """CSV, JSON, Parquet, ORC or text; ``rows_per_file`` splits the output."""
    writer = df.write.mode(mode).options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def read_jdbc(spark: SparkSession, url: str, source: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties) -> DataFrame:
    """A table or (select) of a database, read in ``parts`` ranges of a numeric column; its driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**properties)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


class Tables:
    """Named Parquet tables under one folder, with snapshots: a small catalogue of versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, version: str = "current") -> str:
        return f"{self.root}/{name}/{version}"

    def put(self, name: str, df: DataFrame, version: str = "current", mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(self.path(name, version))

    def get(self, name: str, version: str = "current") -> DataFrame:
        return self.spark.read.parquet(self.path(name, version))

    def snapshot(self, name: str, version: str) -> None:
        self.put(name, self.get(name), version, "error")

    def scan(self, name: str, key: str, prefix: str) -> DataFrame:
        return self.get(name).filter(F.startswith(F.col(key), F.lit(prefix)))

    def alive(self, name: str, at: str, ttl_seconds: int) -> DataFrame:
        """Rows younger than the time to live, by a timestamp column."""
        return self.get(name).filter(F.col(at) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.current_timestamp())

"""Queries over ``events`` as a stream's content, sources and sinks, and user-defined surfaces."""

from __future__ import annotations

import functools
import sqlite3
import tempfile
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom import api
from vantloom.functions import dsl
from vantloom.queries import query
from vantloom.runtime import scratch, ship, table
from vantloom.operators import database
from vantloom.sources import files, formats
from vantloom.streaming import http_lines, streams


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a stream."""
    schema = _events(spark, sf).schema
    return spark.readStream.schema(schema).parquet(_folder(spark, sf))


def _folder(spark: SparkSession, sf: str) -> str:
    # A stream reads folders: the table is written as two files.
    out = scratch(spark, "events")
    _events(spark, sf).repartition(2, "event_id").write.parquet(out)
    return out


def _ran(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return streams.run_to_table(stream, f"t{uuid.uuid4().hex}", mode, scratch(spark, "checkpoint"))


@query("w1_file_stream", "SELECT event_id, user_id, event_type FROM events")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "csv")
    files.write(_events(spark, sf).select("event_id", "user_id", "event_type"), out, "csv", header=True)
    stream = streams.file_stream(spark, out, "event_id bigint, user_id bigint, event_type string", "csv", 4, header=True)
    return streams.run_to_files(stream, scratch(spark, "rows"), scratch(spark, "checkpoint"))


@query("x12_json_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "json")
    files.write(_events(spark, sf).select("event_id", "event_type"), out, "json")
    found = streams.file_stream(spark, out, "event_id bigint, event_type string", "json", 4)
    return _ran(spark, found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


class _Lines(BaseHTTPRequestHandler):
    """Serves one text by byte ranges: what ``read(begin, end)`` gives of ``size()`` bytes."""

    read = staticmethod(lambda begin, end: b"")
    size = staticmethod(lambda: 0)

    def do_HEAD(self) -> None:
        self.send_response(200)
        self.send_header("Content-Length", str(self.size()))
        self.end_headers()

    def do_GET(self) -> None:
        a, b = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
        part = self.read(a, b + 1)
        self.send_response(206)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args) -> None:
        pass


@query("x12_http_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def x12_http(spark: SparkSession, sf: str) -> DataFrame:
    """All events from a server of this process, as a stand-in for a remote one: it hands on the bytes of written files."""
    out = scratch(spark, "lines")
    _events(spark, sf).select(F.to_json(F.struct("event_id", "event_type")).alias("j")).write.text(out)
    joined = files.JoinedFiles(spark, out)
    handler = type("Lines", (_Lines,), {"read": staticmethod(joined.read), "size": staticmethod(lambda: joined.size)})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        stream = http_lines.http_stream(spark, f"http://127.0.0.1:{server.server_address[1]}/events", "event_id bigint, event_type string", chunk=1 << 18)
        found = streams.run_to_files(stream, scratch(spark, "rows"), scratch(spark, "checkpoint"))
    finally:
        server.shutdown()
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w2_batch_processor", "SELECT event_type, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "processed")
    p = streams.Processor(lambda batch, number: batch.filter("value > 0").write.mode("overwrite").parquet(f"{out}/batch={number}"))
    p.start(_stream(spark, sf), scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w3_cumulative_aggregator", "SELECT event_type, count(value) AS value_count, round(sum(value), 4) AS value_sum FROM events GROUP BY event_type")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return _ran(spark, streams.cumulative(_stream(spark, sf), ["value"], ["event_type"]), "complete").withColumn("value_sum", F.round("value_sum", 4))


@query("w6_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    found = streams.windowed(_stream(spark, sf), "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], by=["event_type"])
    return _ran(spark, found, "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("w6_sliding_windows", "WITH s AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) SELECT strftime(w, '%Y-%m-%d %H') AS start, count(*) AS n FROM s GROUP BY w")
def w6_sliding(spark: SparkSession, sf: str) -> DataFrame:
    found = streams.windowed(_events(spark, sf), "ts", "24 hours", [F.count(F.lit(1)).alias("n")], slide="12 hours")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "n")


@query(
    "w6_session_windows",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def w6_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = streams.sessions(_events(spark, sf), "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("w6_custom_state", "SELECT event_type, count(*) AS n, round(max(value), 6) AS highest FROM events GROUP BY event_type")
def w6_state(spark: SparkSession, sf: str) -> DataFrame:
    found = _ran(spark, streams.running_state(_stream(spark, sf), "event_type", "value"), "update")
    return found.groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.max("highest"), 6).alias("highest"))


# -- Sources and sinks -----------------------------------------------------------------------


def _round_trip(name: str, kind: str, **options) -> None:
    @query(name, "SELECT c_custkey, c_name, c_mktsegment FROM customer")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = scratch(spark, kind)
        files.write(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), out, kind, rows_per_file=500, **options)
        schema = "c_custkey bigint, c_name string, c_mktsegment string"
        readers = {"csv": lambda: files.read_csv(spark, out, schema), "json": lambda: files.read_json(spark, out, schema, multiline=False), "orc": lambda: files.read_any(spark, out, "orc"), "parquet": lambda: files.read_any(spark, out, "parquet"), "xml": lambda: spark.read.schema(schema).option("rowTag", "c").format("xml").load(out)}
        return readers[kind]()


def _text_round_trip(name: str, write, read) -> None:
    @query(name, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = scratch(spark, name)
        write(table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal", "c_custkey % 2 = 0 AS even"), out)
        return read(spark, out, "c_custkey bigint, c_name string, c_acctbal double, even boolean")


_text_round_trip("x7_yaml_round_trip", files.write_yaml, files.read_yaml)
_text_round_trip("x7_toml_round_trip", files.write_toml, files.read_toml)
_text_round_trip("x5_excel_round_trip", formats.write_excel, formats.read_excel)
_text_round_trip("x4_avro_round_trip", formats.write_avro, lambda spark, out, schema: formats.read_avro(spark, out))


@query("x10_database_upsert", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE n_regionkey END::INTEGER AS n_regionkey FROM nation")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    """Half of a table into a database, then all of it by key, and read back in ranges: a local file stands in for a server."""
    path = f"{tempfile.mkdtemp(prefix='vantloom-db-')}/t.db"
    connect = functools.partial(sqlite3.connect, path, timeout=60)
    with connect() as c:
        c.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
    df = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1)
    formats.write_database(df.filter("n_nationkey < 12"), connect, "nation", "replace")
    even = df.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, -1).otherwise(F.col("n_regionkey")))
    formats.write_database(even, connect, "nation", "upsert", ["n_nationkey"])
    return formats.read_database(spark, connect, "SELECT * FROM nation", "n_nationkey int, n_name string, n_regionkey int", column="n_nationkey", low=0, high=25, parts=4)


@query("x16_api_calls", "SELECT 1 AS step, 201 AS status, 'p2' AS seen UNION ALL SELECT 2, 200, '3' UNION ALL SELECT 3, 200, 'a' UNION ALL SELECT 4, 200, '1' UNION ALL SELECT 5, 404, 'none' UNION ALL SELECT 6, 200, '2'")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    """Create a collection, add vectors, search, delete, ask for what is gone, count."""
    calls = api.Api(database.VectorDb(spark, scratch(spark, "api")), 2)
    vectors = [{"id": "a", "vector": [1, 0]}, {"id": "b", "vector": [0, 1]}, {"id": "c", "vector": [1, 1], "metadata": {"k": 1}}]
    asked = [
        ("POST", "/collections", {"name": "p2", "dimension": 2}, lambda r: r["name"]),
        ("POST", "/collections/p2/batch", {"operations": [{"op": "insert", "vectors": vectors}]}, lambda r: r["results"][0]["inserted"]),
        ("POST", "/collections/p2/search", {"vector": [2, 0.1], "top_k": 1}, lambda r: r["results"][0]["id"]),
        ("DELETE", "/collections/p2/vectors/a", None, lambda r: r["deleted"]),
        ("GET", "/collections/p2/vectors/a", None, lambda r: "none" if "error" in r else "found"),
        ("GET", "/collections/p2/stats", None, lambda r: r["vectors"]),
    ]
    rows = []
    for step, (method, path, body, seen) in enumerate(asked, 1):
        status, found = calls.handle(method, f"/api/v1{path}", body)
        rows.append((step, status, str(seen(found))))
    return spark.createDataFrame(rows, "step int, status int, seen string")


_round_trip("x1_csv_round_trip", "csv", header=True, sep=";")
_round_trip("x2_json_round_trip", "json")
_round_trip("x3_parquet_round_trip", "parquet")
_round_trip("x7_orc_round_trip", "orc")
_round_trip("x7_xml_round_trip", "xml", rowTag="c")


@query("x6_text_lines", "SELECT count(*) AS n FROM documents")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "text")
    table(spark, sf, "documents").select(F.md5("text").alias("value")).write.text(out)
    return files.read_lines(spark, out).agg(F.count(F.lit(1)).alias("n"))


@query("x7_fixed_width", "SELECT rpad(c_name, 20, ' ')[1:8] AS head, trim(c_name[9:20]) AS tail FROM customer")
def x7_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "fixed")
    table(spark, sf, "customer").select(F.rpad("c_name", 20, " ").alias("value")).write.text(out)
    return files.read_fixed_width(spark, out, [("head", 0, 8), ("tail", 8, 12)])


@query("x15_table_snapshot", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    t = files.Tables(spark, scratch(spark, "tables"))
    t.put("customer", table(spark, sf, "customer").select("c_custkey", "c_name"))
    t.snapshot("customer", "v1")
    t.put("customer", table(spark, sf, "customer").select("c_custkey", "c_name").limit(0))
    return t.get("customer", "v1").filter(F.startswith("c_name", F.lit("Customer#00000001")))


@query("x8_format_detection", "SELECT * FROM (VALUES ('csv', 'csv'), ('json', 'jsonl'), ('orc', 'orc'), ('parquet', 'parquet')) AS t(written, found)")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for kind in ("csv", "json", "orc", "parquet"):
        out = scratch(spark, "plain")  # no extension: told by content
        files.write(table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1), out, kind)
        rows.append((kind, files.detect_format(spark, out)))
    return spark.createDataFrame(rows, "written string, found string")


@query("x9_tensor_files", "SELECT count(*) AS n, 64 AS size FROM embeddings")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    df = table(spark, sf, "embeddings").select("embedding")

    @F.pandas_udf("binary")
    def raw(v: pd.Series) -> pd.Series:
        return v.map(lambda x: x.astype("<f4").tobytes())

    decoded = files.decode_tensors(df.select(raw("embedding").alias("content")), "content", "<f4")
    return decoded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("data")).alias("size"))


@query("x13_memory_records", "SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b'")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_memory(spark, [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], "id int, name string")


@query("x14_split_export", "SELECT count(*) AS n, true AS split FROM orders")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "export")
    files.write(table(spark, sf, "orders").select("o_orderkey").coalesce(1), out, "json", rows_per_file=1000)
    back = spark.read.schema("o_orderkey bigint").json(out).select("o_orderkey", F.input_file_name().alias("f"))
    return back.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("f") > 1).alias("split"))


@query("w4_stream_progress", "SELECT count(*) AS rows, 0 AS errors, true AS timed FROM events")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    p = streams.Processor(lambda batch, number: None)
    p.start(_stream(spark, sf), scratch(spark, "checkpoint")).awaitTermination()
    g = p.progress
    timed = g.rows_per_second > 0 and 0 < g.mean_ms <= 1000 * g.slowest and g.error_share == 0
    return spark.createDataFrame([(g.rows, g.errors, timed)], "rows bigint, errors int, timed boolean")


# -- User-defined surfaces --------------------------------------------------------------------


@query("u1_vector_udf", "SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 6) AS x FROM part")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    ship(spark)

    @F.pandas_udf("double")
    def priced(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * 1.1 + size

    return df.select("p_partkey", F.round(priced("p_retailprice", "p_size"), 6).alias("x"))


@query("u2_value_scripts", "SELECT p_partkey, round(p_retailprice * 2 + 1, 6) AS x FROM part")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(dsl.script(F.col("p_retailprice"), "value * 2 + 1"), 6).alias("x"))


@query("u3_tensor_program", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, list_transform(v, lambda x: round(greatest(x * 2 + 0.1, 0), 6)) AS y FROM e")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    program = dsl.compile_program("s = mul(x, 2)\nt = add(s, 0.1)\nout = relu(t)")
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return df.select("vec_id", F.transform(program({"x": F.col("v")}), lambda x: F.round(x, 6)).alias("y"))


@query("u4_table_function", "SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 6) AS top FROM customer GROUP BY c_mktsegment")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)

    def partial(frames):
        for f in frames:
            yield f.groupby("c_mktsegment", as_index=False).agg(n=("c_acctbal", "size"), top=("c_acctbal", "max"))

    parts = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal").mapInPandas(partial, "c_mktsegment string, n bigint, top double")
    return parts.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.max("top"), 6).alias("top"))


@query("u6_custom_aggregator", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean FROM lineitem GROUP BY l_returnflag")
def u6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.log("l_extendedprice"))), 4).alias("geometric_mean"))

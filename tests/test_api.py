import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from vantloom import api
from vantloom.operators import database
from vantloom.plans.stream_queries import _Lines
from vantloom.sources import files
from vantloom.streaming import http_lines, streams


@pytest.fixture()
def calls(spark, tmp_path):
    return api.Api(database.VectorDb(spark, str(tmp_path)), 3)


def test_every_route(calls):
    go = lambda method, path, body=None: calls.handle(method, f"/api/v1{path}", body)
    assert go("GET", "/health") == (200, {"status": "ok"})
    assert go("POST", "/vectors", {"id": "a", "vector": [1, 0, 0], "metadata": {"k": 1}}) == (201, {"id": "a"})
    assert go("POST", "/vectors/batch", {"vectors": [{"id": k, "vector": [0, k, 1]} for k in range(5)]}) == (201, {"inserted": 5})
    assert go("GET", "/vectors/count") == (200, {"count": 6})
    assert go("GET", "/vectors/a") == (200, {"id": "a", "vector": [1.0, 0.0, 0.0], "metadata": {"k": 1}})
    status, found = go("POST", "/vectors/search", {"vector": [0, 4, 1], "top_k": 2})
    assert status == 200 and [r["id"] for r in found["results"]] == ["4", "3"]
    assert go("POST", "/vectors/rebuild-index")[0] == 200
    assert go("POST", "/vectors/batch/delete", {"ids": [0, 1, 77]}) == (200, {"deleted": 2})
    assert go("DELETE", "/vectors/2") == (200, {"deleted": 1})
    assert go("GET", "/vectors/2")[0] == 404 and go("DELETE", "/vectors/2")[0] == 404
    assert go("POST", "/vectors", {"id": "z", "vector": [1]})[0] == 400
    assert go("POST", "/vectors/search", {"vector": [1, 2, 3], "top_k": 0})[0] == 400
    assert go("POST", "/collections", {"name": "c", "dimension": 2})[0] == 201
    assert go("POST", "/collections", {"name": "c", "dimension": 2})[0] == 409
    assert go("POST", "/collections", {"name": "d"})[0] == 400
    assert go("GET", "/collections") == (200, {"collections": ["c", "default"]})
    assert go("POST", "/collections/c/rebuild")[0] == 409
    assert go("POST", "/collections/c/vectors", {"id": 1, "vector": [1, 2]})[0] == 201
    assert go("GET", "/collections/c/vectors/1")[1]["vector"] == [1.0, 2.0]
    assert go("GET", "/collections/c")[1]["count"] == 1
    status, found = go("POST", "/collections/c/batch", {"operations": [{"op": "insert", "vectors": [{"id": 2, "vector": [2, 1]}]}, {"op": "search", "vector": [2, 1], "top_k": 1}, {"op": "delete", "ids": [1]}]})
    assert status == 200 and found["results"][1]["results"][0]["id"] == "2" and found["results"][2] == {"deleted": 1}
    assert go("POST", "/collections/c/batch", {"operations": [{"op": "what"}]})[0] == 400
    assert go("POST", "/collections/c/search", {"vector": [1, 1]})[1]["results"][0]["id"] == "2"
    assert go("POST", "/collections/c/rebuild") == (200, {"indexed": 1, "lists": 1})
    assert go("GET", "/collections/c/stats")[1] == {"vectors": 1, "avg_dim": 2.0, "min_dim": 2, "max_dim": 2, "indexed": True}
    assert go("DELETE", "/collections/c/vectors/2") == (200, {"deleted": 1})
    assert go("DELETE", "/collections/c") == (200, {"deleted": "c"})
    assert go("GET", "/collections/c")[0] == 404 and go("PUT", "/nowhere")[0] == 404


def test_over_http(calls):
    server = api.serve(calls)
    base = f"http://127.0.0.1:{server.server_address[1]}/api/v1"
    try:
        ask = urllib.request.Request(f"{base}/vectors", json.dumps({"id": "x", "vector": [1, 2, 3]}).encode(), method="POST")
        with urllib.request.urlopen(ask, timeout=60) as answer:
            assert answer.status == 201 and json.loads(answer.read()) == {"id": "x"}
        with pytest.raises(urllib.error.HTTPError, match="404"):
            urllib.request.urlopen(f"{base}/vectors/none", timeout=60)
        with pytest.raises(urllib.error.HTTPError, match="400"):
            urllib.request.urlopen(urllib.request.Request(f"{base}/vectors", b"{broken", method="POST"), timeout=60)
    finally:
        server.shutdown()


@pytest.fixture()
def lines():
    handler = type("Lines", (_Lines,), {"body": b""})
    handler.read, handler.size = staticmethod(lambda a, b: handler.body[a:b]), staticmethod(lambda: len(handler.body))
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield handler, f"http://127.0.0.1:{server.server_address[1]}/x"
    server.shutdown()


@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_ranges_own_the_lines_that_begin_in_them(lines, chunk):
    from pyspark.sql.types import StructType

    handler, url = lines
    handler.body = b"".join(json.dumps({"n": k, "t": "é" * (k % 40)}).encode() + b"\n" for k in range(30)) + b'not json\n[1]\n{"n": 99}\n{"n": 100, "cut'
    reader = http_lines.Reader(StructType.fromDDL("n bigint, t string"), {"path": url, "chunk": str(chunk)})
    end = reader.latestOffset()
    assert handler.body[: end["at"]].endswith(b'{"n": 99}\n')
    got = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert got == [(k, "é" * (k % 40)) for k in range(30)] + [(99, None)]


def test_a_growing_address_goes_on_where_it_was(spark, lines, tmp_path):
    handler, url = lines
    seen = []
    for more in (b'{"n": 1}\n{"n": 2}\n', b'{"n": 3}\n', b""):
        handler.body += more
        stream = http_lines.http_stream(spark, url, "n bigint", chunk=5)
        seen.append(sorted(r.n for r in streams.run_to_files(stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").collect()))
    assert seen == [[1, 2], [1, 2, 3], [1, 2, 3]]


def test_yaml_and_toml(spark, tmp_path):
    rows = [(1, 'quote " and \\ back', 1.5, True), (2, "- dash: colon # hash", None, False), (3, "", float("1e20"), None), (4, "é\n漢 tab\t", -0.25, True)]
    df = spark.createDataFrame(rows, "n bigint, s string, x double, b boolean")
    for write, read in ((files.write_yaml, files.read_yaml), (files.write_toml, files.read_toml)):
        out = f"{tmp_path}/{write.__name__}"
        write(df, out)
        assert sorted(tuple(r) for r in read(spark, out, "n bigint, s string, x double, b boolean").collect()) == rows

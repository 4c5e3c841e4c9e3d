"""The verbs of the vector database behind HTTP paths: vectors, collections, search, batches.

``Api.handle`` takes a method, a path and a body and gives a status and an answer; ``serve`` puts a
plain HTTP server before it. Every verb is a DataFrame plan; only answers of bounded size (one
vector, a top k, counts, names) come to the driver.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from vantloom.operators import ann
from vantloom.operators.database import VectorDb
from vantloom.operators.search import SearchOptions

DEFAULT = "default"
MAX_TOP_K = 1_000
SCHEMA = "id string, vector array<float>, metadata string"


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Api:
    """Routes over one database; ``/vectors`` are those of the collection ``default``."""

    def __init__(self, db: VectorDb, dimension: int):
        self.db, self.lock, self.indexes = db, threading.Lock(), {}
        if DEFAULT not in db.names():
            db.create(DEFAULT, dimension, schema=SCHEMA)
        own = lambda fn: lambda body, **at: fn(body, name=DEFAULT, **at)
        routes: list[tuple[str, str, Callable]] = [
            ("GET", "/health", lambda body: (200, {"status": "ok"})),
            ("POST", "/vectors", own(self.add)),
            ("POST", "/vectors/batch", own(self.add_batch)),
            ("POST", "/vectors/batch/delete", own(self.delete_batch)),
            ("POST", "/vectors/search", own(self.search)),
            ("GET", "/vectors/count", own(self.count)),
            ("POST", "/vectors/rebuild-index", own(self.rebuild)),
            ("GET", "/vectors/{id}", own(self.get)),
            ("DELETE", "/vectors/{id}", own(self.delete)),
            ("POST", "/collections", self.create),
            ("GET", "/collections", lambda body: (200, {"collections": self.db.names()})),
            ("GET", "/collections/{name}", self.describe),
            ("DELETE", "/collections/{name}", self.drop),
            ("GET", "/collections/{name}/stats", self.stats),
            ("POST", "/collections/{name}/rebuild", self.rebuild),
            ("POST", "/collections/{name}/vectors", self.add),
            ("GET", "/collections/{name}/vectors/{id}", self.get),
            ("DELETE", "/collections/{name}/vectors/{id}", self.delete),
            ("POST", "/collections/{name}/search", self.search),
            ("POST", "/collections/{name}/batch", self.batch),
        ]
        self.routes = [(method, re.compile("/api/v1" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + "$"), fn) for method, path, fn in routes]

    def handle(self, method: str, path: str, body: Any = None) -> tuple[int, dict]:
        for verb, pattern, fn in self.routes:
            if verb == method and (m := pattern.match(path)):
                try:
                    return fn(body or {}, **m.groupdict())
                except Refused as e:
                    return e.status, {"error": str(e)}
        return 404, {"error": f"no route {method} {path}"}

    def _collection(self, name: str):
        try:
            return self.db.get(name)
        except KeyError:
            raise Refused(404, f"no collection {name}") from None

    def _rows(self, name: str, vectors: list[dict]):
        c = self._collection(name)
        for v in vectors:
            if not isinstance(v.get("vector"), list) or len(v["vector"]) != c.dimension or "id" not in v:
                raise Refused(400, f"a vector needs an id and {c.dimension} numbers")
        rows = [(str(v["id"]), [float(x) for x in v["vector"]], json.dumps(v["metadata"]) if v.get("metadata") is not None else None) for v in vectors]
        return self.db.spark.createDataFrame(rows, SCHEMA)

    def _change(self, name: str, how: str, rows) -> None:
        with self.lock:
            self.db.change(name, how, rows)
            self.indexes.pop(name, None)

    def create(self, body: dict) -> tuple[int, dict]:
        name, dimension = body.get("name"), body.get("dimension")
        if not name or not isinstance(dimension, int) or dimension < 1:
            raise Refused(400, "a collection needs a name and a dimension")
        if name in self.db.names():
            raise Refused(409, f"{name} exists")
        self.db.create(name, dimension, body.get("metric", "cosine"), schema=SCHEMA)
        return 201, {"name": name, "dimension": dimension}

    def describe(self, body: dict, name: str) -> tuple[int, dict]:
        c = self._collection(name)
        return 200, {"name": name, "dimension": c.dimension, "metric": c.metric, "count": c.count()}

    def drop(self, body: dict, name: str) -> tuple[int, dict]:
        self._collection(name)
        with self.lock:
            self.db.drop(name)
            self.indexes.pop(name, None)
        return 200, {"deleted": name}

    def stats(self, body: dict, name: str) -> tuple[int, dict]:
        c = self._collection(name)
        return 200, {**c.stats().first().asDict(), "indexed": name in self.indexes}

    def count(self, body: dict, name: str) -> tuple[int, dict]:
        return 200, {"count": self._collection(name).count()}

    def add(self, body: dict, name: str) -> tuple[int, dict]:
        self._change(name, "insert", self._rows(name, [body]))
        return 201, {"id": str(body["id"])}

    def add_batch(self, body: dict, name: str) -> tuple[int, dict]:
        vectors = body.get("vectors", [])
        self._change(name, "insert", self._rows(name, vectors))
        return 201, {"inserted": len(vectors)}

    def get(self, body: dict, name: str, id: str) -> tuple[int, dict]:
        found = self._collection(name).get([id]).head(1)
        if not found:
            raise Refused(404, f"no vector {id}")
        r = found[0]
        return 200, {"id": r["id"], "vector": list(r["vector"]), "metadata": json.loads(r["metadata"]) if r["metadata"] else None}

    def delete(self, body: dict, name: str, id: str) -> tuple[int, dict]:
        if not self._collection(name).get([id]).head(1):
            raise Refused(404, f"no vector {id}")
        return self.delete_batch({"ids": [id]}, name)

    def delete_batch(self, body: dict, name: str) -> tuple[int, dict]:
        ids = self.db.spark.createDataFrame([(str(i),) for i in body.get("ids", [])], "id string")
        known = self._collection(name).df.join(ids, "id", "left_semi").count()
        self._change(name, "delete", ids)
        return 200, {"deleted": known}

    def search(self, body: dict, name: str) -> tuple[int, dict]:
        c, k = self._collection(name), int(body.get("top_k", 10))
        vector = body.get("vector")
        if not isinstance(vector, list) or len(vector) != c.dimension or not 1 <= k <= MAX_TOP_K:
            raise Refused(400, f"a search needs {c.dimension} numbers and a top_k within 1 and {MAX_TOP_K}")
        found = c.search([float(x) for x in vector], SearchOptions(limit=k, metric=body.get("metric", c.metric)))
        return 200, {"results": [{"id": r["id"], "score": r["score"]} for r in found.collect()]}

    def rebuild(self, body: dict, name: str) -> tuple[int, dict]:
        """Writes inverted lists of the collection and opens them."""
        c = self._collection(name)
        n = c.count()
        if not n:
            raise Refused(409, "nothing to index")
        config = ann.IndexConfig("ivf", c.metric if c.metric in ("cosine", "euclidean") else "cosine").resolved(n, c.dimension)
        path = f"{self.db.tables.root}/{name}-index"
        ann.Ivf(c.df, replace(config, lists=min(config.lists, n))).save(path)
        self.indexes[name] = ann.Ivf.load(self.db.spark, path)
        return 200, {"indexed": n, "lists": len(self.indexes[name].centroids)}

    def batch(self, body: dict, name: str) -> tuple[int, dict]:
        """Operations in order: insert (vectors), delete (ids) or search (vector)."""
        verbs = {"insert": self.add_batch, "delete": self.delete_batch, "search": self.search}
        out = []
        for op in body.get("operations", []):
            if op.get("op") not in verbs:
                raise Refused(400, f"no operation {op.get('op')}")
            out.append(verbs[op["op"]](op, name)[1])
        return 200, {"results": out}


def serve(api: Api, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server in threads of its own; ``server_address`` tells its port, ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, found = api.handle(self.command, self.path.split("?")[0], json.loads(raw) if raw else None)
            except ValueError as e:
                status, found = 400, {"error": str(e)}
            text = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server

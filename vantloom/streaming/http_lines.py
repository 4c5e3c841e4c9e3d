"""JSON lines behind an HTTP address as a stream.

The address serves a text that only grows at its end, and answers HEAD with its length and GET with
byte ranges. An offset is a byte position after a line's end. Each micro-batch is cut into ranges
of ``chunk`` bytes that executors fetch on their own: a range owns the lines that begin in it.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 4 << 20
TIMEOUT = 30


def size_of(url: str) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
        return int(answer.headers["Content-Length"])


def fetch(url: str, begin: int, end: int) -> bytes:
    """Bytes from ``begin`` to before ``end``."""
    if begin >= end:
        return b""
    ask = urllib.request.Request(url, headers={"Range": f"bytes={begin}-{end - 1}"})
    with urllib.request.urlopen(ask, timeout=TIMEOUT) as answer:
        body = answer.read()
        return body if answer.status == 206 else body[begin:end]


def last_line_end(url: str, begin: int, size: int) -> int:
    """Position after the last line end before ``size``, or ``begin`` where there is none."""
    step, stop = 1 << 16, size
    while stop > begin:
        start = max(begin, stop - step)
        at = fetch(url, start, stop).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return begin


@dataclass
class Range(InputPartition):
    begin: int
    end: int
    limit: int


class Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.url, self.chunk = schema.fieldNames(), options["path"], int(options.get("chunk", CHUNK))
        self.known = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.known = last_line_end(self.url, self.known, size_of(self.url))
        return {"at": self.known}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(a, min(a + self.chunk, end["at"]), end["at"]) for a in range(start["at"], end["at"], self.chunk)]

    def read(self, part: Range) -> Iterator[tuple]:
        # The byte before tells whether the range begins with a line; its last line is read to the end.
        begin = part.begin - 1 if part.begin else 0
        text, stop = fetch(self.url, begin, part.end), part.end
        while not text.endswith(b"\n") and stop < part.limit:
            more = fetch(self.url, stop, min(part.limit, stop + (1 << 16)))
            cut = more.find(b"\n")
            text, stop = text + (more if cut < 0 else more[: cut + 1]), stop + len(more)
            if cut >= 0:
                break
        if part.begin:
            text = text[text.find(b"\n") + 1 :] if b"\n" in text else b""
        for line in text.splitlines():
            try:
                row = json.loads(line)
            except ValueError:  # lines that do not parse are dropped, as in the file streams
                continue
            if isinstance(row, dict):
                yield tuple(row.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        pass


class HttpLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        raise ValueError("http_lines needs a schema")

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def http_stream(spark: SparkSession, url: str, schema: StructType | str, chunk: int = CHUNK) -> DataFrame:
    """Objects of the address's lines as a stream; fields by name, missing ones null."""
    from vantloom.runtime import ship

    ship(spark)
    spark.dataSource.register(HttpLines)
    return spark.readStream.format("http_lines").schema(schema).option("chunk", chunk).load(url)

"""Excel workbooks, Avro containers and databases behind a DB-API driver.

Whole files are parsed by one task each, many files by many tasks, and written by the executors
through ``pyarrow.fs``, so any store it knows will do. Databases are read in ranges of a numeric
column, one connection a task.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from vantloom.runtime import ship
from vantloom.sources.files import _head, _parsed, read_binary

# -- Excel ----------------------------------------------------------------------------------

# Namespaces and limits of the workbook format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MAX_SHEET_ROWS = 1_048_576


def _column(name: str) -> int:
    """Number of a cell's column from 0, by the letters it begins with."""
    n = 0
    for ch in re.match("[A-Z]+", name)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def sheet_rows(raw: bytes, sheet: str | None = None) -> Iterator[list]:
    """Cells of every row of a sheet (the first, if unnamed): numbers, booleans, text, None."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    tag = lambda name: f"{{{MAIN}}}{name}"
    strings: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(tag("si")):
            strings.append("".join(t.text or "" for t in item.iter(tag("t"))))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): targets[s.get(f"{{{RELATIONS}}}id")] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(tag("sheet"))}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet {sheet}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != tag("row"):
                continue
            cells: list = []
            for c in row.iter(tag("c")):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                kind, value = c.get("t", "n"), c.findtext(tag("v"))
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(tag("t"))))
                elif value is None or kind == "e":
                    cells.append(None)
                elif kind == "s":
                    cells.append(strings[int(value)])
                elif kind == "b":
                    cells.append(value == "1")
                elif kind == "n":
                    cells.append(int(value) if re.fullmatch(r"-?\d+", value) else float(value))
                else:
                    cells.append(value)
            yield cells
            row.clear()


def workbook(names: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """One sheet with a header row; nothing dated, so equal rows give equal bytes."""

    def cell(at: str, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'

    lines = [f'<row r="{k}">' + "".join(cell(f"{_letters(j)}{k}", v) for j, v in enumerate(r)) + "</row>" for k, r in enumerate([tuple(names), *rows], 1)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), head + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_excel(spark: SparkSession, path: str, schema: StructType | str, sheet: str | None = None, header_row: int = 0) -> DataFrame:
    """Rows below the header row of every workbook; fields by the header's names, missing ones null."""

    def parse(raw: bytes) -> list[dict]:
        rows = list(sheet_rows(raw, sheet))
        names = [str(n) for n in rows[header_row]] if len(rows) > header_row else []
        return [dict(zip(names, r)) for r in rows[header_row + 1 :]]

    return _parsed(spark, path, schema, parse)


def write_excel(df: DataFrame, path: str, rows_per_file: int = MAX_SHEET_ROWS - 1) -> int:
    """Workbooks in a folder, one or more a partition; gives the number of files."""
    return write_files(df, path, "xlsx", lambda names, rows: workbook(names, rows), rows_per_file)


def write_files(df: DataFrame, path: str, extension: str, encode: Callable[[list[str], list[tuple]], bytes], rows_per_file: int) -> int:
    """Files that ``encode`` makes of up to ``rows_per_file`` rows, under names of their own.

    A task that runs again writes its files again under the same names.
    """
    ship(df.sparkSession)
    job, names = uuid.uuid4().hex[:12], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
        store.create_dir(root, recursive=True)
        held, written = [], 0

        def flush() -> None:
            nonlocal written
            name = f"{root}/part-{TaskContext.get().partitionId():05d}-{written:05d}-{job}.{extension}"
            with store.open_output_stream(name) as f:
                f.write(encode(names, held[:rows_per_file]))
            del held[:rows_per_file]
            written += 1

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= rows_per_file:
                flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    return df.mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


# -- Avro -----------------------------------------------------------------------------------

# The container's first bytes, and its names of the engine's types.
MAGIC = b"Obj\x01"
AVRO_TYPES = {"bigint": "long", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "binary": "bytes"}
BLOCK_ROWS = 4_000


def _long(value: int) -> bytes:
    n, out = (value << 1) ^ (value >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class _Bytes:
    """A cursor over Avro's binary encoding."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("Avro data end early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        shift = n = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def value(self, kind):
        if isinstance(kind, list):
            return self.value(kind[self.long()])
        name = kind["type"] if isinstance(kind, dict) else kind
        if name == "record":
            return {f["name"]: self.value(f["type"]) for f in kind["fields"]}
        if name == "enum":
            return kind["symbols"][self.long()]
        if name == "fixed":
            return self.take(kind["size"])
        if name in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append(self.value(kind["items"]) if name == "array" else (self.take(self.long()).decode(), self.value(kind["values"])))
            return out if name == "array" else dict(out)
        if name == "null":
            return None
        if name == "boolean":
            return self.take(1) == b"\x01"
        if name in ("int", "long"):
            return self.long()
        if name == "float":
            return struct.unpack("<f", self.take(4))[0]
        if name == "double":
            return struct.unpack("<d", self.take(8))[0]
        if name in ("string", "bytes"):
            raw = self.take(self.long())
            return raw.decode() if name == "string" else raw
        if isinstance(name, (dict, list)):
            return self.value(name)
        raise ValueError(f"no Avro type {name}")


def avro_header(raw: bytes) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync marker, where blocks begin) of a container."""
    if not raw.startswith(MAGIC):
        raise ValueError("no Avro container")
    data = _Bytes(raw, len(MAGIC))
    meta = data.value({"type": "map", "values": "bytes"})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), data.take(16), data.at


def avro_records(raw: bytes) -> list[dict]:
    schema, codec, sync, at = avro_header(raw)
    data, out = _Bytes(raw, at), []
    while data.at < len(raw):
        count, body = data.long(), data.take(data.long())
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec != "null":
            raise ValueError(f"no Avro codec {codec}")
        block = _Bytes(body)
        out += [block.value(schema) for _ in range(count)]
        if data.take(16) != sync:
            raise ValueError("an Avro block doesn't end with its marker")
    return out


def avro_container(names: list[str], rows: list[tuple], kinds: list[str]) -> bytes:
    """A container of flat records, every field nullable, in deflated blocks."""
    schema = {"type": "record", "name": "row", "fields": [{"name": n, "type": ["null", AVRO_TYPES[k]]} for n, k in zip(names, kinds)]}

    def field(v, kind: str) -> bytes:
        if v is None:
            return _long(0)
        name = AVRO_TYPES[kind]
        if name in ("int", "long"):
            return _long(1) + _long(v)
        if name == "boolean":
            return _long(1) + bytes([v])
        if name in ("float", "double"):
            return _long(1) + struct.pack("<f" if name == "float" else "<d", v)
        raw = v.encode() if name == "string" else bytes(v)
        return _long(1) + _long(len(raw)) + raw

    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate"}
    head = _long(len(meta)) + b"".join(_long(len(k)) + k.encode() + _long(len(v)) + v for k, v in meta.items()) + _long(0)
    sync = zlib.crc32(head).to_bytes(4, "big") * 4
    out = [MAGIC, head, sync]
    for at in range(0, len(rows), BLOCK_ROWS):
        part = rows[at : at + BLOCK_ROWS]
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(b"".join(field(v, k) for r in part for v, k in zip(r, kinds))) + packer.flush()
        out += [_long(len(part)), _long(len(body)), body, sync]
    return b"".join(out)


def avro_schema(spark: SparkSession, path: str) -> StructType:
    """Columns of a container's flat record, from the header of one file."""
    schema, *_ = avro_header(_head(spark, path, 1 << 20))
    names = {"long": "bigint", "int": "int", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "bytes": "binary"}
    cells = []
    for f in schema["fields"]:
        kind = next((k for k in f["type"] if k != "null"), "string") if isinstance(f["type"], list) else f["type"]
        cells.append(f"`{f['name']}` {names.get(kind, 'string') if isinstance(kind, str) else 'string'}")
    return StructType.fromDDL(", ".join(cells))


def read_avro(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records of every container under the path, by name; nested values as JSON text."""
    ship(spark)
    target = avro_schema(spark, path) if schema is None else StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = avro_records(raw)
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows[at : at + BLOCK_ROWS]
                    cells = [[json.dumps(v) if isinstance(v := r.get(f.name), (dict, list)) else v for r in part] for f in arrow]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)

    return read_binary(spark, path, "*.avro").select("content").mapInArrow(run, target)


def write_avro(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> int:
    kinds = [k for _, k in df.dtypes]
    unknown = [k for k in kinds if k not in AVRO_TYPES]
    if unknown:
        raise ValueError(f"no Avro type for {unknown[0]}")
    return write_files(df, path, "avro", lambda names, rows: avro_container(names, rows, kinds), rows_per_file)


# -- Databases ------------------------------------------------------------------------------

WRITES = ("insert", "append", "replace", "upsert", "update")


def read_database(spark: SparkSession, connect: Callable, query: str, schema: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """Rows of a query through a DB-API connection that ``connect()`` opens in each task.

    With ``column``, ``parts`` tasks read its ranges from ``low`` to ``high``; the first takes what lies
    below and nulls, the last what lies above, so no row is left out.
    """
    ship(spark)
    parsed = _parse_datatype_string(schema)
    cuts = [low + (high - low) * k // parts for k in range(1, parts)] if column else []
    bounds = list(zip([None, *cuts], [*cuts, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(parsed)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = bounds[k]
                tests = ([] if a is None else [f"{column} >= {a}"]) + ([] if b is None else [f"{column} < {b}"])
                own = " AND ".join(tests) if tests else "1 = 1"
                where = f" WHERE {own}" + (f" OR {column} IS NULL" if column and a is None and b is not None else "")
                connection = connect()
                try:
                    cursor = connection.cursor()
                    cursor.execute(f"SELECT * FROM ({query}) t{where}" if column else query)
                    while rows := cursor.fetchmany(BLOCK_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                finally:
                    connection.close()

    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(run, parsed)


def write_database(df: DataFrame, connect: Callable, table: str, mode: str = "append", keys: list[str] | None = None, mark: str = "?") -> int:
    """Rows into a table, a transaction a partition; gives the number of rows sent.

    insert and append add rows, replace empties the table first, update changes rows of known
    ``keys``, upsert changes them or adds them.
    """
    if mode not in WRITES or (mode in ("update", "upsert") and not keys):
        raise ValueError(f"mode must be one of {', '.join(WRITES)}, the last two with keys")
    names, keys = df.columns, keys or []
    others = [n for n in names if n not in keys]
    change = f"UPDATE {table} SET {', '.join(f'{n} = {mark}' for n in others)} WHERE {' AND '.join(f'{k} = {mark}' for k in keys)}"
    add = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"
    if mode == "replace":
        connection = connect()
        connection.cursor().execute(f"DELETE FROM {table}")
        connection.commit()
        connection.close()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection, sent = connect(), 0
        try:
            cursor = connection.cursor()
            for batch in batches:
                for row in batch.to_pylist():
                    known = 0
                    if mode in ("update", "upsert"):
                        cursor.execute(change, [row[n] for n in [*others, *keys]])
                        known = cursor.rowcount
                    if mode not in ("update",) and not known:
                        cursor.execute(add, [row[n] for n in names])
                    sent += 1
            connection.commit()
        finally:
            connection.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([sent], pa.int64())})

    return df.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0

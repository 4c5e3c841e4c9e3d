import functools
import sqlite3
import struct

import pytest

from vantloom.sources import files, formats

ROWS = [(1, "plain", 1.5, True), (2, "<a & b> \"q\" 漢\n\t", None, False), (3, "", -1e300, None), (4, None, 0.1, True), (2**62, " lead", 2.0, False)]
SCHEMA = "n bigint, s string, x double, b boolean"


def test_excel_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    assert formats.write_excel(df, f"{tmp_path}/x", 2) >= 3
    found = sorted(tuple(r) for r in formats.read_excel(spark, f"{tmp_path}/x", SCHEMA).collect())
    assert found == sorted((n, s, x, b) for n, s, x, b in ROWS)
    one = formats.workbook(["a", "b"], [(1, "x"), (None, "y")], "Named & odd")
    assert list(formats.sheet_rows(one, "Named & odd")) == [["a", "b"], [1, "x"], [None, "y"]]
    with pytest.raises(ValueError, match="no sheet"):
        list(formats.sheet_rows(one, "other"))
    assert [formats._column(f"{formats._letters(k)}7") for k in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_excel_shared_strings_and_gaps(tmp_path):
    import io
    import zipfile

    m = formats.MAIN
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{formats.RELATIONS}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{formats.PACKAGE}/relationships"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="B2" t="str"><v>f</v></c><c r="C2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    assert list(formats.sheet_rows(out.getvalue())) == [["two", None, "one"], [None, "f", None]]


def test_avro_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    formats.write_avro(df, f"{tmp_path}/a", 2)
    for found in (formats.read_avro(spark, f"{tmp_path}/a"), files.read_any(spark, f"{tmp_path}/a", "avro")):
        assert found.dtypes == df.dtypes
        assert sorted(tuple(r) for r in found.collect()) == sorted(ROWS)
    with pytest.raises(ValueError, match="no Avro type"):
        formats.write_avro(spark.range(1).selectExpr("array(id) AS a"), f"{tmp_path}/b")


def test_avro_by_hand():
    # The specification's own example: the record {"a": 27, "b": "foo"} is 36 06 66 6f 6f.
    kind = {"type": "record", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}
    assert formats._Bytes(bytes.fromhex("3606666f6f")).value(kind) == {"a": 27, "b": "foo"}
    # And the array [3, 27] of longs is 04 06 36 00.
    assert formats._Bytes(bytes.fromhex("04063600")).value({"type": "array", "items": "long"}) == [3, 27]
    assert formats._Bytes(bytes.fromhex("0202")).value({"type": "enum", "symbols": ["x", "y"]}) == "y"
    assert formats._Bytes(bytes.fromhex("0000")).value(["null", "string"]) is None
    assert formats._Bytes(struct.pack("<f", 1.5)).value("float") == 1.5
    for n in (0, -1, 1, -64, 64, 2**62, -(2**63), 2**63 - 1):
        assert formats._Bytes(formats._long(n)).long() == n
    with pytest.raises(ValueError):
        formats._Bytes(b"\x08ab").value("string")


def test_database_modes(spark, tmp_path):
    connect = functools.partial(sqlite3.connect, f"{tmp_path}/t.db", timeout=60)
    with connect() as c:
        c.execute("CREATE TABLE t (k INTEGER, v TEXT)")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string").coalesce(1)
    read = lambda **kw: sorted((r.k is None, r.k or 0, r.v) for r in formats.read_database(spark, connect, "SELECT k, v FROM t", "k int, v string", **kw).collect())
    assert formats.write_database(rows((1, "a"), (5, "b"), (None, "n"), (-3, "low"), (99, "high")), connect, "t") == 5
    want = [(False, -3, "low"), (False, 1, "a"), (False, 5, "b"), (False, 99, "high"), (True, 0, "n")]
    assert read() == want == read(column="k", low=0, high=10, parts=3)
    formats.write_database(rows((5, "B"), (7, "new")), connect, "t", "update", ["k"])
    assert (False, 5, "B") in read() and (False, 7, "new") not in read()
    formats.write_database(rows((5, "C"), (7, "new")), connect, "t", "upsert", ["k"])
    assert (False, 5, "C") in read() and (False, 7, "new") in read()
    formats.write_database(rows((1, "only")), connect, "t", "replace")
    assert read() == [(False, 1, "only")]
    with pytest.raises(ValueError):
        formats.write_database(rows((1, "x")), connect, "t", "upsert")

import hashlib
import random
import zlib

import pytest

from vantloom.llm import matroska


@pytest.mark.parametrize("lacing", ["fixed", "xiph", "ebml"])
@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5_000, 250_000])
def test_payload_round_trip(lacing, n):
    raw = random.Random(n).randbytes(n)
    for payload in (matroska.padded(raw), matroska.padded(raw) + b"abc"):
        stored = matroska.write_pcm(payload, lacing=lacing)
        media = matroska.parse(stored)
        assert media.complete and media.doc_type == "matroska"
        assert matroska.read_payload(stored, media) == payload
        assert [c[2] for c in media.cues] == media.clusters
        assert [p[1] for p in media.packets] == [k * 24_000_000 for k in range(len(media.packets))]


@pytest.mark.parametrize("kind", ["xiph", "ebml"])
def test_uneven_laces(kind):
    rnd = random.Random(5)
    for _ in range(50):
        frames = [rnd.randbytes(rnd.choice([0, 1, 254, 255, 256, 600, 9000])) for _ in range(rnd.randint(2, 12))]
        body = matroska.lace(frames, kind)
        assert [body[a : a + s] for a, s in matroska.unlace(body, 0, len(body), kind)] == frames


def test_block_groups_unknown_sizes_and_two_tracks():
    block = matroska.element(matroska.BLOCK, matroska.vint(2) + (5).to_bytes(2, "big") + b"\0" + b"frame")
    group = matroska.element(matroska.BLOCK_GROUP, block + matroska.uint(matroska.BLOCK_DURATION, 40) + matroska.uint(matroska.REFERENCE_BLOCK, 1))
    simple = matroska.simple_block(1, -3, [b"x"], "none")
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.CLUSTER_TIMESTAMP, 100) + group + simple
    file = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = matroska.parse(file)
    assert media.complete and len(media.clusters) == 2
    assert [(p[0], p[1] // 1_000_000, file[p[2] : p[2] + p[3]], p[4], p[6]) for p in media.packets] == [
        (2, 105, b"frame", False, 0), (1, 97, b"x", True, 0), (2, 105, b"frame", False, 1), (1, 97, b"x", True, 1)]


def test_truncated_files_do_not_crash():
    stored = matroska.write_pcm(matroska.padded(b"q" * 9000))
    for n in range(0, len(stored), 37):
        assert len(matroska.parse(stored[:n]).packets) <= 47
    for seed in range(200):
        matroska.parse(random.Random(seed).randbytes(300))


def test_query_and_packet_table(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (None, "x" * 192)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'y' AS media")
    files = matroska.text_media(docs, id_col="doc_id")
    assert files.count() == 5
    packets = matroska.packet_table(files, id_col="doc_id", media_col="media")
    assert packets.filter("doc_id = 3").count() == 2 * len(matroska.padded(("é" * 5000).encode())) // 192
    assert packets.filter("doc_id is null").count() == 1
    for text in (None, "", "é" * 5000):
        n, length, sha, tail, media_bytes, media_sha, feature, packets_, cues = matroska._digest(text)
        payload = matroska.padded((text or "").encode())
        assert (n, length, sha, tail) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert cues and packets_ == len(payload) // 192 and media_sha == hashlib.sha256(matroska.write_pcm(payload)).hexdigest()
    assert matroska.text_media(docs.limit(0)).count() == 0


def _walk(data, at, end, path=()):
    """(path of identifiers, body) of every element, by an own reading of the format."""
    masters = {"1a45dfa3", "18538067", "1549a966", "1654ae6b", "ae", "e1", "1f43b675", "1c53bb6b", "bb", "b7"}
    while at < end:
        n = next(k for k in range(1, 5) if data[at] & 0x80 >> k - 1)
        ident, at = data[at : at + n].hex(), at + n
        n = next(k for k in range(1, 9) if data[at] & 0x80 >> k - 1)
        size, at = int.from_bytes(data[at : at + n], "big") - (0x80 >> n - 1 << 8 * (n - 1)), at + n
        if ident in masters:
            yield from _walk(data, at, at + size, (*path, ident))
        else:
            yield (*path, ident), data[at : at + size]
        at += size
    assert at == end


def test_stored_bytes_by_another_reader(spark):
    """Every stored text of sf0.001 read back by a reader that shares nothing with the operator's."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in matroska.op6_media_columns(spark, sf).collect()}
    files = {r.doc_id: bytes(r.media) for r in matroska.text_media(docs).collect()}
    assert len(rows) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        raw, data = (r.text or "").encode(), files[r.doc_id]
        samples, times = b"", []
        for path, body in _walk(data, 0, len(data)):
            if path[-1] == "4282":
                assert body == b"matroska"
            elif path[-1] == "e7":
                times.append(int.from_bytes(body, "big"))
            elif path[-1] == "a3":
                assert body[0] == 0x81 and body[3] in (0x80, 0x84)  # track 1, a key frame, no or fixed lacing
                assert times[-1] + int.from_bytes(body[1:3], "big", signed=True) == len(samples) // 8
                samples += body[4:] if body[3] == 0x80 else body[5:]
                assert body[3] == 0x80 or (len(body) - 5) == (body[4] + 1) * 192
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        found = rows[r.doc_id]
        assert samples == want
        assert (found.n_bytes, found.payload_bytes, found.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert found.tail_crc32 == zlib.crc32(want[-16:]) and found.media_bytes == len(data) and found.media_sha256 == hashlib.sha256(data).hexdigest()


def test_packets_come_in_parts(spark, monkeypatch):
    blob = matroska.write_pcm(matroska.padded(b"z" * 20_000))
    files = spark.createDataFrame([(1, bytearray(blob)), (2, None)], "packets bigint, part binary")
    whole = sorted(matroska.packet_table(files, id_col="packets", media_col="part").collect())
    assert [r.packet_no for r in whole] == list(range(105)) and {r.packets for r in whole} == {1}
    monkeypatch.setattr(matroska, "PACKETS_IN_PART", 10)
    assert sorted(matroska.packet_table(files, id_col="packets", media_col="part").collect()) == whole

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from vantloom.llm import bpe, token_counts

ALPHABET = ["a", " ", "  ", "\n", "<|endoftext|>", "'s", "é", "1", "漢", "　", "!!", "ab", "\t", "🙂", "'", "\x1c"]


@pytest.fixture(scope="module")
def tok():
    return token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def enc():
    return bpe.load_encoding(*bpe.production_ranks())


def _texts(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 1500))) for _ in range(n)]


def test_resynchronised_ids_are_those_of_the_whole(tok):
    for text in [*_texts(80), "a" * 5000, " " * 5000, "<|endoftext|>" * 300, "ab1" * 2000]:
        assert token_counts.encode_long(tok, text, 400, 150) == tok.encode(text, add_special_tokens=False).ids


def test_pieces_encode_as_the_whole_and_decode_to_its_bytes(enc):
    for text in [*_texts(80), "x" * 100_000, "", "word " * 9000]:
        ids = bpe.encode(enc, text, 60)
        assert ids == enc.encode_ordinary(text)
        assert bpe.decode(enc, ids) == text.encode()


def test_long_white_space_is_matched_as_the_pattern_does(enc):
    import regex

    rnd = random.Random(5)
    blanks = [" ", "\n", "\t", "\r\n", "\x85", "\u3000", "\u2028"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts.append("".join(rnd.choice(blanks) for _ in range(rnd.choice([0, 3, 1023, 1024, 1500]))))
            parts.append(rnd.choice(["", "word", "\x1c", "12", "!!", "é's", "a b"]))
        text = "".join(parts)
        want = [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc.encode_ordinary(m)]
        assert bpe.encode(enc, text) == want
        assert bpe.encode(enc, text, 60) == want


def test_millions_of_blanks_encode_and_decode(spark, enc):
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_200_000 + "b", " \n" * 700_000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in bpe.bpe_digests(docs, *bpe.production_ranks()).collect()}
    assert all(found[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts))
    assert found[0].n_tokens == 2_000_000


def test_pieces_join_to_the_text():
    for text in _texts(20):
        assert "".join(bpe.safe_pieces(text, 30)) == text


def test_own_split_is_the_library_s(enc):
    import regex

    text = _texts(3)[1] + " it's 12 o'clock"
    by_match = [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc.encode_ordinary(m)]
    assert bpe.encode(enc, text) == by_match
    assert isinstance(enc, tiktoken.Encoding)


def test_queries_on_nulls_repeats_and_empty_tables(spark, tok, enc):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello there <|endoftext|>", "x"), (3, "Hello there <|endoftext|>", "x"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=2).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(
        (i or 0, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2) for i, t, _ in rows
    )
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    ids = bpe.bpe_encode(docs, *bpe.production_ranks())
    back = bpe.bpe_decode(ids, *bpe.production_ranks()).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.bpe_digests(docs, *bpe.production_ranks()).count() == len(rows)
    assert bpe.bpe_digests(docs.limit(0), *bpe.production_ranks()).count() == 0


def test_queries_on_every_document(spark, sf, tok, enc):
    """The library on each whole text, and each match of the pattern by itself."""
    import regex

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    counted = {r.doc_id: r for r in token_counts.op7_token_counts(spark, sf).collect()}
    coded = {r.doc_id: r for r in bpe.op9_bpe_round_trip(spark, sf).collect()}
    assert set(counted) == set(coded) == set(docs)
    for i, text in docs.items():
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(text.encode()), n, n > 512)
        ids = [x for m in regex.findall(public_tokenizers.PATTERN, text) for x in enc._encode_single_piece(m)]
        assert coded[i].n_tokens == len(ids)
        assert coded[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()

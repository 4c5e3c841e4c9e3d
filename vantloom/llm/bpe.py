"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are pre-split at safe boundaries: before a blank or newline that follows a letter.
No alternative of the split pattern matches a letter together with a following white-space
character, so every left-to-right scan ends a match there and starts afresh; encoding the
pieces one by one gives the ids of the whole. Decoding joins the raw bytes of the ids, so ids
that end inside a character are harmless.

The library's pattern engine backtracks over white space and fails on very long runs of it, so
runs of ``LONG_RUN`` characters or more never reach the pattern. What it would match there is
known: the run without its last character if something follows, all of it at the text's end. That
match goes to the library as one piece; the last character stays with what follows.

Defined results: null text is empty (0 ids, hash of nothing); repeated rows give repeated rows;
empty tables give empty tables; a text without any safe boundary is encoded in one piece; very
long texts take memory in proportion to the longest text of a batch; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.runtime import ship_file, shipped_file, table

PIECE = 16_384
LONG_RUN = 1_024
_CANDIDATE = re.compile(r"[^\W\d_][ \n]")
#: White space as the split pattern's engine sees it; Python's own class has four characters more.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@functools.cache
def load_encoding(rank_file: str, pattern: str):
    """Ranks stay in the worker process, which serves many tasks."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE):
    """Consecutive pieces of at least ``size`` characters cut at safe boundaries."""
    begin = 0
    while len(text) - begin > size:
        at = begin + size
        while (m := _CANDIDATE.search(text, at)) and not m[0][0].isalpha():
            at = m.end()
        if not m:
            break
        yield text[begin : m.start() + 1]
        begin = m.start() + 1
    yield text[begin:]


def _encode_run_free(enc, text: str, size: int) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(enc, text: str, size: int = PIECE) -> list[int]:
    ids, begin = [], 0
    for run in _LONG_RUN.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += _encode_run_free(enc, text[begin : run.start()], size)
        ids += enc._encode_single_piece(text[run.start() : end])
        begin = end
    return ids + _encode_run_free(enc, text[begin:], size) if begin else _encode_run_free(enc, text, size)


def decode(enc, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    kind = dict(docs.dtypes)[id_col]

    name = ship_file(docs.sparkSession, rank_file)

    def make():
        enc = load_encoding(shipped_file(name), pattern)
        return lambda ids, texts: (ids, [encode(enc, t or "") for t in texts])

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, ids array<int>", step=64)


def bpe_decode(tokens: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the raw bytes of the ids; null ids are empty."""
    kind = dict(tokens.dtypes)[id_col]

    name = ship_file(tokens.sparkSession, rank_file)

    def make():
        enc = load_encoding(shipped_file(name), pattern)
        return lambda ids, seqs: (ids, [decode(enc, s or []) for s in seqs])

    return map_rows(tokens.select(F.col(id_col), F.col(ids_col)), make, f"`{id_col}` {kind}, bytes binary", step=64)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; the ids never leave the worker, only their digests do."""
    kind = dict(docs.dtypes)[id_col]

    name = ship_file(docs.sparkSession, rank_file)

    def make():
        enc = load_encoding(shipped_file(name), pattern)
        words = [str(i) for i in range(enc.n_vocab)]

        def one(text):
            ids = encode(enc, text or "")
            return len(ids), hashlib.sha256(",".join([words[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()

        return lambda ids, texts: (ids, *zip(*map(one, texts), strict=True)) if ids else ([], [], [], [])

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def production_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), *production_ranks())

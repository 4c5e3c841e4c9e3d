"""Token counts by overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a position where both start a pre-token: the pre-tokeniser scans left to right
without memory and looks ahead one character at most, so from such a position on both scans
are the scan of the whole text. A margin of ``MARGIN`` characters from either chunk end keeps
lookahead and special strings out of reach of the cut. Where an overlap holds no common
boundary it is doubled; where it would reach behind the last splice, the chunk is extended.

Defined results: null text counts as empty (0 tokens, 0 bytes); repeated rows give repeated
rows; an empty table gives an empty table; a very long text is encoded chunk by chunk; other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.runtime import ship_file, shipped_file, table

#: Longest special string or lookahead that may cross a cut, with room to spare.
MARGIN = 64
CHUNK = 32_768
OVERLAP = 1_024
TOKEN_LIMIT = 512


@functools.cache
def load_tokenizer(path: str):
    """The tokenizer stays in the worker process, which serves many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _starts(encoding, base: int) -> tuple[list[int], set[int]]:
    """Start offset of every token, and the starts of pre-tokens, in document positions."""
    offsets, words = encoding.offsets, encoding.word_ids
    starts = [base + a for a, _ in offsets]
    firsts, before = set(), None
    for at, word in zip(starts, words):
        if word is not None and word != before:
            firsts.add(at)
        before = word
    return starts, firsts


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of the whole text, equal to ``tok.encode(text).ids``."""
    n = len(text)
    begin, end = 0, min(chunk, n)
    enc = tok.encode(text[begin:end], add_special_tokens=False)
    starts, firsts = _starts(enc, begin)
    out: list[int] = []
    kept = 0  # tokens that start before this position are in ``out``
    while end < n:
        width, splice = overlap, None
        while splice is None:
            left = max(kept, end - width)
            if left <= kept:  # nothing left to widen into: take a longer chunk instead
                end = min(n, end + max(chunk, end - kept))
                begin = kept
                enc = tok.encode(text[begin:end], add_special_tokens=False)
                starts, firsts = _starts(enc, begin)
                break
            right = min(n, left + max(chunk, 2 * width))
            following = tok.encode(text[left:right], add_special_tokens=False)
            next_starts, next_firsts = _starts(following, left)
            common = [p for p in firsts & next_firsts if left + MARGIN <= p <= end - MARGIN]
            if common:
                splice = max(common)
            else:
                width *= 2
        if splice is None:
            continue
        out += [i for i, at in zip(enc.ids, starts) if kept <= at < splice]
        kept, begin, end, enc, starts, firsts = splice, left, right, following, next_starts, next_firsts
    out += [i for i, at in zip(enc.ids, starts) if at >= kept]
    return out


def count_tokens(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    short = [k for k, t in enumerate(texts) if len(t) <= chunk]
    counts = [0] * len(texts)
    for k, enc in zip(short, tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False)):
        counts[k] = len(enc)
    for k, t in enumerate(texts):
        if len(t) > chunk:
            counts[k] = len(encode_long(tok, t, chunk, overlap))
    return counts


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; one narrow pass, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    name = ship_file(docs.sparkSession, vocabulary)

    def make():
        tok = load_tokenizer(shipped_file(name))

        def fn(ids, texts):
            texts = [t or "" for t in texts]
            counts = count_tokens(tok, texts, chunk, overlap)
            return ids, [len(t.encode()) for t in texts], counts, [c > limit for c in counts]

        return fn

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", step=64)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

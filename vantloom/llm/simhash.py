"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints come from one narrow pass; equal ones are folded before any search, so a group of
exact copies is one fingerprint however many rows it has. Two fingerprints within two bits agree
on one of three blocks of their bits. So there are three Gray orders of all fingerprints, each
over codes turned to begin with another block; codes of one block pattern stand together there.
Each order is dealt out by ranges of Gray rank. Every range is indexed: runs of consecutive codes
share masked bit patterns, which are factored into upper nodes; a search goes down from the top,
drops whole nodes that differ in the block, adds up the other differences and prunes at the limit.
Every fingerprint is found through that index, under keys of any size. A block pattern with more
than ``GROUP_BOUND`` fingerprints is dealt out again by three blocks of the remaining bits, twice
at most, after which 19 bits are left: no key has more than 2**19 codes. Each range emits a
spanning forest of its links, never its pairs, and components of the forest are those of all links.

Defined results: null text and texts without words have fingerprint zero, linked like any other;
null doc_id counts for no component_id; repeated rows are all returned; an empty table gives an
empty table; a very long text is hashed in slices; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.llm.batches import map_rows
from vantloom.llm.components import components, heads_of
from vantloom.runtime import checkpoint, ship, shuffle_width, table

WIDTH = 3
SEED = 42
MAX_BITS = 2
GROUP_BOUND = 8_192
FANOUT = 16
#: Codes that one index holds at least, if there are as many; a key is never cut.
RUN = 1 << 18
#: Pairs that a search holds at a time, about.
FRONT = 1 << 20
_SLICE = 1 << 16


def _lanes() -> np.ndarray:
    """Byte value -> its eight bits as eight byte lanes, so that 255 rows add up without a carry."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view(np.uint64).ravel()


_LANES = _lanes()


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash; a bit is 1 if more than half of the shingles' hashes set it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    stops = stops[width - 1 :] if len(words) >= width else stops[-1:]
    totals = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE])], np.uint64)
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        totals += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.int64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Hierarchy over (key, code) rows in order of key and Gray rank; levels[0] are the rows, levels[-1] the top nodes.

    A level is (pattern, mask) of the codes and of the keys: the bits that all rows below a node
    share and the parent does not already hold. A node's children are the FANOUT entries from
    FANOUT * its number on.
    """

    def __init__(self, codes: np.ndarray, keys: np.ndarray | None = None):
        self.codes = codes
        self.keys = np.zeros(len(codes), np.uint64) if keys is None else keys
        self.levels = [(*code, *key) for code, key in zip(self._factor(codes), self._factor(self.keys))]

    @staticmethod
    def _factor(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        patterns, masks = words.astype(np.uint64), np.full(len(words), ~np.uint64(0))
        raw = [(patterns, masks)]
        while len(patterns) > FANOUT:
            cuts = np.arange(0, len(patterns), FANOUT)
            low, high = np.bitwise_and.reduceat(patterns, cuts), np.bitwise_or.reduceat(patterns, cuts)
            masks = np.bitwise_and.reduceat(masks, cuts) & ~(low ^ high)
            patterns = low & masks
            raw.append((patterns, masks))
        above = [np.repeat(m, FANOUT)[: len(p)] for (p, _), (_, m) in zip(raw, raw[1:])] + [np.uint64(0)]
        return [(p & m & ~held, m & ~held) for (p, m), held in zip(raw, above)]

    def search(self, codes: np.ndarray, limit: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row number) of every row with the query's key and within ``limit`` bits of its code."""
        keys = np.zeros(len(codes), np.uint64) if keys is None else keys
        who, node = (x.ravel() for x in np.indices((len(codes), len(self.levels[-1][0])), np.int64))
        spent = np.zeros(len(who), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            p, m, kp, km = self.levels[k]
            same = ((keys[who] ^ kp[node]) & km[node]) == 0
            who, node, spent = who[same], node[same], spent[same]
            spent = spent + np.bitwise_count((codes[who] ^ p[node]) & m[node])
            kept = spent <= limit
            who, node, spent = who[kept], node[kept], spent[kept]
            if k:
                size = len(self.levels[k - 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = child < size
                who, spent, node = np.repeat(who, FANOUT)[inside], np.repeat(spent, FANOUT)[inside], child[inside]
        return who, node

    def own_pairs(self, limit: int, front: int = FRONT):
        """(row, later row) arrays of all pairs within ``limit`` bits under one key, about ``front`` at a time at most.

        A row's pairs are no more than its key has rows, so rows are taken by that bound.
        """
        new = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]])
        size = np.diff(np.r_[new, len(self.keys)])
        most = np.cumsum(np.repeat(size, size) + FANOUT)
        at = 0
        while at < len(self.codes):
            end = max(at + 1, int(np.searchsorted(most, (most[at - 1] if at else 0) + front, "right")))
            who, node = self.search(self.codes[at:end], limit, self.keys[at:end])
            later = node > who + at
            yield who[later] + at, node[later]
            at = end


class Forest:
    """Union-find over numbered codes that takes links in arrays and keeps labels flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the links that joined two trees."""
        x, y = self.label[a], self.label[b]
        differ = np.flatnonzero(x != y)
        if not len(differ):
            return differ
        pairs, at = np.unique(np.stack([np.minimum(x, y)[differ], np.maximum(x, y)[differ]]), axis=1, return_index=True)
        root: dict[int, int] = {}
        used = []

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        for k, (u, v) in zip(at.tolist(), pairs.T.tolist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                used.append(k)
        moved = np.arange(len(self.label))
        for v in list(root):
            moved[v] = find(v)
        self.label = moved[self.label]
        return differ[used]


def link_run(keys: np.ndarray, codes: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (row, smaller row) of the links under equal keys; rows are in order of key and Gray rank."""
    forest = Forest(len(codes))
    for a, b in GrayIndex(codes, keys).own_pairs(limit):
        forest.add(a, b)
    child = np.flatnonzero(forest.label != np.arange(len(codes)))
    return child, forest.label[child]


def turned(x: Column, low: int, by: int) -> Column:
    """``x`` with its ``low`` lowest bits rotated left by ``by``."""
    if not by:
        return x
    if low == 64:
        return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))
    mask = F.lit((1 << low) - 1).cast("bigint")
    part = x.bitwiseAND(mask)
    return x.bitwiseAND(F.lit(-(1 << low)).cast("bigint")).bitwiseOR(F.shiftleft(part, by).bitwiseAND(mask)).bitwiseOR(F.shiftrightunsigned(part, low - by))


def _cuts(bits: int) -> list[int]:
    """Where three blocks of ``bits`` bits begin, from the highest on, and where the last ends."""
    return [round(bits * k / 3) for k in range(4)]


def _dealt(rows: DataFrame, lows: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Every row (turn, code, fp) under three further turns, with rank and key, and the low bits that each turn leaves free.

    ``turn`` numbers the blocks chosen so far, which are the code's highest bits. The key is the
    turn and the Gray rank without the free bits: it names the chosen blocks' pattern, and order
    of (key, rank) is Gray order within a turn.
    """
    after: dict[int, int] = {}
    options = key = None
    for turn, low in lows.items():
        cuts = _cuts(low)
        made = []
        for k in range(3):
            after[4 * turn + k] = low - (cuts[k + 1] - cuts[k])
            made.append(F.struct(F.lit(4 * turn + k).cast("bigint").alias("turn"), turned(F.col("code"), low, cuts[k]).alias("code")))
        options = (F if options is None else options).when(F.col("turn") == turn, F.array(*made))
    df = rows.select(F.explode(options).alias("s"), "fp").select("s.turn", "s.code", "fp")
    rank = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        df = df.withColumn("rank", rank.bitwiseXOR(F.shiftrightunsigned(rank, shift)))
        rank = F.col("rank")
    for turn, low in after.items():
        key = (F if key is None else key).when(F.col("turn") == turn, F.shiftrightunsigned("rank", low))
    return df.withColumn("key", F.shiftleft("turn", 48).bitwiseOR(key)), after


def _runs(batches: Iterator[pa.RecordBatch], least: int = RUN) -> Iterator[pa.Table]:
    """Consecutive rows, ``least`` or more if there are as many, cut where the first column changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        key = whole.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last key may go on in the next batch
        if cut:
            yield whole.slice(0, cut)
        held, rows = whole.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _linker(searched) -> Callable:
    """Links of rows (key, code, fp) in order of key and Gray rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            key, code, fp = (c.to_numpy() for c in part.columns)
            a, b = link_run(key.view(np.uint64), code.view(np.uint64))
            if searched is not None:
                searched.add(len(code))
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return run


def fingerprint_links(codes: DataFrame, bound: int = GROUP_BOUND, searched=None) -> DataFrame:
    """(a, b): links whose components are those of all pairs within MAX_BITS bits.

    ``codes`` holds distinct fingerprints in column fp. ``searched`` is an accumulator that gets the
    number of codes looked up in an index, one for each order that a fingerprint stands in.
    """
    rows, free = _dealt(codes.select(F.lit(1).cast("bigint").alias("turn"), F.col("fp").alias("code"), "fp"), {1: 64})
    parts = []
    for _ in range(2):
        full = checkpoint(rows.groupBy("key").count().filter(F.col("count") > bound).select("key"))
        if full.isEmpty():
            break
        parts.append(rows.join(full, "key", "left_anti"))
        rows, free = _dealt(rows.join(full, "key", "left_semi").select("turn", "code", "fp"), free)
    placed = functools.reduce(DataFrame.unionByName, [part.select("key", "rank", "code", "fp") for part in [*parts, rows]])
    unsigned = F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
    ordered = placed.repartitionByRange(shuffle_width(codes.sparkSession), "key").sortWithinPartitions("key", unsigned)
    ship(codes.sparkSession)
    return ordered.select("key", "code", "fp").mapInArrow(_linker(searched), "a bigint, b bigint")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = GROUP_BOUND, searched=None) -> DataFrame:
    """(id, fp bigint, component_id): component_id is the smallest id that links reach."""
    kind = dict(docs.dtypes)[id_col]
    prints = checkpoint(map_rows(docs.select(F.col(id_col), F.col(text_col)), lambda: lambda ids, texts: (ids, [fingerprint(t) for t in texts]), f"`{id_col}` {kind}, fp bigint"))
    codes = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("head")))
    stars = components(fingerprint_links(codes, bound, searched))
    linked = heads_of(stars, codes.select(F.col("fp").alias("node"), F.col("head").alias("component_id")), "component_id").withColumnRenamed("node", "fp")
    # Written first: a join of two fresh exchanges is one whose crowded fingerprints can be split.
    settled = checkpoint(codes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "head").alias("component_id")))
    return prints.join(settled, "fp").select(id_col, "fp", "component_id")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

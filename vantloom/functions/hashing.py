"""Hashes, a Bloom filter over integer words, a consistent-hash ring, vector hashes.

Digests that the engine has are its own functions. BLAKE3, XXH3 and 32-bit murmur3 run over Arrow
batches, with one lane of integer arrays for each row (for BLAKE3 each chunk of a row).
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.runtime import ship_active


#: The enumerated algorithms; ``city`` is computed as XXH3.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512", "blake3", "xxh3", "city")


def digest(c: Column, kind: str) -> Column:
    """Lower-case hexadecimal digest; ``xxhash64`` is the engine's, with seed 42. Null for null."""
    raw = c.cast("binary")
    return {
        "md5": lambda: F.md5(raw),
        "sha1": lambda: F.sha1(raw),
        "sha256": lambda: F.sha2(raw, 256),
        "sha512": lambda: F.sha2(raw, 512),
        "crc32": lambda: F.lower(F.hex(F.crc32(raw))),
        "xxhash64": lambda: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")),
        "blake3": lambda: _over_batches(blake3_all)(raw),
        "xxh3": lambda: _over_batches(xxh3_all)(raw),
        "city": lambda: _over_batches(xxh3_all)(raw),
    }[kind]()


def _over_batches(fn):
    """An Arrow function of binary values to text; nulls stay null."""
    ship_active()

    @F.arrow_udf("string")
    def run(raw: pa.Array) -> pa.Array:
        values = raw.to_pylist()
        found = iter(fn([v for v in values if v is not None]))
        return pa.array([None if v is None else next(found) for v in values], pa.string())

    return run


def xxh3_all(values: list[bytes]) -> list[str]:
    """XXH3 of 64 bits, least significant byte first."""
    return [xxhash.xxh3_64_intdigest(v).to_bytes(8, "little").hex() for v in values]


# The initial words, the order of message words and the flags of BLAKE3.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK = 1024, 64


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values [8, lane] from values [8, lane] and message words [16, lane]."""
    n = words.shape[1]
    s = [*cv, *(np.full(n, w, np.uint32) for w in _IV[:4]), counter.astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            s[a] = s[a] + s[b] + word
            s[d] = _turn(s[d] ^ s[a], 32 - r1)
            s[c] = s[c] + s[d]
            s[b] = _turn(s[b] ^ s[c], 32 - r2)

    for round_ in range(7):
        for k in range(4):
            mix(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        if round_ < 6:
            m = [m[k] for k in _ORDER]
    return np.array([s[k] ^ s[k + 8] for k in range(8)])


def _turn(x: np.ndarray, left: int) -> np.ndarray:
    return (x << np.uint32(left)) | (x >> np.uint32(32 - left))


def blake3_all(values: list[bytes]) -> list[str]:
    """BLAKE3 of 256 bits. Every chunk of every value is a lane; parents are folded level by level."""
    lanes = [(i, at // _CHUNK, v[at : at + _CHUNK], len(v) <= _CHUNK) for i, v in enumerate(values) for at in range(0, max(1, len(v)), _CHUNK)]
    if not lanes:
        return []
    blocks = np.array([max(1, -(-len(x[2]) // _BLOCK)) for x in lanes])
    counter, alone = np.array([x[1] for x in lanes], np.int64), np.array([x[3] for x in lanes])
    cv = np.repeat(np.array(_IV, np.uint32)[:, None], len(lanes), axis=1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        parts = [lanes[k][2][b * _BLOCK : (b + 1) * _BLOCK] for k in on]
        words = np.frombuffer(b"".join(p.ljust(_BLOCK, b"\0") for p in parts), "<u4").reshape(-1, 16).T.astype(np.uint32)
        last = blocks[on] == b + 1
        flags = (_START if b == 0 else 0) | np.where(last, _END, 0) | np.where(last & alone[on], _ROOT, 0)
        cv[:, on] = _compress(cv[:, on], words, counter[on], np.array([len(p) for p in parts]), flags)
    own: list[list[np.ndarray]] = [[] for _ in values]
    for k, lane in enumerate(lanes):
        own[lane[0]].append(cv[:, k])
    while pairs := [(i, j) for i, nodes in enumerate(own) if len(nodes) > 1 for j in range(0, len(nodes) - 1, 2)]:
        words = np.array([np.concatenate([own[i][j], own[i][j + 1]]) for i, j in pairs], np.uint32).T
        start = np.repeat(np.array(_IV, np.uint32)[:, None], len(pairs), axis=1)
        flags = np.array([_PARENT | (_ROOT if len(own[i]) == 2 else 0) for i, _ in pairs])
        folded = _compress(start, words, np.zeros(len(pairs), np.int64), np.full(len(pairs), _BLOCK), flags)
        above: dict[int, list[np.ndarray]] = {}
        for k, (i, _) in enumerate(pairs):
            above.setdefault(i, []).append(folded[:, k])
        for i, nodes in above.items():
            own[i] = nodes + (own[i][-1:] if len(own[i]) % 2 else [])
    return [nodes[0].astype("<u4").tobytes().hex() for nodes in own]


def murmur3_32(c: Column, seed: int = 0) -> Column:
    """32-bit murmur3 of the value's bytes as a number from 0; null for null."""
    ship_active()

    @F.arrow_udf("bigint")
    def run(raw: pa.Array) -> pa.Array:
        values = raw.to_pylist()
        found = iter(murmur3_all([v for v in values if v is not None], seed).tolist())
        return pa.array([None if v is None else next(found) for v in values], pa.int64())

    return run(c.cast("binary"))


def murmur3_all(values: list[bytes], seed: int = 0) -> np.ndarray:
    h = np.full(len(values), seed, np.uint32)
    size = np.array([len(v) for v in values], np.uint32)
    whole = size // 4

    def scrambled(k: np.ndarray) -> np.ndarray:
        return _turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    for b in range(int(whole.max(initial=0))):
        on = np.flatnonzero(whole > b)
        k = np.frombuffer(b"".join(values[i][4 * b : 4 * b + 4] for i in on), "<u4").astype(np.uint32)
        h[on] = _turn(h[on] ^ scrambled(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    tails = np.frombuffer(b"".join(v[len(v) // 4 * 4 :].ljust(4, b"\0") for v in values), "<u4").astype(np.uint32)
    h ^= np.where(size % 4 != 0, scrambled(tails), np.uint32(0))
    h ^= size
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h ^ (h >> np.uint32(16))


def vector_hash(v: Column, precision: float = 1e-3) -> Column:
    """SHA-256 of the components as whole multiples of ``precision``."""
    steps = F.transform(v.cast("array<double>"), lambda x: F.floor(x * round(1 / precision) + 0.5).cast("string"))
    return F.sha2(F.array_join(steps, ","), 256)


#: Words of a filter that a plan holds as literals at most; larger filters are broadcast.
PLAN_WORDS = 512


@dataclass
class Bloom:
    """Bits set by two hashes combined; held as 64-bit words, at a size fixed when it is built."""

    words: tuple[int, ...]
    bits: int
    hashes: int

    @staticmethod
    def pair(c: Column, bits: int) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(c), F.lit(bits)), F.pmod(F.xxhash64(F.lit(17), c), F.lit(bits))

    @classmethod
    def positions(cls, c: Column, bits: int, hashes: int) -> Column:
        a, b = cls.pair(c, bits)
        return F.array(*((a + b * k) % bits for k in range(hashes)))

    @classmethod
    def build(cls, df: DataFrame, column: str, expected: int, false_rate: float = 0.01) -> Bloom:
        """Positions are folded to words on the executors: what comes back has the filter's size."""
        bits = max(64, 64 * ceil(-expected * log(false_rate) / log(2) ** 2 / 64))
        hashes = max(1, round(bits / expected * log(2)))
        at = df.select(F.explode(cls.positions(F.col(column), bits, hashes)).alias("p"))
        word = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("x"))
        found, words = word.toArrow(), np.zeros(bits // 64, np.int64)
        words[found.column(0).to_numpy()] = found.column(1).to_numpy()
        return cls(tuple(words.tolist()), bits, hashes)

    def might_contain(self, c: Column) -> Column:
        if len(self.words) > PLAN_WORDS:
            return self._probe()(*self.pair(c, self.bits))
        words = F.array(*(F.lit(w).cast("bigint") for w in self.words))
        hit = lambda p: F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        return F.forall(self.positions(c, self.bits, self.hashes), hit)

    def _probe(self):
        ship_active()
        sent = SparkSession.active().sparkContext.broadcast(np.array(self.words, np.int64))  # the filter
        bits, hashes = self.bits, self.hashes

        @F.pandas_udf("boolean")
        def hit(a: pd.Series, b: pd.Series) -> pd.Series:
            at = (a.to_numpy()[:, None] + b.to_numpy()[:, None] * np.arange(hashes)) % bits
            return pd.Series(((sent.value[at >> 6] >> (at & 63)) & 1).all(axis=1))

        return hit


class Ring:
    """Consistent hashing: each node owns ``replicas`` points, a key goes to the next point's node."""

    def __init__(self, nodes: list[str], replicas: int = 32):
        self.nodes, self.replicas = list(nodes), replicas
        points = sorted((self._point(f"{n}#{k}"), n) for n in nodes for k in range(replicas))
        self.points, self.owners = [p for p, _ in points], [n for _, n in points]

    @staticmethod
    def _point(key: str) -> int:
        raw = xxhash.xxh64_intdigest(key.encode(), 42)
        return raw - (1 << 64) if raw >> 63 else raw

    def owner(self, key: str) -> str:
        return self.owners[bisect_left(self.points, self._point(key)) % len(self.owners)]

    def node_of(self, key: Column) -> Column:
        """The same answer as a Column: the count of smaller points numbers the owner."""
        at = F.size(F.filter(F.array(*(F.lit(p).cast("bigint") for p in self.points)), lambda p: p < F.xxhash64(key)))
        return F.get(F.array(*(F.lit(n) for n in self.owners)), (at % len(self.owners)).cast("int"))

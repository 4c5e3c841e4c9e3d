"""Near copies by shingle similarity: SimHash in Gray-order indexes, then the sets themselves.

``simhash`` links fingerprints within two bits, as its contract fixes. Texts whose sets of five-word
shingles are similar by 0.8 or more differ in ten bits of 64 or so, and no three blocks can bring
those together. So here fingerprints meet under keys of their min-hashes instead: ``BANDS`` keys of
``BAND`` min-hashes each, of which texts of similarity 0.8 share one in 0.9996 of all cases. Under a
key the index in Gray order prunes by ``RADIUS`` bits; what it finds is weighed by the share of
``SKETCH`` one-byte min-hashes that agree, and ``FORESTS`` spanning forests of the heaviest candidates
leave the task, never all pairs. Each of its links is then held against the two whole shingle sets, and
components go by the links that are similar by ``SIMILARITY`` or more, exactly.

A forest can hold candidates that turn out not to be similar in the place of some that are. So a tree
that has candidates beyond the forests leaves the task with its nodes. If its nodes stand in different
components afterwards, their whole sets meet in one task, which holds every two nodes of different
components against each other: whatever the forests left out is linked there or is not similar. A tree of
more than ``SET_BYTES`` of sets is parted into chunks that meet two by two.

Texts of equal sets fold first, with partial sums, so exact copies are one node however many there
are. A key with more than ``KEY_BOUND`` nodes is parted: its nodes are dealt into chunks, and every
two chunks meet under a key of their own, so nothing is lost and no task holds more than two chunks.

Words are as in ``simhash``: A-Z lower-cased, parted by ASCII blanks; fewer than five are one
shingle. Defined results: null texts and texts without words have the empty set and are equal;
a document is its (id, text hash); the one with the smallest id (null last) of a component stays,
as one row; an empty table gives an empty table; very long texts are hashed in slices; extra
columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantloom.llm.batches import fresh, map_rows
from vantloom.llm.components import components, heads_of
from vantloom.llm.simhash import _LANES, SEED, Forest, GrayIndex, _runs, gray_rank
from vantloom.runtime import checkpoint, ship, shuffle_width

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND = 20, 5
SKETCH = 256
#: Candidates have an estimated similarity of so much less at least; its standard error is 0.025.
SLACK = 0.1
#: Edge-disjoint forests that a key gives: candidates that an estimate put behind others by mistake.
FORESTS = 3
#: Bits in which candidates may differ; texts of similarity 0.8 differ in 10 on average, 3 either way.
RADIUS = 24
KEY_BOUND = 4_096
#: Bytes of whole sets that a chunk of a tree holds, about.
SET_BYTES = 8 << 20
#: Pairs weighed at a time, and rows in an index at least: a row carries its sketch.
FRONT, RUN = 1 << 16, 1 << 15
_SLICE = 1 << 15


def shingle_hashes(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    stops = stops[width - 1 :] if len(words) >= width else stops[-1:]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops)))


@functools.cache
def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, max(BANDS * BAND, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> tuple[bytes, int, bytes, list[int]]:
    """(name of the set, SimHash, min-hash bytes, band keys) of a set of shingle hashes."""
    name = xxhash.xxh128_digest(hashes.tobytes())
    totals, least = np.zeros(64, np.int64), np.full(len(_multipliers()), ~np.uint64(0))
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE]
        lanes = _LANES[part.view(np.uint8).reshape(-1, 8)]
        totals += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        for b in range(0, len(part), 1024):
            np.minimum(least, (part[b : b + 1024, None] * _multipliers()).min(axis=0), out=least)
    fp = int(np.packbits(totals * 2 > len(hashes), bitorder="little").view(np.int64)[0])
    bands = [int.from_bytes(xxhash.xxh64_digest(least[b * BAND : (b + 1) * BAND].tobytes(), b), "little", signed=True) for b in range(BANDS)]
    return name, fp, (least[:SKETCH] >> np.uint64(24)).astype(np.uint8).tobytes(), bands


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets as sorted distinct hashes; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def heaviest_forests(keys: np.ndarray, codes: np.ndarray, sketches: np.ndarray, least: int, radius: int = RADIUS, front: int = FRONT, forests: int = FORESTS, left: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (row, row) of spanning forests under equal keys, from the most agreeing bytes down to ``least``.

    Each forest is the heaviest of the links that those before it left. Rows are in order of key and
    Gray rank. Candidates are reduced to the forests whenever they are many. ``left``, flags of the rows,
    is set at the ends of candidates that no forest took.
    """
    kept = [tuple(np.empty(0, np.int64) for _ in range(3))]
    pending: list = []

    def reduce():
        a, b, w = (np.concatenate(x) for x in zip(*kept, *pending))
        kept.clear()
        pending.clear()
        for _ in range(forests):
            forest, chosen = Forest(len(codes)), []
            for weight in np.unique(w)[::-1]:
                at = np.flatnonzero(w == weight)
                chosen.append(at[forest.add(a[at], b[at])])
            use = np.zeros(len(w), bool)
            use[np.concatenate(chosen) if chosen else []] = True
            kept.append((a[use], b[use], w[use]))
            a, b, w = a[~use], b[~use], w[~use]
        if left is not None:
            left[a] = left[b] = True

    for i, j in GrayIndex(codes, keys).own_pairs(radius, front):
        agree = (sketches[i] == sketches[j]).sum(axis=1)
        good = agree >= least
        pending.append((i[good], j[good], agree[good]))
        if sum(len(x[0]) for x in pending) > 16 * FRONT + forests * len(codes):
            reduce()
    reduce()
    return [x[:2] for x in kept]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, null) of the forests, and (node, null, tree) of trees with candidates beyond them; equal trees have one name."""
    share = SIMILARITY - SLACK
    least = int(np.ceil(SKETCH * (share + (1 - share) / 256)))
    for part in _runs(batches, RUN):
        key, fp = (part.column(k).to_numpy() for k in (0, 1))
        names, bytes_ = part.column(2).to_pylist(), part.column(3).to_pylist()
        # Rows come by key; the Gray order within a key is made here.
        codes, keys = fp.view(np.uint64), key.view(np.uint64)
        order = np.lexsort((gray_rank(codes), keys))
        sketches = np.frombuffer(b"".join(bytes_), np.uint8).reshape(len(bytes_), SKETCH)[order]
        left = np.zeros(len(order), bool)
        forests = heaviest_forests(keys[order], codes[order], sketches, least, left=left)
        a, b = (np.concatenate(x) for x in zip(*forests))
        pairs = {(min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(order[a].tolist(), order[b].tolist())}
        rows = [(*p, None) for p in sorted(pairs) if p[0] != p[1]]
        whole = Forest(len(order))
        whole.add(*forests[0])
        inside = np.flatnonzero(np.isin(whole.label, whole.label[left]))
        inside = inside[np.argsort(whole.label[inside], kind="stable")]
        for tree in np.split(inside, np.flatnonzero(np.diff(whole.label[inside])) + 1):
            members = sorted(names[x] for x in order[tree].tolist())
            name = int.from_bytes(xxhash.xxh64_digest(b"".join(members)), "little", signed=True)
            rows += [(m, None, name) for m in members]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "tree"])


def _candidate_links(heads: DataFrame, bound: int) -> DataFrame:
    """Distinct rows of ``_candidates``, from heads (node, fp, sketch, bands)."""
    keyed = heads.select("node", F.explode("bands").alias("key"))
    crowd = checkpoint(keyed.groupBy("key").count().filter("count > 1"))
    n = F.ceil(F.col("count") / bound)
    met = keyed.join(crowd, "key").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    # Under a crowded key, one row for every other chunk; the key of two chunks is the same for both.
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    split = met.filter("n > 1").withColumn("other", others).select("node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    slim = met.filter("n = 1").select("node", "key").unionByName(split)
    full = slim.join(heads.select("node", "fp", "sketch"), "node").select("key", "fp", "node", "sketch")
    ship(heads.sparkSession)
    placed = full.repartition(shuffle_width(heads.sparkSession), "key").sortWithinPartitions("key")
    return checkpoint(placed.mapInArrow(_candidates, "a binary, b binary, tree bigint").distinct())


def similar_across(sets: list[np.ndarray], classes: np.ndarray) -> list[tuple[int, int]]:
    """Links (number, number) of similar sets that join all classes which any similar sets of different classes join.

    ``sets`` are distinct. A set meets those of 0.8 to 1 / 0.8 times its size at once: shared hashes are counted in their row of all hashes.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, label = sizes[order], np.unique(classes, return_inverse=True)[1][order]
    starts = np.r_[0, np.cumsum(sizes)]
    vocabulary, row = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    held, links = np.zeros(len(vocabulary), np.int8), []
    most = label == np.bincount(label).argmax()  # these are met by all others and need not ask
    for k in np.flatnonzero(~most & (sizes > 0)).tolist():
        low, high = np.searchsorted(sizes, (int(np.ceil(sizes[k] * SIMILARITY - 1e-6)), int(sizes[k] / SIMILARITY + 1e-6) + 1))
        own = row[starts[k] : starts[k + 1]]
        held[own] = 1
        both = np.add.reduceat(held[row[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        held[own] = 0
        like = low + np.flatnonzero((both / (sizes[k] + sizes[low:high] - both) >= SIMILARITY) & (label[low:high] != label[k]))
        for j in like.tolist():
            if label[j] != label[k]:
                links.append((int(order[k]), int(order[j])))
                label[label == label[j]] = label[k]
    return links


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) across the components of each key, from rows (key, node, root, hashes) in order of key."""
    for part in _runs(batches, 1):
        keys = part.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        names, links = part.column(1), []
        for at, end in zip(cuts, cuts[1:]):
            roots = np.unique(np.array(part.column(2).slice(at, end - at).to_pylist(), object), return_inverse=True)[1]
            sets = [np.frombuffer(h, np.uint64) for h in part.column(3).slice(at, end - at).to_pylist()]
            links += [(names[at + x].as_py(), names[at + y].as_py()) for x, y in similar_across(sets, roots)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _joined_across(stars: DataFrame, trees: DataFrame, bodies: DataFrame, set_bytes: int) -> DataFrame:
    """``stars`` (node, root) with the similar pairs of trees (node, tree) that stand in different components."""
    sized = bodies.select("node", F.octet_length("hashes").cast("bigint").alias("bytes"))
    placed = checkpoint(trees.join(stars, "node", "left").join(sized, "node").select("tree", "node", F.coalesce("root", "node").alias("root"), "bytes"))
    torn = placed.groupBy("tree").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("bytes").alias("all")).filter("low <> high")
    n = F.ceil(F.col("all") / set_bytes)
    met = placed.join(torn.select("tree", n.alias("n")), "tree").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    key = F.xxhash64("tree", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    dealt = checkpoint(met.withColumn("other", others).select(key, "node", "root").distinct())
    full = dealt.join(bodies, "node").select("key", "node", "root", "hashes")
    ship(bodies.sparkSession)
    links = checkpoint(full.repartition(shuffle_width(bodies.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_crossings, "a binary, b binary").distinct())
    return stars if links.isEmpty() else components(stars.toDF("a", "b").unionByName(links))


def _document(id_col: Column, th: Column) -> Column:
    """Orders documents by id, null last, then by text hash."""
    return F.struct(id_col.isNull().alias("no_id"), id_col.alias("id"), th.alias("th"))


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = KEY_BOUND, set_bytes: int = SET_BYTES) -> DataFrame:
    """(id, th, first): each row's document and the smallest document of its component, as struct (no_id, id, th)."""
    kind = dict(docs.dtypes)[id_col]
    x = F.col(text_col)
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(x), F.lit(0)).alias("th"), x.alias("text"))

    def make():
        def fn(ids, hashes, texts):
            found = [sketch(shingle_hashes(t)) for t in texts]
            return ids, hashes, *([f[k] for f in found] for k in range(4))

        return fn

    prints = checkpoint(map_rows(named, make, f"id {kind}, th bigint, node binary, fp bigint, sketch binary, bands array<bigint>"))
    first = {c: F.first(c).alias(c) for c in ("fp", "sketch", "bands")}  # equal for equal sets
    heads = checkpoint(prints.groupBy("node").agg(F.min(_document(F.col("id"), F.col("th"))).alias("head"), *first.values()))
    found = _candidate_links(heads, bound)
    links, trees = found.filter("tree IS NULL").select("a", "b"), found.filter("tree IS NOT NULL").select(F.col("a").alias("node"), "tree")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    wanted = checkpoint(ends.join(heads.select("node", "head.id", "head.th"), "node"))

    def sets():
        return lambda nodes, texts: (nodes, [shingle_hashes(t).tobytes() for t in texts])

    texts = named.alias("d").join(wanted.alias("w"), F.col("d.th").eqNullSafe(F.col("w.th")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select("node", "text")
    bodies = checkpoint(map_rows(texts.dropDuplicates(["node"]), sets, "node binary, hashes binary"))
    both = links.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def weigh():
        def fn(a, b, x, y):
            kept = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= SIMILARITY for p, q in zip(x, y)]
            return [v for v, k in zip(a, kept) if k], [v for v, k in zip(b, kept) if k]

        return fn

    stars = components(map_rows(both, weigh, "a binary, b binary"))
    if not trees.isEmpty():
        stars = _joined_across(stars, trees, bodies, set_bytes)
    settled = heads_of(stars, heads.select("node", F.col("head").alias("first")), "first")
    # Written first: joins of fresh exchanges are ones whose crowded keys can be split.
    whole = checkpoint(heads.join(settled, "node", "left").select("node", F.coalesce("first", "head").alias("first")))
    return prints.select("id", "th", "node").join(whole, "node").select("id", "th", "first")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = KEY_BOUND) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest document."""
    groups = near_components(docs, id_col=id_col, text_col=text_col, bound=bound)
    own = F.struct(F.col("id").isNull(), "id", "th")
    kept = groups.filter(own.eqNullSafe(F.struct("first.no_id", "first.id", "first.th"))).select("id", "th").distinct()
    # Named, so that the join's partitioning serves the removal of repeated rows too.
    keys = fresh(docs.columns, "_text_hash", "_id_text", "_no_id")

    def keyed(df: DataFrame, ident: Column, th: Column) -> DataFrame:
        return df.withColumns(dict(zip(keys, (th, F.coalesce(ident.cast("string"), F.lit("")), ident.isNull()))))

    hashed = keyed(docs, F.col(id_col), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)))
    wanted = keyed(kept.toDF("id", "th"), F.col("id"), F.col("th")).select(*keys)
    return hashed.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*(F.col(c) for c in docs.columns))

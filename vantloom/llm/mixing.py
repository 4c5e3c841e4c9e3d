"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A token budget goes down the tree domain - language - source. Among siblings it is shared by
weight; a node that cannot use its share (its documents times ``max_epochs``) is filled, and
what it leaves over goes to its siblings by weight first, and to its parent's siblings only
where they are all full. A leaf's tokens then come from seeded epochs: whole passes over its
documents while they fit, and of the last epoch the token-prefix of its seeded order, which
ends with the document that reaches the budget.

The order is that of md5(seed:epoch:id). A prefix is found without sorting a leaf: token sums by
the first digits of the key give the digits at which the budget ends, sums by the next digits
narrow that down, and only documents that share all those digits are ordered. What is joined
back is one row a leaf, broadcast when ``BROADCAST_LEAVES`` or fewer.

Defined results: null or unlisted domains and languages have the default weight, null language
and source are ``unknown``; null text has no tokens; weight 0 gives nothing; rows of equal id in
a leaf stand or fall together; a leaf without tokens gives no rows; an empty table gives an
empty table; a document that is read in several epochs gives a row for each; all columns of the input
are kept, and an added column whose name is taken gets one more underscore; a source may end in a
number of any length; very long texts are only counted, within Spark's own string functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantloom.llm.batches import fresh
from vantloom.runtime import checkpoint, table

LEAF = ("_domain", "_lang", "_source")
#: Columns that the result has after those of the input.
ADDED = ("_epoch", *LEAF)
#: Names that the plan uses beside the input's.
HELPERS = (*ADDED, "_whole", "_cut")
#: Hexadecimal digits of the order key that each round of sums goes on by.
DIGITS = 2
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Targets. Weights are whole numbers; ``budget_percent`` is of the tokens the table holds."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "news": 30, "books": 20, "forum": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "fr": 20, "de": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 5
    budget_percent: int = 80
    max_epochs: int = 2
    seed: int = 11


PRODUCTION = Mix()


def domain_of(source: Column) -> Column:
    """Domain of a source by the number its name ends with; ``other`` without one."""
    kinds = F.array(F.lit("web"), F.lit("news"), F.lit("books"), F.lit("forum"))
    # The last two digits tell the rest by 4, however long the number is.
    number = F.regexp_extract(source, r"([0-9]{1,2})\z", 1)
    return F.when(number == "", "other").otherwise(F.element_at(kinds, number.cast("int") % 4 + 1))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def _weight(name: str, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("bigint")
    known = F.create_map(*(F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)))
    return F.coalesce(F.element_at(known, F.col(name)), F.lit(default)).cast("bigint")


def with_leaf(docs: DataFrame) -> DataFrame:
    source = F.coalesce("source", F.lit("unknown"))
    return docs.withColumns({"_domain": domain_of(source), "_lang": F.coalesce("lang", F.lit("unknown")), "_source": source})


def order_key(seed: int, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def share(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Water-filling: ``out`` is each node's part of its parent's ``budget``, by weight w and capacity cap.

    In order of capacity by weight, a node is full if its capacity is within what a unit of weight
    still gets; the nodes after the full ones share the rest.
    """
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0)
    order = Window.partitionBy(*parent).orderBy("_ratio", *[c for c in LEAF if c in nodes.columns])
    whole = Window.partitionBy(*parent)
    df = nodes.withColumn("_ratio", ratio)
    df = df.withColumn("_cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    df = df.withColumn("_w_from", F.sum("w").over(whole) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
    full = (F.col("w") == 0) | (F.col("_ratio") * F.col("_w_from") <= F.col(budget) - F.col("_cap_before"))
    df = df.withColumn("_full", full)
    df = df.withColumn("_cap_full", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole))
    df = df.withColumn("_w_free", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(whole))
    part = F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col(budget) - F.col("_cap_full")) / F.col("_w_free"))
    return df.withColumn(out, part).drop("_ratio", "_cap_before", "_w_from", "_full", "_cap_full", "_w_free")


def plan(counted: DataFrame, mix: Mix) -> DataFrame:
    """(leaf, tokens, target, epochs, rest) from (leaf, _tokens) rows: whole epochs, and tokens of the one after."""
    leaves = counted.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"))
    leaves = leaves.withColumn("w3", _weight("_source", mix.sources, mix.default)).withColumn("w2", _weight("_lang", mix.languages, mix.default)).withColumn("w1", _weight("_domain", mix.domains, mix.default))
    c3 = leaves.withColumn("cap3", F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("tokens") * mix.max_epochs).otherwise(0))
    c2 = c3.groupBy("_domain", "_lang").agg(F.sum("cap3").alias("cap"), F.first("w2").alias("w"))
    c1 = c2.groupBy("_domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("_domain", mix.domains, mix.default))
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * mix.budget_percent / 100), F.lit(0)).cast("double")).scalar()
    top = share(c1.withColumns({"_root": F.lit(0), "b0": total}), ["_root"], "b0", "b1").select("_domain", "b1")
    middle = share(c2.join(top, "_domain"), ["_domain"], "b1", "b2").select("_domain", "_lang", "b2")
    bottom = share(c3.withColumnsRenamed({"w3": "w", "cap3": "cap"}).join(middle, ["_domain", "_lang"]), ["_domain", "_lang"], "b2", "target")
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("bigint")
    return bottom.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("tokens")).cast("bigint")).select(*LEAF, "tokens", "target", "epochs", "rest")


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_LEAVES else small


def cuts(counted: DataFrame, planned: DataFrame, mix: Mix, leaves: int, id_col: str) -> DataFrame:
    """(leaf, cut): in the epoch after the whole ones, documents with a key up to ``cut`` are in.

    Each round sums the tokens of a leaf by the next digits of the key and goes on with the digits
    at which the budget ends, so a window has 16**DIGITS rows of a leaf at most.
    """
    keyed = counted.join(_sized(planned.filter("rest > 0").select(*LEAF, "epochs", "rest"), leaves), list(LEAF))
    keyed = keyed.withColumn("_key", order_key(mix.seed, F.col("epochs"), id_col)).withColumn("before", F.lit(0).cast("bigint"))
    upto = Window.partitionBy(*LEAF).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for digits in (DIGITS, 2 * DIGITS, 3 * DIGITS, 32):
        sums = keyed.groupBy(*LEAF, "rest", "before", F.substring("_key", 1, digits).alias("_at")).agg(F.sum("_tokens").alias("t"), F.max("_key").alias("last"))
        inside = sums.withColumn("before", F.col("before") + F.sum("t").over(upto) - F.col("t")).filter("before < rest")
        edge = checkpoint(inside.groupBy(*LEAF).agg(F.max(F.struct("_at", "before", "last")).alias("e")).select(*LEAF, "e.*"))
        if digits < 32:
            narrowed = keyed.drop("before").withColumn("_at", F.substring("_key", 1, digits))
            keyed = narrowed.join(_sized(edge.drop("last"), leaves), [*LEAF, "_at"]).drop("_at")
    return edge.select(*LEAF, F.col("last").alias("cut"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` by the targets: each row once for every epoch that takes it, with column _epoch and the leaf's columns.

    Added columns stand after the input's and get one more underscore where the input has their name.
    """
    # Columns of the input that are named like the helpers step aside until the end.
    aside = [c for c in docs.columns if c.lower() in HELPERS]
    kept = dict(zip(aside, fresh([*docs.columns, *HELPERS], *(f"_own{c}" for c in aside))))
    leafed = with_leaf(docs.withColumnsRenamed(kept))
    counted = checkpoint(leafed.select(F.col(id_col), *LEAF, tokens_of(F.col(text_col)).alias("_tokens")))
    planned = checkpoint(plan(counted, mix))
    leaves = planned.count()
    ends = checkpoint(planned.join(cuts(counted, planned, mix, leaves, id_col), list(LEAF), "left").select(*LEAF, F.col("epochs").alias("_whole"), F.col("cut").alias("_cut")))
    joined = leafed.join(_sized(ends, leaves), list(LEAF))
    whole = F.when(F.col("_whole") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    part = F.when(order_key(mix.seed, F.col("_whole"), id_col) <= F.col("_cut"), F.array("_whole")).otherwise(F.array().cast("array<bigint>"))
    mixed = joined.withColumn("_epoch", F.explode(F.concat(whole, part)))
    added = zip(ADDED, fresh(docs.columns, *ADDED))
    return mixed.select(*(F.col(kept.get(c, c)).alias(c) for c in docs.columns), *(F.col(c).alias(name) for c, name in added))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_documents(docs)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), tokens_of(F.col("text")).alias("n_tokens"))


def _share_sql(nodes: str, parent: str, budget: str, out: str, keys: str) -> str:
    over = f"PARTITION BY {parent}"
    order = f"{over} ORDER BY ratio, {keys} ROWS UNBOUNDED PRECEDING"
    return f"""
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE w * ({budget} - cap_full) / w_free END AS {out} FROM (
    SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({over})::BIGINT AS cap_full,
      sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({over})::BIGINT AS w_free FROM (
      SELECT *, w = 0 OR ratio * w_from <= {budget} - cap_before AS is_full FROM (
        SELECT *, (sum(cap) OVER ({order}) - cap)::BIGINT AS cap_before,
          (sum(w) OVER ({over}) - sum(w) OVER ({order}) + w)::BIGINT AS w_from FROM (
          SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0.0 END AS ratio FROM ({nodes})))))"""


OP2_SQL = rf"""
WITH leafed AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS n_tokens,
    regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,2}})\z', 1) AS number
  FROM documents
), counted AS (
  SELECT *, CASE WHEN number = '' THEN 'other' ELSE ['web', 'news', 'books', 'forum'][CAST(number AS BIGINT) % 4 + 1] END AS domain FROM leafed
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 5::BIGINT AS w, sum(n_tokens)::BIGINT * 2 AS cap FROM counted GROUP BY ALL
), c2 AS (
  SELECT domain, lang, sum(cap)::BIGINT AS cap, (CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 WHEN 'es' THEN 10 ELSE 5 END)::BIGINT AS w
  FROM leaves GROUP BY domain, lang
), c1 AS (
  SELECT domain, 0 AS root, sum(cap)::BIGINT AS cap, (CASE domain WHEN 'web' THEN 40 WHEN 'news' THEN 30 WHEN 'books' THEN 20 WHEN 'forum' THEN 10 ELSE 5 END)::BIGINT AS w,
    (SELECT coalesce(floor(sum(tokens)::BIGINT * 80 / 100), 0)::DOUBLE FROM leaves) AS b0
  FROM c2 GROUP BY domain
), top AS ({_share_sql("SELECT * FROM c1", "root", "b0", "b1", "domain")}
), middle AS ({_share_sql("SELECT c2.*, b1 FROM c2 JOIN top USING (domain)", "domain", "b1", "b2", "domain, lang")}
), bottom AS ({_share_sql("SELECT leaves.*, b2 FROM leaves JOIN middle USING (domain, lang)", "domain, lang", "b2", "target", "domain, lang, source")}
), planned AS (
  SELECT *, floor(target - epochs * tokens)::BIGINT AS rest FROM (
    SELECT *, (CASE WHEN tokens > 0 THEN floor(target / tokens) ELSE 0 END)::BIGINT AS epochs FROM bottom)
), keyed AS (
  SELECT counted.*, epochs, rest, md5('11:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM counted JOIN planned USING (domain, lang, source)
), ordered AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM keyed
)
SELECT doc_id, domain, lang, source, epoch, n_tokens FROM (
  SELECT *, unnest(range(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END))::BIGINT AS epoch FROM ordered)
"""

"""Text operators: cleaners, normalisers, tokenizers, filters, weights, statistics, features.

Unicode normal forms, item counts and the statistics of a text run over Arrow batches, the rest is
built-in functions. Corpus statistics are grouped
counts in long form, (document, term, weight), joined by term; nothing has a column a term.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from vantloom.functions import kernels
from vantloom.functions import words as W
from vantloom.functions.binding import let
from vantloom.runtime import checkpoint, ship, ship_active

#: ASCII white space; the same set in every engine that checks these operators.
BLANK = r"[ \t\n\x0B\f\r]+"
SOLID = r"[^ \t\n\x0B\f\r]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

Fn = Callable[[Column], Column]


def chain(c: Column, *steps: Fn) -> Column:
    return reduce(lambda x, f: f(x), steps, c)


def _drop(pattern: str, by: str = "") -> Fn:
    return lambda c: F.regexp_replace(c, pattern, by)


# -- Cleaners and normalisers ------------------------------------------------------------------

CLEANERS: dict[str, Fn] = {
    "punctuation": _drop(r"[^\w\s]"),
    "digits": _drop(r"\d+"),
    "html": _drop(W.HTML_TAG),
    "url": _drop(W.URL),
    "email": _drop(W.EMAIL),
    "emoji": _drop(W.EMOJI),
    "whitespace": lambda c: F.trim(F.regexp_replace(c, BLANK, " ")),
    "special": _drop(r"[^\p{L}\p{N}\s.,!?\-:;'\"]"),
    "repeats": _drop(r"(.)\1{2,}", "$1$1"),
    "non_ascii": _drop(r"[^\x00-\x7F]"),
}


def fix_misspellings(c: Column) -> Column:
    for wrong, right in W.MISSPELLINGS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def clean(c: Column, *, html: bool = True, emoji: bool = True, special: bool = False, repeats: bool = True, non_ascii: bool = False, misspellings: bool = True, patterns: tuple[tuple[str, str], ...] = (), min_bytes: int = 1) -> Column:
    """Standard cleaner in its fixed order; null where the trimmed result is shorter than ``min_bytes``."""
    steps = [CLEANERS[n] for n, on in (("html", html), ("emoji", emoji), ("special", special), ("repeats", repeats), ("non_ascii", non_ascii)) if on]
    steps += [fix_misspellings] * misspellings + [_drop(p, r) for p, r in patterns]
    out = chain(c, *steps)
    return F.when(F.octet_length(F.trim(out)) >= min_bytes, out)


def half_width(c: Column) -> Column:
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, wide, "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)) + " ")


def unicode_form(c: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD, in Arrow batches."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal(c)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(unicode_form(c, "NFD"), r"\p{M}", "")


def normalize_text(c: Column, *, lower: bool = True, punctuation: bool = True, digits: bool = False, url: bool = True, email: bool = True, whitespace: bool = True) -> Column:
    """Standard normaliser: URLs and addresses first, so that punctuation does not break them."""
    names = [n for n, on in (("url", url), ("email", email), ("punctuation", punctuation), ("digits", digits), ("whitespace", whitespace)) if on]
    out = chain(c, *(CLEANERS[n] for n in names))
    return F.lower(out) if lower else out


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SOLID), F.lit(0))


def stem(w: Column) -> Column:
    """Suffixes ing, ly, s, ed, the first that fits, of words with bytes to spare."""
    n = F.octet_length(w)
    cut = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    return (
        F.when(F.endswith(w, F.lit("ing")) & (n > 4), cut(3))
        .when(F.endswith(w, F.lit("ly")) & (n > 3), cut(2))
        .when(F.endswith(w, F.lit("s")) & (n > 2), cut(1))
        .when(F.endswith(w, F.lit("ed")) & (n > 3), cut(2))
        .otherwise(w)
    )


def stem_text(c: Column) -> Column:
    return F.array_join(F.transform(words(F.lower(c)), stem), " ")


def lemma(w: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in W.LEMMAS.items() for x in pair))
    return F.coalesce(F.element_at(known, w), w)


# -- Tokenizers ----------------------------------------------------------------------------


def _grams(tokens: Column, n: int, sep: str) -> Column:
    """Runs of ``n`` tokens, joined; ``tokens`` is a bound variable."""
    run = F.transform(F.slice(tokens, 1, F.size(tokens) - n + 1), lambda _, i: F.concat_ws(sep, *(F.get(tokens, i + k) for k in range(n))))
    return F.when(F.size(tokens) >= n, run).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """Character n-grams by length, then by place."""
    return let(TOKENIZERS["character"](c), lambda ch: F.concat(*(_grams(ch, n, "") for n in range(low, high + 1))))


def word_ngrams(tokens: Column, n: int) -> Column:
    return let(tokens, lambda w: _grams(w, n, " "))


TOKENIZERS: dict[str, Fn] = {
    "whitespace": words,
    "punctuation": lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != ""),
    "character": lambda c: F.filter(F.split(c, ""), lambda w: w != ""),
    "grapheme": lambda c: F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0)),
    "word": lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
    "stem": lambda c: F.transform(words(F.lower(c)), stem),
    "cjk": lambda c: F.regexp_extract_all(c, F.lit(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]|[^\s\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+"), F.lit(0)),
    "bigram": lambda c: F.when(F.length(c) < 2, F.array(c)).otherwise(char_ngrams(c, 2, 2)),
    "trigram": lambda c: F.when(F.length(c) < 3, F.array(c)).otherwise(char_ngrams(c, 3, 3)),
}


def tokenize(c: Column, kind: str = "whitespace", *, case_sensitive: bool = False, min_bytes: int = 1, stopwords: tuple[str, ...] = (), pattern: str | None = None, delimiter: str | None = None, low: int = 1, high: int = 1) -> Column:
    text = c if case_sensitive else F.lower(c)
    if kind == "regex":
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    elif kind == "delimiter":
        tokens = F.filter(F.transform(F.split(text, F.lit("\\Q" + delimiter + "\\E")), lambda s: F.trim(s)), lambda w: w != "")
    elif kind == "ngram":
        tokens = char_ngrams(text, low, high)
    else:
        tokens = TOKENIZERS[kind](text)
    return filter_tokens(tokens, min_bytes=min_bytes, stopwords=stopwords)


def filter_tokens(tokens: Column, *, min_bytes: int = 0, min_chars: int = 0, max_chars: int | None = None, stopwords: tuple[str, ...] = (), keep: str | None = None, drop: str | None = None) -> Column:
    def good(w: Column) -> Column:
        out = (F.octet_length(w) >= min_bytes) & (F.length(w) >= min_chars)
        if max_chars is not None:
            out = out & (F.length(w) <= max_chars)
        if stopwords:
            out = out & ~w.isin(*stopwords)
        if keep is not None:
            out = out & w.rlike(keep)
        return out if drop is None else out & ~w.rlike(drop)

    return F.filter(tokens, good)


def filter_by_frequency(df: DataFrame, tokens: str, id_col: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, tokens): tokens whose count in the corpus lies within the bounds, in their order."""
    at = df.select(id_col, F.posexplode(tokens).alias("p", "w"))
    counts = at.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # Written first: a word of every document is then a key that the join's exchanges can split.
    counts = checkpoint(counts.filter((F.lit(True) if low is None else F.col("n") >= low) & (F.lit(True) if high is None else F.col("n") <= high)))
    kept = at.join(counts, "w").groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "w"))), lambda s: s["w"]).alias(tokens))
    return df.select(id_col).join(kept, id_col, "left").withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>")))


# -- Term weights --------------------------------------------------------------------------


def term_counts(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, n)."""
    return df.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


IDF: dict[str, Callable[[Column, Column], Column]] = {
    "smooth_plus_one": lambda n, df: F.log((n + 1) / (df + 1)) + 1,
    "plain_plus_one": lambda n, df: F.log(n / (df + 1)) + 1,
    "smooth": lambda n, df: F.log((n + 1) / (df + 1)),
    "plain": lambda n, df: F.log(n / F.greatest(df, F.lit(1))),
}


def tfidf(df: DataFrame, id_col: str, tokens: Column, *, tf: str = "raw", idf: str = "smooth_plus_one", norm: str | None = "l2", min_df: float = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(id, term, weight). min_df below 1 and max_df up to 1 are shares of the documents.

    The vocabulary is cut by document frequency, ties by term. One shuffle counts terms of
    documents, one counts documents of terms; the vocabulary joins back by term. Both are written
    before that join, so a term of every document is a key that adaptive execution splits; lengths
    are sums over a document's own rows.
    """
    counts = checkpoint(term_counts(df, id_col, tokens))
    n = df.agg(F.count(F.lit(1))).scalar()
    low = F.ceil(n * min_df) if min_df < 1 else F.lit(int(min_df))
    high = F.floor(n * max_df) if max_df <= 1 else F.lit(int(max_df))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    trivial = min_df == 1 and max_df == 1.0  # every term's document frequency lies within
    vocabulary = vocabulary if trivial else vocabulary.filter((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("df"), "term").limit(max_features)
    own = Window.partitionBy(id_col)
    counts = counts.withColumn("size", F.sum("n").over(own)) if tf == "share" else counts
    weighted = counts if trivial and idf is None and max_features is None else counts.join(checkpoint(vocabulary), "term")
    base = {"raw": F.col("n").cast("double"), "binary": F.lit(1.0), "sublinear": 1 + F.log("n"), "share": F.col("n") / F.col("size") if tf == "share" else None}
    out = weighted.select(id_col, "term", (base[tf] * (IDF[idf](n.cast("double"), F.col("df").cast("double")) if idf else F.lit(1.0))).alias("weight"))
    if norm is None:
        return out
    length = {"l2": F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own)), "l1": F.sum(F.abs("weight")).over(own)}[norm]
    out = out.withColumn("length", length)
    return out.select(id_col, "term", F.when(F.col("length") == 0, F.col("weight")).otherwise(F.col("weight") / F.col("length")).alias("weight"))


def bag_of_words(df: DataFrame, id_col: str, tokens: Column, **kw) -> DataFrame:
    return tfidf(df, id_col, tokens, idf=None, norm=None, **kw)


def word_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """(term, n, share) over the corpus."""
    counts = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


@F.arrow_udf(StructType([StructField("k", ArrayType(StringType())), StructField("n", ArrayType(IntegerType()))]))
def _counted(items: pa.Array) -> pa.Array:
    """Distinct items of each list, in order, and how often each stands there; one pass over a list."""
    out = []
    for row in items.to_pylist():
        counts = sorted(Counter(x for x in row if x is not None).items()) if row is not None else []
        out.append(None if row is None else {"k": [k for k, _ in counts], "n": [n for _, n in counts]})
    return pa.array(out, pa.struct([("k", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))]))


def counted(items: Column) -> Column:
    """Struct k, n: distinct items of an array of strings in order, and their counts."""
    ship_active()
    return _counted(items)


def char_frequency(c: Column) -> Column:
    """Map of each character of a text to its share; one pass over the text."""
    return let(counted(TOKENIZERS["character"](c)), lambda x: F.map_from_arrays(x["k"], F.transform(x["n"], lambda n: n / F.length(c))))


# -- Statistics and features ------------------------------------------------------------------


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of == 0, 0.0).otherwise(n / of)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


STATS = ("chars", "words", "sentences", "lines", "word_length", "unique_ratio", "sentence_words", "stopword_ratio", "punctuation_ratio", "upper_ratio", "digit_ratio", "diversity", "word_length_std", "special_ratio")


@F.arrow_udf(StructType([StructField(name, DoubleType()) for name in STATS]))
def _text_stats(texts: pa.Array) -> pa.Array:
    """All statistics of a batch from flat arrays: words are split, measured and numbered once."""
    n = len(texts)
    known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts, "")
    as_numbers = lambda x: np.asarray(pc.cast(x, pa.int64()))
    split = pc.split_pattern_regex(texts, r"[ \t\n\x0B\f\r]+")
    doc, word = np.asarray(pc.list_parent_indices(split)), pc.list_flatten(split)
    length = as_numbers(pc.utf8_length(word))
    real = length > 0
    doc, word, length = doc[real], word.filter(pa.array(real)), length[real]
    n_words = np.bincount(doc, minlength=n)
    total, squares = np.bincount(doc, length, n), np.bincount(doc, length * length, n)
    lower = pc.utf8_lower(word)
    codes = np.asarray(pc.dictionary_encode(lower).indices).astype(np.int64)
    unique = np.bincount(np.unique(doc.astype(np.int64) << 32 | codes) >> 32, minlength=n)
    stops = np.bincount(doc, np.asarray(pc.cast(pc.is_in(lower, pa.array(W.STOPWORDS)), pa.int8())), n)
    sentence = pc.split_pattern_regex(texts, "[.?!]")
    of, body = np.asarray(pc.list_parent_indices(sentence)), pc.list_flatten(sentence)
    in_sentence = as_numbers(pc.count_substring_regex(body, SOLID))
    n_sentences = np.bincount(of[in_sentence > 0], minlength=n)
    spoken = np.bincount(of, in_sentence, n)
    lines = 1 + as_numbers(pc.count_substring(texts, "\n")) - np.asarray(pc.cast(pc.ends_with(texts, "\n"), pa.int64()))
    chars = as_numbers(pc.utf8_length(texts))

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(n), where=b != 0)

    def share(pattern: str) -> np.ndarray:
        return ratio(as_numbers(pc.count_substring_regex(texts, pattern)), chars)

    mean, variety = ratio(total, n_words), ratio(unique, n_words)
    cells = (
        chars / 1000,
        n_words / 100,
        n_sentences / 10,
        lines / 10,
        mean,
        variety,
        ratio(spoken, n_sentences) / 20,
        ratio(stops, n_words),
        share(PUNCTUATION),
        share(r"\p{Lu}"),
        share("[0-9]"),
        variety,
        np.sqrt(np.maximum(0.0, ratio(squares, n_words) - mean * mean)),
        share(r"[^\p{L}\p{N}\s!-/:-@\[-`{-~]"),
    )
    return pa.StructArray.from_arrays([pa.array(np.asarray(c, float)) for c in cells], list(STATS), mask=pa.array(~known))


def text_stats(c: Column) -> Column:
    """Struct of fourteen statistics, scaled; null for null."""
    ship_active()
    return _text_stats(c)


def basic_features(c: Column) -> Column:
    n_words, n_chars = count(c, SOLID), F.length(c)
    return F.struct(
        F.octet_length(c).alias("bytes"),
        n_words.alias("words"),
        n_chars.alias("chars"),
        F.size(F.array_distinct(TOKENIZERS["character"](c))).alias("unique_chars"),
        _ratio(n_chars, n_words).alias("word_length"),
        count(c, r"\p{Nd}").alias("digits"),
        count(c, r"\p{Lu}").alias("upper"),
        count(c, r"\p{Ll}").alias("lower"),
        count(c, PUNCTUATION).alias("punctuation"),
    )


def entity_counts(c: Column, kinds: tuple[str, ...] = tuple(W.ENTITIES)) -> Column:
    return F.struct(*(count(c, W.ENTITIES[k]).alias(k) for k in kinds))


def entities(c: Column, kind: str) -> Column:
    return F.regexp_extract_all(c, F.lit(W.ENTITIES[kind]), F.lit(0))


def sentiment(c: Column) -> Column:
    """Struct of positive, negative, neutral, compound, subjectivity, intensity.

    A word's value is that of the lexicon, times the intensifier before it, turned by a negation
    before it. Negations and intensifiers are looked up in the whole text's words.
    """
    bare = F.transform(words(F.lower(c)), lambda x: F.regexp_replace(x, rf"^{PUNCTUATION}+|{PUNCTUATION}+$", ""))
    lexicon = F.create_map(*(F.lit(x) for pair in W.SENTIMENT.items() for x in pair))
    strength = F.create_map(*(F.lit(x) for pair in W.INTENSIFIERS.items() for x in pair))

    def value(x: Column, before: Column) -> Column:
        times = F.coalesce(F.element_at(strength, before), F.lit(1.0))
        sign = F.when(F.coalesce(before.isin(*W.NEGATIONS), F.lit(False)), -1.0).otherwise(1.0)
        return F.struct((F.element_at(lexicon, x) * times * sign).alias("v"), times.alias("t"))

    valued = let(bare, lambda w: F.zip_with(w, F.slice(F.concat(F.array(F.lit("")), w), 1, F.size(w)), value))
    return let(F.filter(valued, lambda s: s["v"].isNotNull()), _polarity)


def _polarity(hits: Column) -> Column:
    n = F.size(hits)
    pos, neg = F.size(F.filter(hits, lambda s: s["v"] > 0)), F.size(F.filter(hits, lambda s: s["v"] < 0))
    return F.struct(
        _ratio(pos, n).alias("positive"),
        _ratio(neg, n).alias("negative"),
        _ratio(n - pos - neg, n).alias("neutral"),
        _ratio(pos - neg, n).alias("compound"),
        _ratio(_total(F.transform(hits, lambda s: F.abs(s["v"]))), n).alias("subjectivity"),
        _ratio(_total(F.transform(hits, lambda s: s["t"])), n).alias("intensity"),
    )


def detect_language(c: Column) -> Column:
    """Language by the share of words that hold one of its marks; without any, by script."""
    marks = lambda w: F.array(*(F.struct(_ratio(_holding(w, "|".join(parts)), F.size(w)).alias("score"), F.lit(-k).alias("order"), F.lit(code).alias("code")) for k, (code, parts) in enumerate(W.LANGUAGE_PARTS.items())))
    best = F.array_max(let(words(F.lower(c)), marks))
    n = F.length(c)
    script = (
        F.when(count(c, r"[\x{4E00}-\x{9FFF}]") / n > 0.3, "zh")
        .when(count(c, r"[\x{3040}-\x{30FF}]") / n > 0.3, "ja")
        .when(count(c, r"[\x{AC00}-\x{D7AF}]") / n > 0.3, "ko")
        .when(count(c, r"[\x{0600}-\x{06FF}]") / n > 0.3, "ar")
        .when(count(c, r"[\x{0400}-\x{04FF}]") / n > 0.3, "ru")
        .when(count(c, "[A-Za-z]") / n > 0.5, "en")
        .otherwise("unknown")
    )
    return F.when(n == 0, "unknown").when(best["score"] > 0, best["code"]).otherwise(script)


def _holding(w: Column, pattern: str) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike(pattern)))


def hash_embedding(tokens: Column, dim: int, pooling: str = "mean", normalize: bool = True) -> Column:
    """Pooled vectors of tokens, each made from seeded hashes of the token; mean, sum or max."""

    def pooled(k: int) -> Column:
        cells = F.transform(tokens, lambda w: (F.pmod(F.xxhash64(F.lit(k), w), F.lit(2_000_001)) - 1_000_000) / 1_000_000)
        if pooling == "max":
            return F.coalesce(F.array_max(cells), F.lit(0.0))
        total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
        return total / F.greatest(F.size(tokens), F.lit(1)) if pooling == "mean" else total

    v = F.array(*(pooled(k) for k in range(dim)))
    return let(v, _unit) if normalize else v


def _unit(v: Column) -> Column:
    norm = F.sqrt(_total(F.transform(v, lambda x: x * x)))
    return F.when(norm == 0, v).otherwise(_times(v, norm, divide=True))


def _times(v: Column, factor, divide: bool = False) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    return let(factor, lambda k: F.transform(v, lambda x: x / k if divide else x * k))


def fuse(vectors: list[Column], how: str = "concat", weights: list[float] | None = None) -> Column:
    """concat; average (weighted, equal lengths); attention (weights by share of features); gated (sigmoid of the mean over 0.5)."""
    if how == "concat":
        return F.concat(*vectors)
    if how == "average":
        w = weights or [1.0] * len(vectors)
        parts = [_times(v, k) for v, k in zip(vectors, w)]
        return F.transform(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts), lambda x: x / sum(w))
    if how == "attention":
        sizes = reduce(lambda a, b: a + b, [F.size(v) for v in vectors])
        return F.concat(*(_times(v, F.size(v) / sizes) for v in vectors))

    def gated(v: Column) -> Column:
        gate = 1 / (1 + F.exp(-_total(v) / F.size(v)))
        return F.when(gate > 0.5, _times(v, gate)).otherwise(F.array().cast("array<double>"))

    return F.concat(*(gated(v) for v in vectors))


def most_similar(df: DataFrame, query: str, text_col: str, id_col: str, k: int) -> DataFrame:
    """(id, score): texts by Jaccard similarity of their word sets with the query's."""
    own = F.array_distinct(words(F.lower(F.lit(query))))
    w = F.array_distinct(words(F.lower(F.col(text_col))))
    score = _ratio(F.size(F.array_intersect(w, own)), F.size(F.array_union(w, own)))
    return df.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def batch_similarity(df: DataFrame, query: Column, vector_col: str, id_col: str, metric: str = "cosine") -> DataFrame:
    """(id, score): every candidate's similarity with the query."""
    return df.select(id_col, kernels.COLLECTION_SCORE[metric](F.col(vector_col), query).alias("score"))


def find_most_similar(df: DataFrame, query: Column, vector_col: str, id_col: str, k: int, metric: str = "cosine") -> DataFrame:
    """(id, score): the k candidates of the highest similarity, ties by id."""
    return batch_similarity(df, query, vector_col, id_col, metric).orderBy(F.desc("score"), id_col).limit(k)


def prepare(df: DataFrame) -> DataFrame:
    """``df``, with this package on the executors for the functions that need Python there."""
    ship(df.sparkSession)
    return df


def top_terms(weights: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, term, weight, rank): the k heaviest terms of each document."""
    order = Window.partitionBy(id_col).orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vocabulary(df: DataFrame, tokens: str, size: int, min_count: int = 1) -> DataFrame:
    """(term, id): the commonest terms, ids from 2 by count, then by term; 0 pads and 1 is unknown.

    Only the ``size`` rows that stay are numbered in one task.
    """
    counts = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1).cast("bigint")).select("term", "id")


def encode_ids(df: DataFrame, id_col: str, tokens: str, vocabulary: DataFrame, length: int | None = None) -> DataFrame:
    """(id, ids): each text's term ids in order, cut or padded to ``length`` if given."""
    at = df.select(id_col, F.posexplode(tokens).alias("p", "term")).join(vocabulary, "term", "left")
    ids = at.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("id", F.lit(1).cast("bigint")).alias("i")))), lambda s: s["i"]).alias("ids"))
    if length is None:
        return ids
    return ids.withColumn("ids", F.slice(F.concat("ids", F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length))


def decode_ids(df: DataFrame, id_col: str, ids: str, vocabulary: DataFrame) -> DataFrame:
    """(id, text): terms of the ids, unknown ones as <unk>, padding left out."""
    at = df.select(id_col, F.posexplode(ids).alias("p", "id")).filter(F.col("id") > 0).join(vocabulary, "id", "left")
    words_ = F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("term", F.lit("<unk>")).alias("w")))), lambda s: s["w"])
    return at.groupBy(id_col).agg(F.array_join(words_, " ").alias("text"))


def topics(df: DataFrame, id_col: str, tokens: Column, k: int = 10, buckets: int = 1 << 16, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(id, topics array<double>): topic shares by latent Dirichlet allocation over all terms, hashed to ``buckets``.

    Every term counts; what the driver holds is k x buckets numbers. A text without terms has equal shares.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    listed = df.select(id_col, F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    hashed = HashingTF(inputCol="tokens", outputCol="features", numFeatures=buckets).transform(listed)
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online").fit(hashed)
    return model.transform(hashed).select(id_col, vector_to_array("topicDistribution").alias("topics"))


# Mean text lengths at which the method of feature extraction changes.
METHOD_LENGTHS = ((50, "bag_of_words"), (200, "char_ngrams"), (1000, "tfidf"))


def choose_method(df: DataFrame, text_col: str) -> DataFrame:
    """One row: the method that suits the mean length, the mean length, the number of texts."""
    mean = F.avg(F.length(text_col))
    method = F.lit("tfidf_sublinear")
    for limit, name in reversed(METHOD_LENGTHS):
        method = F.when(mean < limit, name).otherwise(method)
    return df.agg(method.alias("method"), mean.alias("avg_chars"), F.count(F.lit(1)).alias("n"))

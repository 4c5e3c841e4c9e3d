"""Queries over ``documents``, ``pages``, ``benchmark`` and ``conversations``: text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantloom.functions import kernels
from vantloom.functions import words as W
from vantloom.operators import text as T
from vantloom.queries import query
from vantloom.runtime import spread, table
from vantloom.streaming import streams

_SOLID = r"[^ \t\n\x0B\f\r]+"
_WORDS = rf"regexp_extract_all(text, '{_SOLID}')"
_LOWER = rf"regexp_extract_all(lower(text), '{_SOLID}')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return T.prepare(spread(table(spark, sf, "documents").select("doc_id", "text")))


def _text_query(name: str, sql: str, fn) -> None:
    @query(name, f"SELECT doc_id, {sql} AS out FROM documents")
    def run(spark: SparkSession, sf: str, fn=fn) -> DataFrame:
        return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias("out"))


def _misspelt(sql: str) -> str:
    for wrong, right in W.MISSPELLINGS:
        sql = f"replace({sql}, '{wrong}', '{right.replace(chr(39), chr(39) * 2)}')"
    return sql


_text_query("t1_standard_cleaner", _misspelt("regexp_replace(text, '<[^>]*>', '', 'g')"), lambda c: T.clean(c, repeats=False, emoji=False))
_text_query("t2_strip_digits", r"regexp_replace(text, '[0-9]+', '', 'g')", T.CLEANERS["digits"])
_text_query("t2_strip_urls", r"regexp_replace(text, 'https?://[^\s]+|www\.[^\s]+', '', 'g')", T.CLEANERS["url"])
_text_query("t2_strip_emails", rf"regexp_replace(text, '{W.EMAIL}', '', 'g')", T.CLEANERS["email"])
_text_query("t2_strip_emoji", rf"regexp_replace(text, '{W.EMOJI}', '', 'g')", T.CLEANERS["emoji"])
_text_query("t2_collapse_whitespace", r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))", T.CLEANERS["whitespace"])
_text_query("t2_strip_non_ascii", r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')", T.CLEANERS["non_ascii"])
_text_query("t3_normalize_text", r"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+|www\.[^\s]+', '', 'g'), '[0-9]+', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))", lambda c: T.normalize_text(c, punctuation=False, digits=True, email=False))
_text_query("t3_nfc_form", "nfc_normalize(text)", lambda c: T.unicode_form(c, "NFC"))
_text_query("t3_half_width", "text", T.half_width)
_text_query(
    "t4_stem_text",
    rf"""array_to_string(list_transform({_LOWER}, lambda w: CASE WHEN suffix(w, 'ing') AND strlen(w) > 4 THEN left(w, length(w) - 3) WHEN suffix(w, 'ly') AND strlen(w) > 3 THEN left(w, length(w) - 2)
    WHEN suffix(w, 's') AND strlen(w) > 2 THEN left(w, length(w) - 1) WHEN suffix(w, 'ed') AND strlen(w) > 3 THEN left(w, length(w) - 2) ELSE w END), ' ')""",
    T.stem_text,
)
_text_query("t5_strip_accents", "strip_accents(lower(text))", lambda c: T.strip_accents(F.lower(c)))
_text_query("t6_whitespace_tokens", f"md5(array_to_string({_LOWER}, chr(10)))", lambda c: F.md5(F.array_join(T.tokenize(c), "\n")))


def _list_text_query(name: str, listed: str, sql: str, fn) -> None:
    @query(name, f"WITH l AS (SELECT doc_id, {listed} AS w FROM documents) SELECT doc_id, md5(array_to_string({sql}, chr(10))) AS out FROM l")
    def run(spark: SparkSession, sf: str, fn=fn) -> DataFrame:
        return _docs(spark, sf).select("doc_id", F.md5(F.array_join(fn(F.col("text")), "\n")).alias("out"))


_list_text_query("t6_char_trigrams", "regexp_extract_all(text, '(?s).')", "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || w[i + 1] || w[i + 2])", lambda c: T.char_ngrams(c, 3, 3))
_list_text_query("t6_word_bigrams", _LOWER, "list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])", lambda c: T.word_ngrams(T.words(F.lower(c)), 2))
_text_query("t6_regex_tokens", "len(regexp_extract_all(lower(text), '[a-z]+'))::INTEGER", lambda c: F.size(T.tokenize(c, "regex", pattern="[a-z]+")))
_text_query("t6_delimiter_tokens", "len(list_filter(string_split(lower(text), '.'), lambda s: trim(s, ' ') <> ''))::INTEGER", lambda c: F.size(T.tokenize(c, "delimiter", delimiter=".")))
_text_query("t7_word_tokens", "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::INTEGER", lambda c: F.size(T.TOKENIZERS["word"](c)))
_text_query("t8_filter_tokens", f"md5(array_to_string(list_filter({_LOWER}, lambda w: length(w) BETWEEN 3 AND 8 AND w NOT IN ('the', 'and', 'for') AND regexp_matches(w, '^[a-z]+$')), ' '))", lambda c: F.md5(F.array_join(T.filter_tokens(T.words(F.lower(c)), min_chars=3, max_chars=8, stopwords=("the", "and", "for"), keep="^[a-z]+$"), " ")))
_text_query("t24_content_hash", "sha256(text)", lambda c: F.sha2(c, 256))


@query("t8_filter_by_frequency", f"WITH w AS (SELECT doc_id, unnest({_LOWER}) AS w, generate_subscripts({_LOWER}, 1) AS p FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w HAVING n BETWEEN 50 AND 5000), k AS (SELECT doc_id, count(*) AS n FROM w JOIN c USING (w) GROUP BY doc_id) SELECT doc_id, coalesce(k.n, 0)::INTEGER AS kept FROM documents LEFT JOIN k USING (doc_id)")
def t8_frequency(spark: SparkSession, sf: str) -> DataFrame:
    df = _docs(spark, sf).select("doc_id", T.words(F.lower("text")).alias("tokens"))
    return T.filter_by_frequency(df, "tokens", "doc_id", 50, 5000).select("doc_id", F.size("tokens").alias("kept"))


_COUNTS = f"w AS (SELECT doc_id, unnest({_LOWER}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY doc_id, term), t AS (SELECT count(*)::DOUBLE AS total FROM documents), d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term)"


def _tfidf_query(name: str, weight: str, norm: str | None, keep: str = "true", **kw) -> None:
    length = {"l2": "sqrt(sum(w * w) OVER (PARTITION BY doc_id))", "l1": "sum(abs(w)) OVER (PARTITION BY doc_id)", None: "1"}[norm]

    @query(name, f"WITH {_COUNTS}, x AS (SELECT doc_id, term, {weight} AS w FROM c JOIN d USING (term), t WHERE {keep}), y AS (SELECT doc_id, term, w, {length} AS len FROM x) SELECT doc_id, term, round(CASE WHEN len = 0 THEN w ELSE w / len END, 6) + 0.0 AS weight FROM y")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return T.tfidf(_docs(spark, sf), "doc_id", T.words(F.lower("text")), norm=norm, **kw).withColumn("weight", F.round("weight", 6))


_tfidf_query("t9_tfidf", "n * (ln((total + 1) / (df + 1)) + 1)", "l2")
_tfidf_query("t9_tfidf_sublinear_pruned", "(1 + ln(n)) * (ln((total + 1) / (df + 1)) + 1)", "l2", "df >= 3 AND df <= floor(total * 0.5)", tf="sublinear", min_df=3, max_df=0.5)
_tfidf_query("t9_bag_of_words", "n::DOUBLE", None, idf=None)
_tfidf_query("t10_tfidf_variant", "n * (ln(total / (df + 1)) + 1)", "l2", idf="plain_plus_one")
_tfidf_query("t11_tfidf_share", "n / (SELECT sum(n) FROM c c2 WHERE c2.doc_id = c.doc_id) * ln((total + 1) / (df + 1))", "l2", tf="share", idf="smooth")
_tfidf_query("t11_tfidf_binary_l1", "ln(total / greatest(df, 1))", "l1", tf="binary", idf="plain")


@query("t12_word_frequency", f"WITH w AS (SELECT unnest({_LOWER}) AS term FROM documents) SELECT term, count(*) AS n, round(count(*) / (SELECT count(*) FROM w)::DOUBLE, 8) AS share FROM w GROUP BY term")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return T.word_frequency(_docs(spark, sf), T.words(F.lower("text"))).withColumn("share", F.round("share", 8))


def _struct_query(name: str, fields: dict[str, str], fn, digits: int | None = None, prefix: str = "") -> None:
    listed = ", ".join(f"{f'round({s}, {digits}) + 0.0' if digits else s} AS {k}" for k, s in fields.items())

    @query(name, f"{prefix}SELECT doc_id, {listed} FROM {'documents' if not prefix else 'p'}")
    def run(spark: SparkSession, sf: str, fn=fn) -> DataFrame:
        df = _docs(spark, sf).select("doc_id", fn(F.col("text")).alias("s")).select("doc_id", "s.*").select("doc_id", *fields)
        return df if digits is None else df.select("doc_id", *(F.round(F.col(c).cast("double"), digits).alias(c) for c in fields))


def _count(pattern: str) -> str:
    return "len(regexp_extract_all(text, '" + pattern.replace("'", "''") + "'))"


_PUNCT = r"[!-/:-@\[-`{-~]"
_struct_query(
    "t13_text_stats",
    {
        "chars": "length(text) / 1000.0::DOUBLE",
        "words": "len(w) / 100.0::DOUBLE",
        "sentences": "len(s) / 10.0::DOUBLE",
        "lines": r"len(string_split(regexp_replace(text, '\n$', ''), chr(10))) / 10.0::DOUBLE",
        "word_length": "list_avg(list_transform(w, lambda x: length(x)))",
        "unique_ratio": "len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)::DOUBLE",
        "sentence_words": rf"list_avg(list_transform(s, lambda x: len(regexp_extract_all(x, '{_SOLID}')))) / 20",
        "stopword_ratio": "len(list_filter(w, lambda x: lower(x) IN (" + ", ".join(f"'{x}'" for x in W.STOPWORDS) + "))) / len(w)::DOUBLE",
        "punctuation_ratio": _count(_PUNCT) + " / length(text)::DOUBLE",
        "upper_ratio": _count(r"\p{Lu}") + " / length(text)::DOUBLE",
        "digit_ratio": _count("[0-9]") + " / length(text)::DOUBLE",
        "word_length_std": "list_stddev_pop(list_transform(w, lambda x: length(x)))",
    },
    T.text_stats,
    6,
    rf"WITH p AS (SELECT doc_id, text, {_WORDS} AS w, list_filter(regexp_split_to_array(text, '[.?!]'), lambda x: regexp_matches(x, '{_SOLID}')) AS s FROM documents) ",
)
_struct_query(
    "t14_basic_features",
    {
        "bytes": "strlen(text)::INTEGER",
        "words": f"len({_WORDS})::INTEGER",
        "chars": "length(text)::INTEGER",
        "unique_chars": "len(list_distinct(regexp_extract_all(text, '(?s).')))::INTEGER",
        "digits": _count(r"\p{Nd}") + "::INTEGER",
        "upper": _count(r"\p{Lu}") + "::INTEGER",
        "lower": _count(r"\p{Ll}") + "::INTEGER",
        "punctuation": _count(_PUNCT) + "::INTEGER",
    },
    T.basic_features,
)
_struct_query("t17_entity_counts", {k: _count(W.ENTITIES[k]) + "::INTEGER" for k in ("email", "date", "number", "percentage", "currency", "time", "url")}, T.entity_counts)


@query("t15_char_ngram_counts", "WITH l AS (SELECT regexp_extract_all(text, '(?s).') AS c FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(c), 1)), lambda i: c[i] || c[i + 1])) AS gram FROM l) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.explode(T.char_ngrams(F.col("text"), 2, 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_QUOTED = ", ".join("'" + n.replace("'", "''") + "'" for n in W.NEGATIONS)
_TIMES = "CASE p[2] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.INTENSIFIERS.items()) + " ELSE 1.0 END"
_VALUE = "CASE p[1] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.SENTIMENT.items()) + f" END * {_TIMES} * CASE WHEN p[2] IN ({_QUOTED}) THEN -1 ELSE 1 END"


@query(
    "t16_sentiment",
    f"""WITH w AS (SELECT doc_id, list_transform({_LOWER}, lambda x: regexp_replace(x, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')) AS w FROM documents),
    h AS (SELECT doc_id, list_filter(list_transform(list_zip(w, list_prepend('', w)[1:len(w)]), lambda p: {{'v': ({_VALUE})::DOUBLE, 't': ({_TIMES})::DOUBLE}}), lambda s: s.v IS NOT NULL) AS h FROM w),
    n AS (SELECT doc_id, h, len(h) AS n, len(list_filter(h, lambda s: s.v > 0)) AS pos, len(list_filter(h, lambda s: s.v < 0)) AS neg FROM h)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE pos / n END, 6) + 0.0 AS positive, round(CASE WHEN n = 0 THEN 0.0 ELSE neg / n END, 6) + 0.0 AS negative,
      round(CASE WHEN n = 0 THEN 0.0 ELSE (n - pos - neg) / n END, 6) + 0.0 AS neutral, round(CASE WHEN n = 0 THEN 0.0 ELSE (pos - neg) / n END, 6) + 0.0 AS compound,
      round(CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(h, lambda s: abs(s.v))) / n END, 6) + 0.0 AS subjectivity, round(CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(h, lambda s: s.t)) / n END, 6) + 0.0 AS intensity FROM n""",
)
def t16(spark: SparkSession, sf: str) -> DataFrame:
    df = _docs(spark, sf).select("doc_id", T.sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")
    return df.select("doc_id", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


@query("t17_entities_extracted", rf"SELECT doc_id, unnest(regexp_extract_all(text, '{W.ENTITIES['email']}')) AS email FROM documents")
def t17(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(T.entities(F.col("text"), "email")).alias("email"))


_MARKS = ", ".join(f"{{'score': len(list_filter(w, lambda x: regexp_matches(x, '{'|'.join(parts)}'))) / len(w)::DOUBLE, 'rank': -{k}, 'code': '{code}'}}" for k, (code, parts) in enumerate(W.LANGUAGE_PARTS.items()))


@query("t19_language_marks", f"WITH l AS (SELECT doc_id, text, {_LOWER} AS w FROM documents), b AS (SELECT doc_id, text, list_max([{_MARKS}]) AS best FROM l) SELECT doc_id, CASE WHEN length(text) = 0 THEN 'unknown' WHEN best.score > 0 THEN best.code WHEN {_count('[A-Za-z]')} / length(text)::DOUBLE > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM b")
def t19(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("t18_topic_model")
def t18(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's topic shares; no SQL, as they come from a fit."""
    return T.topics(_docs(spark, sf), "doc_id", T.words(F.lower("text")), k=4)


@query("t18_topic_shares", "SELECT count(*) AS texts, 4::BIGINT AS topics, true AS whole FROM documents")
def t18_shares(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    return t18(spark, sf).agg(F.count(F.lit(1)).alias("texts"), F.max(F.size("topics")).cast("bigint").alias("topics"), F.every(F.abs(total - 1) < 1e-6).alias("whole"))


@query("t22_vocabulary_ids", rf"WITH w AS (SELECT doc_id, {_LOWER} AS w FROM documents), c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM w) GROUP BY term), v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 AS id FROM c QUALIFY id <= 501), i AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM w) SELECT doc_id, count(v.id)::BIGINT AS known, sum(coalesce(v.id, 1))::BIGINT AS id_sum FROM i LEFT JOIN v USING (term) GROUP BY doc_id")
def t22(spark: SparkSession, sf: str) -> DataFrame:
    df = _docs(spark, sf).select("doc_id", T.words(F.lower("text")).alias("tokens"))
    vocabulary = T.vocabulary(df, "tokens", 500)
    ids = T.encode_ids(df, "doc_id", "tokens", vocabulary)
    return ids.select("doc_id", F.size(F.filter("ids", lambda x: x > 1)).cast("bigint").alias("known"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("t25_method_choice", r"SELECT CASE WHEN avg(length(text)) < 50 THEN 'bag_of_words' WHEN avg(length(text)) < 200 THEN 'char_ngrams' WHEN avg(length(text)) < 1000 THEN 'tfidf' ELSE 'tfidf_sublinear' END AS method, round(avg(length(text)), 4) AS avg_chars, count(*) AS n FROM documents")
def t25(spark: SparkSession, sf: str) -> DataFrame:
    return T.choose_method(_docs(spark, sf), "text").withColumn("avg_chars", F.round("avg_chars", 4))


@query("t26_incremental_vocabulary", f"SELECT term, count(*) AS n FROM (SELECT unnest({_LOWER}) AS term FROM documents) GROUP BY term")
def t26(spark: SparkSession, sf: str) -> DataFrame:
    df = _docs(spark, sf).select("doc_id", T.words(F.lower("text")).alias("tokens"))
    none = spark.createDataFrame([], "term string, n bigint")
    for part in (df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 = 1")):  # two batches that make up the whole
        none = streams.merge_vocabulary(none, part, "tokens")
    return none


@query("t20_unit_embeddings", "SELECT count(*) AS texts, 16::BIGINT AS dim, true AS unit FROM benchmark")
def t20_unit(spark: SparkSession, sf: str) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return t20(spark, sf).agg(F.count(F.lit(1)).alias("texts"), F.max(F.size("v")).cast("bigint").alias("dim"), F.every(F.abs(square - 1) < 1e-9).alias("unit"))


@query("t4_lemmas", f"SELECT doc_id, list_transform({_WORDS}, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.LEMMAS.items()) + " ELSE x END) AS lemmas FROM documents")
def t4_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.transform(T.words(F.col("text")), T.lemma).alias("lemmas"))


@query("k16_find_most_similar", "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE id = 3) SELECT id, round(1 / (1 + list_distance(v, qv)), 6) AS score FROM e, q ORDER BY 1 / (1 + list_distance(v, qv)) DESC, id LIMIT 15")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    """The query against all candidates, by the text vectors' Euclidean similarity, and the best of them."""
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    own = F.array(*(F.lit(float(x)) for x in df.filter("id = 3").select("v").first()[0]))
    return T.find_most_similar(df, own, "v", "id", 15, "euclidean").withColumn("score", F.round("score", 6))


@query("t20_hash_embeddings")
def t20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.hash_embedding(T.words(F.lower("text")), 16).alias("v"))


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings"), F.slice(v, 1, 32), F.slice(v, 33, 32)


_HALVES = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS a, CAST(embedding AS DOUBLE[])[33:64] AS b FROM embeddings)"


@query("t23_fusion_average", f"{_HALVES} SELECT vec_id, list_transform(list_zip(a, b), lambda p: round((p[1] * 0.7 + p[2] * 0.3) / 1.0, 6)) AS v FROM e")
def t23(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _pair(spark, sf)
    return df.select("vec_id", F.transform(T.fuse([a, b], "average", [0.7, 0.3]), kernels.rounded).alias("v"))


@query("t23_fusion_gated", f"{_HALVES}, g AS (SELECT *, 1 / (1 + exp(-list_avg(a))) AS ga, 1 / (1 + exp(-list_avg(b))) AS gb FROM e) SELECT vec_id, list_concat(CASE WHEN ga > 0.5 THEN list_transform(a, lambda x: round(x * ga, 6)) ELSE [] END, CASE WHEN gb > 0.5 THEN list_transform(b, lambda x: round(x * gb, 6)) ELSE [] END) AS v FROM g")
def t23_gated(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _pair(spark, sf)
    return df.select("vec_id", F.transform(T.fuse([a, b], "gated"), kernels.rounded).alias("v"))


@query("t23_fusion_attention", f"{_HALVES} SELECT vec_id, list_transform(list_concat(a, b), lambda x: round(x * 0.5, 6)) AS v FROM e")
def t23_attention(spark: SparkSession, sf: str) -> DataFrame:
    df, a, b = _pair(spark, sf)
    return df.select("vec_id", F.transform(T.fuse([a, b], "attention"), kernels.rounded).alias("v"))


@query("s26_text_similarity", rf"WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '{_SOLID}')) AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), d AS (SELECT doc_id, list_distinct({_LOWER}) AS w FROM documents) SELECT doc_id, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q)))::DOUBLE, 6) AS score FROM d, q ORDER BY len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q)))::DOUBLE DESC, doc_id LIMIT 10")
def s26(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "benchmark").orderBy("item_id").select("text").first()[0]  # the query, one row
    return T.most_similar(_docs(spark, sf), text, "text", "doc_id", 10).withColumn("score", F.round("score", 6))


@query("t9_top_terms", f"WITH {_COUNTS}, x AS (SELECT doc_id, term, n * (ln((total + 1) / (df + 1)) + 1) AS w FROM c JOIN d USING (term), t), y AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x) SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS rank FROM y QUALIFY rank <= 3")
def t9_top(spark: SparkSession, sf: str) -> DataFrame:
    weights = T.tfidf(_docs(spark, sf), "doc_id", T.words(F.lower("text"))).withColumn("weight", F.round("weight", 6))
    return T.top_terms(weights, "doc_id", 3)


@query("t2_strip_html", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def t2_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.CLEANERS["html"](F.col("html")).alias("text"))

import hashlib
import math
import random
from collections import defaultdict

from vantloom.llm import mixing


def _fill(children, budget):
    """{name: part} of water-filling: fill what is under the level, share out the rest, repeat."""
    parts, free = {}, dict(children)
    while free:
        weights = sum(w for w, _ in free.values())
        level = budget / weights if weights else math.inf
        full = {n: c for n, (w, c) in free.items() if w == 0 or c <= w * level}
        if not full:
            return parts | {n: w * level for n, (w, _) in free.items()}
        parts |= {n: float(c) for n, c in full.items()}
        budget -= sum(full.values())
        free = {n: x for n, x in free.items() if n not in full}
    return parts


def _domain(source):
    digits = ""
    while source and source[-1].isdigit():
        digits, source = source[-1] + digits, source[:-1]
    return ["web", "news", "books", "forum"][int(digits) % 4] if digits else "other"


def _brute(rows, mix):
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for i, text, lang, source in rows:
        source = source or "unknown"
        tree[_domain(source)][lang or "unknown"][source].append((i, len((text or "").split())))
    tokens = sum(n for d in tree.values() for x in d.values() for s in x.values() for _, n in s)
    weight = lambda w, k: w.get(k, mix.default)
    cap3 = lambda d, x, s: sum(n for _, n in tree[d][x][s]) * mix.max_epochs if weight(mix.domains, d) and weight(mix.languages, x) and weight(mix.sources, s) else 0
    cap2 = lambda d, x: sum(cap3(d, x, s) for s in tree[d][x])
    out = []
    for d, b1 in _fill({d: (weight(mix.domains, d), sum(cap2(d, x) for x in tree[d])) for d in tree}, tokens * mix.budget_percent // 100).items():
        for x, b2 in _fill({x: (weight(mix.languages, x), cap2(d, x)) for x in tree[d]}, b1).items():
            for s, target in _fill({s: (weight(mix.sources, s), cap3(d, x, s)) for s in tree[d][x]}, b2).items():
                docs = tree[d][x][s]
                held = sum(n for _, n in docs)
                if not held:
                    continue
                epochs = int(target / held + 1e-9)
                rest = math.floor(target - epochs * held + 1e-6)
                out += [(i, e) for i, _ in docs for e in range(epochs)]
                key = lambda i: hashlib.md5(f"{mix.seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
                sofar, sums = 0, defaultdict(int)
                for i, n in docs:
                    sums[key(i)] += n
                chosen = set()
                for k in sorted(sums):
                    if sofar < rest:
                        chosen.add(k)
                    sofar += sums[k]
                out += [(i, epochs) for i, _ in docs if key(i) in chosen]
    return sorted((str(i), e) for i, e in out)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, "w " * rnd.randint(0, 40), rnd.choice(["en", "en", "en", "fr", "de", None, "xx"]), rnd.choice(["src0", "src0", "src1", "src2", "src7", "plain", None])) for k in range(400)]
    rows += [(5, "a b", "en", "src0"), (5, "a b", "en", "src0"), (None, "c d e", "fr", "src1"), (900, None, "es", "src3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 AS tokens", "'z' AS cut", "2 AS epochs", "3 AS target", "4 AS w", "5 AS cap")
    for mix in (mixing.PRODUCTION, mixing.Mix(budget_percent=30), mixing.Mix(budget_percent=170, sources={"src0": 1, "src1": 0}, domains={"web": 1, "news": 0}, default=3)):
        found = mixing.mix_documents(docs, mix)
        assert sorted((str(r.doc_id), r._epoch) for r in found.collect()) == _brute(rows, mix)
        assert found.drop("_epoch", *mixing.LEAF).columns == docs.columns


def test_long_numbers_and_clashing_names(spark):
    sources = ["s" + "7" * 60, "s" + "9" * 400 + "6", "s5", "1234567890" * 9 + "12", "src0\n", "s07"]
    rows = [(k, "w x y", "en", s) for k, s in enumerate(sources * 3)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = plain.selectExpr("*", "doc_id AS _epoch", "'d' AS _DOMAIN", "'l' AS _lang", "'s' AS _source", "'w' AS _whole", "'c' AS _cut", "1 AS _own_cut")
    found = mixing.mix_documents(docs)
    assert found.columns == [*docs.columns, "__epoch", "__domain", "__lang", "__source"]
    got = found.collect()
    assert sorted((str(r.doc_id), r[11]) for r in got) == _brute(rows, mixing.PRODUCTION)
    assert all(r._epoch == r.doc_id and r[5:11] == ("d", "l", "s", "w", "c", 1) and r[12] == _domain(r.source) for r in got)
    assert all("_own" not in c for c in set(found.columns) - {"_own_cut"})


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # web/fr holds little: web/en takes what it leaves, though news has plenty of its own.
    rows = [(k, "w " * 10, "en", "src0") for k in range(200)] + [(500, "w " * 10, "fr", "src0")] + [(1000 + k, "w " * 10, "en", "src1") for k in range(200)]
    mix = mixing.Mix(domains={"web": 50, "news": 50}, languages={"en": 50, "fr": 50}, budget_percent=50, max_epochs=1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    planned = {(r._domain, r._lang): r.target for r in mixing.plan(mixing.with_leaf(docs).select(*mixing.LEAF, mixing.tokens_of(docs.text).alias("_tokens")), mix).collect()}
    assert planned == {("web", "fr"): 10.0, ("web", "en"): 992.5, ("news", "en"): 1002.5}


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000, "en", "src0")], "doc_id bigint, text string, lang string, source string")
    assert mixing.mix_documents(docs).count() == 1
    assert mixing.mix_documents(docs.limit(0)).count() == 0

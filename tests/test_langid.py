import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burstframe.operators import langid as li
from burstframe.plans import language_training as training

CORPUS = "doc string, domain string, lang string, text string"


def brute_grams(data: bytes, high: int) -> list[bytes]:
    if len(data) < max(1, high - 1):
        return []
    return [data[i : i + k] for i in range(len(data)) for k in range(1, high + 1) if i + k <= len(data)]


def test_byte_ngrams(spark):
    rng = random.Random(5)
    texts = ["ab", "abc", "", "é"] + ["".join(rng.choice("abé ж") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", li.byte_ngrams(F.col("text")).alias("g")).collect():
        assert sorted(map(bytes, r.g)) == sorted(brute_grams(texts[r.i].encode(), 4))
    assert df.select(li.byte_ngrams(F.lit("ab")).alias("g")).first().g == []


def test_word_ngrams(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,)], "text string")
    assert [r.g for r in df.select(li.word_ngrams(F.col("text"), 1, 3).alias("g")).collect()] == [["a", "a b", "a b c", "b", "b c", "b c d"], [], [], []]


def entropy(v):
    s = sum(v)
    return -sum(x / s * math.log(x / s) for x in v if x) if s else 0.0


def test_gains(spark):
    rng = random.Random(2)
    docs = [(str(i), rng.choice("xyz"), rng.choice(["en", "de", "fr"]), " ".join(rng.choice("abcdefg") for _ in range(4))) for i in range(60)]
    corpus = spark.createDataFrame(docs, CORPUS)
    sizes = {k: Counter(d[j] for d in docs) for k, j in (("domain", 1), ("lang", 2))}
    all_gain = {r.term: r.ig for r in li.gain_all(li.postings(corpus, "domain", li.words), li.class_sizes(corpus, "domain")).collect()}
    each = {(r.term, r["class"]): r.ig for r in li.gain_each(li.postings(corpus, "lang", li.words), li.class_sizes(corpus, "lang")).collect()}
    for term in "abcdefg":
        has = [d for d in docs if term in d[3].split()]
        pos = [sum(d[1] == c for d in has) for c in sizes["domain"]]
        neg = [n - p for n, p in zip(sizes["domain"].values(), pos, strict=True)]
        want = entropy(sizes["domain"].values()) - (sum(pos) * entropy(pos) + sum(neg) * entropy(neg)) / 60
        assert all_gain[term] == pytest.approx(want)
        for lang, n in sizes["lang"].items():
            a = sum(d[2] == lang for d in has)
            b = len(has) - a
            want = entropy([n, 60 - n]) - (len(has) * entropy([a, b]) + (60 - len(has)) * entropy([n - a, 60 - n - b])) / 60
            assert each[(term, lang)] == pytest.approx(want, abs=1e-12)
    assert min(each.values()) > -1e-12


def test_bayes(spark):
    counts = spark.createDataFrame([("f", "en", 3)], "term string, class string, n bigint")
    features = spark.createDataFrame([("f",), ("g",)], "term string")
    langs = spark.createDataFrame([("en",)], "lang string")
    got = {r.term: r.logp for r in li.bayes_likelihood(counts, features, langs).collect()}
    assert got == {"f": pytest.approx(math.log(4 / 5)), "g": pytest.approx(math.log(1 / 5))}


def test_training(spark):
    docs = [(f"{i}", d, lang, t) for i, (d, lang, t) in enumerate([(d, lang, t) for d in "ab" for lang, t in (("en", "the cat and the dog"), ("de", "der hund und die katze"))])]
    corpus = li.index(spark.createDataFrame([*docs, ("9", "a", None, "x"), ("8", "a", "en", None)], CORPUS))
    features, prior, likelihood = li.train(corpus, per_lang=30)
    texts = spark.createDataFrame([("1", "the dog"), ("2", "und der hund"), ("3", ""), ("4", None)], "doc_key string, text string")
    got = {r.doc_key: r.lang for r in li.classify(texts, prior, likelihood).collect()}
    assert got["1"] == "en" and got["2"] == "de" and got["3"] in ("de", "en") and got["4"] == got["3"]
    assert [r.doc_key for r in li.in_language(texts, li.classify(texts, prior, likelihood), ["de"]).where("doc_key = '2'").collect()] == ["2"]
    sums = li.softmax_terms(likelihood).groupBy("lang").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    given = li.train(corpus, li.words, features=spark.createDataFrame([("the",)], "term string"))[2]
    assert given.select("term").distinct().count() == 1
    assert li.train(corpus, use_domains=False)[0].count() > 0


def test_index_filters(spark):
    docs = spark.createDataFrame([("1", "a", "en", "x"), ("2", "b", "en", "x"), ("3", "a", "de", "x")], CORPUS)
    assert {r.lang for r in li.index(docs, min_domain=2).collect()} == {"en"}
    assert li.index(docs, langs=["de"]).count() == 1 and li.index(docs, domains=["b"]).count() == 1 and li.index(docs.limit(0)).count() == 0


def test_english_tweets(spark):
    rows = [("1", "en", []), ("2", None, [("a", "en")] * 4 + [("b", "de")]), ("3", "de", [("a", "en"), ("b", "de")]), ("4", None, [])]
    df = spark.createDataFrame(rows, "id string, lang string, words array<struct<word: string, lang: string>>")
    assert {r.id for r in li.english_tweets(df).collect()} == {"1", "2"}


def test_queries_count_all_orders(spark, tmp_path):
    docs = [("1", "a", "en", "the cat"), ("2", "b", "en", "the dog"), ("3", "a", "de", "der hünd"), ("4", "b", "de", "abc")]
    spark.createDataFrame(docs, CORPUS).write.parquet(str(tmp_path / "corpus_item.parquet"))
    want = Counter((g.hex(), d[1]) for d in docs for g in set(brute_grams(d[3].encode(), 4)))
    assert {(r.term, r["class"]): r.n for r in training.ngram_df(spark, str(tmp_path)).collect()} == want
    assert (training.ORDERS, training.PER_ORDER, training.PER_LANG) == (4, 15000, 300)

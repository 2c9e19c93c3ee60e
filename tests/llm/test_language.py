import math

import duckdb
import numpy as np
import pytest

from burstframe.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus():
    rows = duckdb.sql(f"SELECT domain, lang, text FROM '{SF}/corpus_item.parquet'").fetchall()
    return rows


@pytest.fixture(scope="module")
def trees(corpus):
    texts = {}
    for domain, lang, text in corpus:
        if domain != "chat":
            texts.setdefault(lang, []).append(text)
    return L.ContextTrees(texts)


def brute_bits(texts, lang, word):
    """The definition for one language: the longest seen context codes the symbol or escapes."""
    seen = L.ContextTrees.words(texts[lang])
    total = 0.0
    for i in range(1, len(word)):
        for k in range(min(L.ORDER, i), -1, -1):
            context, symbols = word[i - k : i], {}
            for w, n in seen.items():
                for j in range(max(1, k), len(w)):
                    if w[j - k : j] == context:
                        symbols[w[j]] = symbols.get(w[j], 0) + n
            if not symbols:
                continue
            size, kinds = sum(symbols.values()), len(symbols)
            if word[i] in symbols:
                total += -math.log2(symbols[word[i]] / (size + kinds))
                break
            total += math.log2((size + kinds) / kinds)
        else:
            total += 8.0
    return total


def test_code_lengths_are_exact():
    texts = {"en": ["the cat sat the mat then"], "de": ["der hund und die katze"], "es": ["el gato"]}
    trees = L.ContextTrees(texts)
    for word in ("the", "katze", "zzz", "gato", "een"):
        w = L.coded(word)
        got = trees.bits[trees.rows_of(w)].sum(0)
        for lang in ("en", "de", "es"):
            assert got[trees.languages.index(lang)] == pytest.approx(brute_bits(texts, lang, w), rel=1e-5)


@pytest.mark.parametrize("left", ["bulletin", "chat", "forum", "news", "reviews", "wiki"])
def test_held_out_accuracy(corpus, left):
    """Every domain is read with trees of the others."""
    texts = {}
    for d, lang, text in corpus:
        if d != left:
            texts.setdefault(lang, []).append(text)
    held = [(lang, text) for d, lang, text in corpus if d == left]
    got = L.Reader(L.ContextTrees(texts)).segments([t for _, t in held])
    assert len(held) > 50 and np.mean([len(s) == 1 and s[0][0] == lang for s, (lang, _) in zip(got, held, strict=True)]) > 0.98


def test_foreign_words_and_no_corpus(trees):
    reader = L.Reader(trees)
    reader.tokens_of(["Qzxwvkjq Zhqwxyvq"])
    used = reader.bits[: len(reader.ids)]
    assert used.max() <= trees.bits[trees.rows_of(L.coded("qzxwvkjq"))].sum(0)[-1] + L.FOREIGN_BITS
    assert L.Reader(L.ContextTrees({})).segments(["a text", None]) == [[], []]


@pytest.mark.parametrize(
    ("text", "langs"),
    [
        ("The river lost the harbour lights. La rivière a visité une vieille photo hier soir.", ["en", "fr"]),
        ("The river lost the harbour lights (La Vieille Photo)", ["en"]),
        ("ＴＨＥ ｒiver lоst the harbοur lights", ["en"]),
        ("@a #b http://c.example/x :) hahaha lol", []), ("", []), (None, []), ("   ", []), ("12 34", []),
        ("The river lost the harbour lights zibi zibi zibi zibi zibi", ["en"]),
    ],
)
def test_segments(trees, text, langs):
    assert [s[0] for s in L.Reader(trees).segments([text])[0]] == langs


def test_batches_do_not_mix(trees):
    texts = ["The river lost the harbour lights", None, "La rivière a visité une vieille photo hier soir", "", "x" * 5000] * 3
    alone = [L.Reader(trees).segments([t])[0] for t in texts]
    assert L.Reader(trees).segments(texts) == alone
    assert L.Reader(trees).segments([]) == []


@pytest.mark.parametrize(("label", "code"), [("EN_gb", "en"), ("ger", "de"), ("Dutch", "nl"), ("in", "id"), ("und", None), (" ", None), (None, None), ("pt-BR", "pt")])
def test_labels(label, code):
    assert L.label_language(label) == code


def test_queries(spark, trees):
    rows = [("a", "1", "en", "The river lost the harbour lights"), ("a", "2", None, "The river lost the harbour lights"), ("a", "3", "fr", ""), ("a", "4", None, None), ("a", "2", None, "The river lost the harbour lights")]
    df = spark.createDataFrame(rows, "src string, rec_id string, label string, text string").selectExpr("*", "1 AS segments")
    assert [tuple(r) for r in L.wrong_labels(L.identify(df, trees)).collect()] == [("a", "2", "en")]
    assert L.wrong_labels(L.identify(df.limit(0), trees)).count() == 0
    assert L.wrong_labels(L.identify(df, L.ContextTrees({}))).count() == 0


def test_languages_come_from_the_corpus(spark):
    """A language that has no name here is known by the code of its labelled texts."""
    corpus = spark.createDataFrame([("xx", "zub mok zub lat frip nol zub mok"), ("en", "the cat and the dog sat on the mat"), (None, "x"), ("en", None)], "lang string, text string")
    trees = L.train(corpus)
    assert trees.languages == ("en", "xx")
    df = spark.createDataFrame([("a", "1", "XX ", "zub mok lat nol frip"), ("a", "2", "en", "zub mok lat nol frip")], "src string, rec_id string, label string, text string")
    assert [tuple(r) for r in L.wrong_labels(L.identify(df, trees)).collect()] == [("a", "2", "xx")]


def test_very_long_pieces(trees):
    """Pieces without a space take as many steps as characters."""
    texts = ["x" * 300_000, "x." * 100_000, "ha" * 100_000 + "x", "a-" * 100_000, "9" * 200_000, "x" * 200_000 + "@", "The river lost the harbour lights " + "ab" * 100_000]
    got = L.Reader(trees).segments(texts)
    assert [s[0] for s in got[-1]] == ["en"] and not got[4]
    assert L._readable("a@b.example") == L._readable("x[at]b[dot]c") == "" and L._readable("@who").strip() == ""
    assert L._readable("so@b") != "" and L._readable("a.b.c").strip() == "" and L._readable("don't") == "don't"

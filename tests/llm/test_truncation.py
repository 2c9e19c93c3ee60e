import random
from collections import Counter

import pytest

from burstframe.llm import truncation as t


@pytest.mark.parametrize(
    ("text", "kind", "last"),
    [
        ("", None, None), (" \n", None, None), ("It ended.", "ended", ""), ("It ended… ", "word", "ended"), ("The mornin [", "mark", ""), ("the stor\\u00e", "mark", ""), ("a f�", "mark", ""),
        ("rock &am", "mark", ""), ("the flo-", "mark", ""), ("see http://t.ex", "mark", ""), ("see http://t.example/abcdef", "ended", ""), ("It was the mo… http://t.example/abcde", "word", "mo"),
        ("Done. #tag", "tag", "#tag"), ("Done. :)", "ended", ""), ("Done 1/2", "ended", ""), ("Fine xD", "word", "xd"), ("a" * 5000, "word", "a" * 5000), ("full!!!!", "ended", ""),
    ],
)
def test_tails(text, kind, last):
    got = t.tail_of(text)
    assert (None, None) == (kind, last) if got is None else (got[0], got[2]) == (kind, last)


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, x, source, None, "c") for i, x in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint, cut string")


def test_found(spark):
    whole = ["The storm passed over the harbour lights. The harbour lights went out after the storm."] * 12
    texts = [*whole, "The storm passed over the harb", "The storm passed over the", "The harbour lights went out after the storm", "", None, "   ", "The storm passed over the harbour li…", "One storm passed #harbour"]
    df = documents(spark, texts)
    assert sorted(r.doc_id for r in t.cut_documents(df).collect()) == [12, 13, 18]
    report = t.cut_sources(df).collect()
    assert [(r.source, r.n_documents, r.n_cut) for r in report] == [("s", 17, 3)]
    assert t.cut_documents(df.limit(0)).count() == 0


def test_limits(spark):
    """Texts of one length that mostly stop inside a sentence show a limit; one that seems whole there was cut too."""
    whole = ["The storm passed over the harbour lights. The harbour lights went out after the storm."] * 12
    cut = ["One storm passed over the harbour lig", "The storm passed over the harbour lig", "Two storm passed over the harbour lig", "Our storm passed over the harbour lig"]
    even = "The lights went out after the storm"
    limit = len(cut[0])
    seems = "The lights, they went after the storm"
    assert len(seems) == limit
    found = {r.doc_id for r in t.cut_documents(documents(spark, [*whole, *cut, seems, even])).collect()}
    assert found == {12, 13, 14, 15, 16}


def test_trie(spark):
    words = spark.createDataFrame([("harbour", 3), ("harp", 2)], "last string, known bigint")
    nodes = {r.node: r.below for r in t.vocabulary_trie(words).collect()}
    node = lambda w: t.prefix_hashes(w)[-1]
    assert nodes[node("har")] == 5 and nodes[node("harb")] == 3 and node("harp") not in nodes and node("harbour") not in nodes
    long = "a" * 100_000
    assert len(set(t.prefix_hashes(long))) == len(long)  # as many steps as characters


def brute(texts):
    """Counts of words and of runs, one token at a time."""
    words, runs = Counter(), Counter()
    for text in texts:
        tokens = t._TOKEN.findall(text.rstrip())
        before, last, first = "<s>", "<s>", True
        for i, token in enumerate(tokens[:-1]):
            kind, after = t._kind(token), t._kind(tokens[i + 1])
            if kind in (t.WORD, t.TAG):
                words[token.lower()] += 1
            if kind == t.WORD:
                before, last = last, t._class(token, first)
                if after in (t.WORD, t.FULL_STOP):
                    runs[t._key(1, last), after == t.FULL_STOP] += 1
                    runs[t._key(2, before, last), after == t.FULL_STOP] += 1
            elif kind in (t.FULL_STOP, t.DOTS):
                last = "<s>"
            first = kind != t.WORD
    return words, runs


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    pieces = ["the", "The", "Mara", "12", "it's", ",", ".", "...", "…", "\n", "!", "#tag", "@who", "http://x.y/z", "été", "\0", "x" * 3000, "  "]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " "]
    rows = t.read_texts(documents(spark, [*texts, None])).collect()
    words, runs = brute([x.replace("\0", " ") for x in texts])
    got, made = Counter(), Counter()
    for r in rows:
        if r.row == "token":
            got[r["last"]] += r.ended
        if r.row == "run":
            made[r.k1, True] += r.ended
            made[r.k1, False] += r.went_on
    assert got == words and +made == runs
    assert sum(r.row == "tail" for r in rows) == sum(bool(x.strip(" \n")) for x in texts)


def test_whole_texts_are_read():
    """A sentence is followed back as far as it goes."""
    far = "Mara " + "— " * 50 + "left"
    assert t.tail_of("It ended. " + far)[3:] == ("mara", "left")
    assert t.tail_of("so Mara " + "— " * 50 + "Left")[3:] == ("<n>", "left")
    assert t.tail_of("x" * 30_000 + " " + "y" * 30_000)[2] == "y" * 30_000
    assert t.tail_of("whole\u200b \u200b")[2] == "whole"


def test_share_of_a_growing_corpus(spark):
    """One stray sentence end among very many does not switch a run off."""
    whole = ["The storm passed over the harbour lights."] * 300 + ["We saw the."]
    found = {r.doc_id for r in t.cut_documents(documents(spark, [*whole, "The storm passed over the"])).collect()}
    assert found == {301}


def test_very_long_pieces():
    for text in ("x" * 300_000, "." * 200_000 + "x", "a-" * 100_000, "http://" + "a." * 100_000, "#" + "a" * 200_000, "x " * 100_000, "\u200b" * 100_000):
        t.tail_of(text)

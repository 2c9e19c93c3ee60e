import itertools
import random

import pytest

from burstframe.llm import confusables as c

VALUES = "field string, id string, value string"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("ＡＢｃ１", "ABc1"), ("oﬃce", "office"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("Νоrа", "Nora"),
        ("пoезд", "поезд"), ("сор", "cop"), ("plain I1l0O", "plain I1l0O"), ("Vaesseбy", "Vaesseбy"), ("", ""), (None, None), ("​", ""), ("É", "É"), ("E", "E"),
        ("𝐇𝐞𝐥𝐥𝐨", "Hello"), ("Ꭺlice", "Alice"), ("ᴀʙᴄ", "ABC"), ("ⓐbc", "abc"), ("ꓮⲤ x", "AC x"), ("👨\u200d👩\u200d👧", "👨\u200d👩\u200d👧"), ("🏳\ufe0f\u200d🌈 a\u200db", "🏳\u200d🌈 ab"),
        ("раура", "paypa"), ("привет раура", "привет раура"), ("привет paypa", "привет раура"), ("МАРИЯ и МАРТА", "МАРИЯ и МАРТА"), ("МАРИЯ a MAPTA", "МАРИЯ а МАРТА"),
        ("ΜΑΡΙΑ", "MAPIA"), ("λόγος ΜΑΡΙΑ", "λόγος ΜΑΡΙΑ"), ("λόγος MAPIA", "λόγος ΜΑΡΙΑ"), ("привет hello", "привет hello"), ("он @cop http://x.y/cop пишет cop", "он @cop http://x.y/cop пишет сор"),
        ("the cоp ест сор", "the cop ест сор"),
    ],
)
def test_forms(given, expected):
    assert c.consistent(given) == expected


def test_form_is_stable():
    rng = random.Random(3)
    letters = "  aеоpсйжñéлh ﬁＡ́‍οΝ1"
    for _ in range(500):
        once = c.consistent("".join(rng.choice(letters) for _ in range(8)))
        assert c.consistent(once) == once


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = ["Nora Fox", "Иван", "cafe", "café", "a b", "a  b", "Fox", ""]
    rows = []
    for i in range(120):
        v = rng.choice(base)
        if rng.random() < 0.4:
            v = "".join({"o": "ο", "a": "а", "é": "é", " ": " "}.get(x, x) if rng.random() < 0.5 else x for x in v)
        rows.append((rng.choice(["text", "name"]), f"{i:03}", v))
    rows += rows[:5] + [("name", "900", None), ("name", None, "Fox")]
    got = [tuple(r) for r in c.lookalike_pairs(spark.createDataFrame(rows, VALUES)).collect()]
    want = set()
    for (f, i, v), (g, j, w) in itertools.combinations({r for r in rows if r[1] and r[2] is not None}, 2):
        if f == g and i != j and v != w and c.consistent(v) == c.consistent(w):
            want.add((f, min(i, j), max(i, j)))
    assert len(got) == len(set(got)) and set(got) == want
    assert c.lookalike_pairs(spark.createDataFrame([], VALUES)).count() == 0


def test_column_with_extras(spark):
    df = spark.createDataFrame([("1", "ｘ", "keep"), ("2", None, "keep"), ("3", "y", "keep")], "id string, value string, form_key string")
    assert [(r.form, r.form_key) for r in c.consistent_form(df, "value", "form").orderBy("id").collect()] == [("x", "keep"), (None, "keep"), ("y", "keep")]


def test_twins_share_their_form():
    """Any letters swapped for their look-alikes, anywhere: the form stays the same."""
    rng = random.Random(5)
    rows = {x: (latin, *others) for latin, others in c.LOOKALIKES.items() for x in (latin, *others)}
    words = ["сор", "привет", "paypa", "hello", "Vaesse", "ёж", "λόγος", "MAPIA", "@cop", "a", "Иван", "ꓮ", "été"]
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        twin = "".join(rng.choice(rows[x]) if x in rows and rng.random() < 0.5 else x for x in text)
        assert c.consistent(text + " é") == c.consistent(twin + " é")
        if not text.isascii() or text == twin:
            assert c.consistent(text) == c.consistent(twin)


def test_classes(spark):
    rows = [("text", "1", "Fox"), ("text", "2", "Fοx"), ("text", "3", "Fox"), ("name", "4", "Fox"), ("text", "5", "x"), ("text", "6", None), ("text", "1", "Fox")]
    df = spark.createDataFrame(rows, VALUES)
    assert [tuple(r) for r in c.lookalike_classes(df).collect()] == [("text", "Fox", 2, 3)]
    assert c.lookalike_classes(df.limit(0)).count() == 0


def test_very_long_pieces():
    for text in ("x" * 300_000 + " й", "й" * 200_000, "@" * 100_000 + " й", "й@" * 50_000):
        assert len(c.consistent(text)) == len(text)

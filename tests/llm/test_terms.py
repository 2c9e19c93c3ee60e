import math
import random
import re
import string
from collections import Counter

import pytest

from burstframe.llm import terms

SCHEMA = "id_str string, text string, entities struct<hashtags: array<struct<text: string>>>, term string, id string"


def records(spark, rows):
    data = [(i, t, None if tags is None else ([(x,) if x is not False else None for x in tags],), "clash", "clash") for i, t, tags in rows]
    return terms.tweet_records(spark.createDataFrame(data, SCHEMA))


def pieces(text):
    return [p for p in (x.strip(string.punctuation) for x in re.split("[ \t\n\r]", text.lower())) if p]


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "B", "b!", "...", "c-d", "é", "'x'", "\n", "\t", "#", "long" * 50]
    rows = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), [rng.choice(["T", "u", "", None, " ", False]) for _ in range(rng.randint(0, 3))]) for i in range(60)]
    rows += [rows[0], (None, "lost", ["lost"]), ("n", None, None), ("e", "", [])]
    got = {(r.field, r.term): (r.n_occurrences, r.n_records) for r in terms.term_counts(terms.term_fields(records(spark, rows))).collect()}
    want = {}
    for field, read in (("text", lambda r: None if r[1] is None else pieces(r[1])), ("hashtags", lambda r: [t.lower() for t in r[2] or [] if t])):
        occurrences, held = Counter(), Counter()
        for own in (read(r) for r in {r[0]: r for r in rows if r[0]}.values()):
            occurrences.update(own or [])
            held.update(set(own or []))
        want |= {(field, t): (n, held[t]) for t, n in occurrences.items()}
    assert got == want


def test_marks(spark):
    rows = [(str(i), "all " + ("few" if i < 3 else "one" if i == 3 else ""), ["T"] if i < 2 else None) for i in range(40)]
    marks = {(r.field, r.term): r.mark for r in terms.marked_terms(records(spark, rows)).collect() if r.term != "t"}
    assert marks == {("text", "all"): "common", ("text", "few"): None, ("text", "one"): "rare"}
    tags = sorted(r.mark for r in terms.marked_terms(records(spark, rows)).where("term = 't'").collect())
    assert tags == ["common", "rare"]  # in both of the two records of its field
    assert terms.marked_terms(records(spark, rows).limit(0)).count() == 0


def test_scores(spark):
    rows = [(str(i), "the cat sat on the mat " + ("word" if i % 2 else "other"), None) for i in range(30)] + [("x", "the cat zig zig zig zag", None), ("y", "the zag", None), ("z", None, None), ("w", "", None)]
    fields = terms.term_fields(records(spark, rows))
    asked = spark.createDataFrame([("x",), ("x",), ("z",), ("missing",)], "id string")
    best = {r.id: r.term for r in terms.most_distinctive(terms.term_scores(fields, asked)).collect()}
    assert best == {"x": "zig"}
    every = terms.term_scores(fields).collect()
    held = Counter(t for r in rows if r[1] for t in pieces(r[1]))
    spread = Counter(t for r in rows if r[1] for t in set(pieces(r[1])))
    total = sum(held.values())
    for r in every:
        own = pieces(dict((a, b) for a, b, _ in rows)[r.id])
        y1, n1, y2, n2 = own.count(r.term), len(own), held[r.term] - own.count(r.term), total - len(own)
        a, a0 = terms.PRIOR_WEIGHT * held[r.term], terms.PRIOR_WEIGHT * total
        delta = math.log((y1 + a) / (n1 + a0 - y1 - a)) - math.log((y2 + a) / (n2 + a0 - y2 - a))
        assert r.z == pytest.approx(delta / math.sqrt(1 / (y1 + a) + 1 / (y2 + a)))
        assert (r.tf, r.n_occurrences, r.n_records) == (y1, held[r.term], spread[r.term])
    assert len(every) == sum(len(set(pieces(r[1]))) for r in rows if r[1])


def test_one_term_only(spark):
    fields = terms.term_fields(records(spark, [("1", "zig zig", None), ("2", "zig", None)]))
    assert {(r.id, r.tf, r.z) for r in terms.term_scores(fields).collect()} == {("1", 2, None), ("2", 1, None)}
    assert terms.most_distinctive(terms.term_scores(fields)).count() == 2
    assert terms.term_scores(fields.limit(0)).count() == 0

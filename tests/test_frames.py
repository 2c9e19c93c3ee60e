import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burstframe.operators import chunking, frames, tagging
from burstframe.plans import framing

TAGS = ["NN", "VBD", "IN", "RB", "MD", "VBG", "RP", "TO", "PRP$", "DT", "$", "JJ", ",", "NNP", "RBR"]
VERBS, GERUNDS = {"MD", "VB", "VBD", "VBP", "VBZ"}, {"VBG", "VBN"}
NOUNISH = {"CD", "DT", "JJ", "JJR", "JJS", "NN", "NNS", "NNP", "NNPS", "POS", "PRP", "RB", "RBR", "RBS", "VBG", "VBN"}


def after_verb(tags, i):
    """Where a verb that begins at i may end: an adverb, the verb, a particle, an adverb, all but the verb optional."""
    out = set()
    for j in {i, i + 1} if tags[i : i + 1] == ["RB"] else {i}:
        if j < len(tags) and tags[j] in VERBS | GERUNDS:
            ends = {j + 1}
            ends |= {e + 1 for e in ends if tags[e : e + 1] == ["RP"]}
            out |= ends | {e + 1 for e in ends if tags[e : e + 1] == ["RB"]}
    return out


def after_preposition(tags, i):
    out = set()
    for j in {i, i + 1} if tags[i : i + 1] == ["RB"] else {i}:
        if j < len(tags) and tags[j] in {"IN", "TO", "RP"}:
            out |= {j + 1} | ({j + 2} if tags[j + 1 : j + 2] == ["RB"] else set())
    return out


def closure(starts, step):
    """Everything that one step or more lead to."""
    seen, todo = set(), set(starts)
    while todo:
        todo = {e for s in todo for e in step(s)} - seen
        seen |= todo
    return seen


def after_relation(tags, i, long):
    """Where a relation that begins at i may end: verbs, each perhaps with words and prepositions behind it."""

    def unit(s):
        verbs = after_verb(tags, s)
        if not long:
            return verbs | {e for v in verbs for e in after_preposition(tags, v)}
        words = verbs | closure(verbs, lambda e: {e + 1} if e < len(tags) and tags[e] in NOUNISH else set())
        return verbs | closure(words, lambda e: after_preposition(tags, e))

    return closure({i}, unit)


def brute_spans(tags):
    """The longest span from each place where a scan for short or for long relations, without overlaps, stops."""
    ends = {}
    for long in (False, True):
        i = 0
        while i < len(tags):
            found = after_relation(tags, i, long)
            if found:
                ends[i] = max(ends.get(i, -1), max(found) - 1)
                i = max(found)
            else:
                i += 1
    return sorted(ends.items())


def brute_merge(spans):
    out = []
    for st, ed in spans:
        if out and st <= out[-1][1]:
            out[-1][1] = max(out[-1][1], ed)
        else:
            out.append([st, ed])
    return [tuple(x) for x in out]


def test_spans_against_brute_force(spark):
    rng = random.Random(7)
    cases = [[rng.choice(TAGS) for _ in range(rng.randint(1, 14))] for _ in range(150)] + [["VBD", "IN"] * 200, [], ["NN", "VBD", "IN", "NN"], ["VB", "PRP$", "NN", "IN"], ["VB", "DT", "NN", "IN"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, tags array<string>")
    rows = df.select("i", frames.verb_spans(F.col("tags")).alias("s")).withColumn("m", frames.merge_spans(F.col("s"))).collect()
    for r in rows:
        want = brute_spans(cases[r.i])
        assert [(x.st, x.ed) for x in r.s] == want
        assert [(x.st, x.ed) for x in r.m] == brute_merge(want)


def test_merge_keeps_touching_apart(spark):
    df = spark.createDataFrame([([(0, 2), (2, 4), (5, 6)],)], "s array<struct<st: int, ed: int>>")
    assert [(x.st, x.ed) for x in df.select(frames.merge_spans(F.col("s")).alias("m")).first().m] == [(0, 4), (5, 6)]


@pytest.mark.parametrize(
    ("a", "b", "name"),
    [((5, 6), (0, 3), "left"), ((5, 6), (0, 4), "left adjacent"), ((0, 1), (3, 4), "right"), ((0, 1), (2, 4), "right adjacent"), ((2, 3), (1, 4), "cover"),
     ((1, 5), (2, 3), "insider"), ((2, 5), (1, 3), "left intersaction"), ((1, 3), (2, 5), "right intersaction")],
)
def test_relations(spark, a, b, name):
    df = spark.createDataFrame([(a, b)], "a struct<st: int, ed: int>, b struct<st: int, ed: int>")
    assert df.select(frames.span_relation(F.col("a"), F.col("b")).alias("r")).first().r == name


def make(spark, line, phrases):
    tokens = [tuple(t.rsplit("/", 1)) for t in line.split()]
    return spark.createDataFrame([(1, tokens, phrases)], "id int, tokens array<struct<word: string, tag: string>>, phrases array<struct<st: int, ed: int>>")


@pytest.mark.parametrize(
    ("line", "phrases", "expected"),
    [
        ("a/NN b/NN eat/VBP c/NN d/NN", None, ["a_b|eat|c_d"]),
        ("a/NN b/NN eat/VBP c/NN d/NN", [], ["a_b|eat|c_d"]),
        ("a/NN b/NN eat/VBP c/NN d/NN", [(0, 1)], ["a_b|eat|c"]),
        ("who/WP saw/VBD @bob/NN", [(0, 0), (2, 2)], ["|saw|@usr"]),
        ("Oh/UH the/DT man/NN ,/, dog/NN ran/VBD home/NN", [(0, 4), (6, 6)], ["dog|ran|home"]),
        ("eat/VB", [], ["|eat|"]),
        ("foo/FW eat/VB", [], None),
        ("just/NN nouns/NN", [], None),
        ("x/NN goooooal/VBD y/NN", [(0, 0), (2, 2)], ["x|goooal|y"]),
    ],
)
def test_frames(spark, line, phrases, expected):
    row = frames.frames(make(spark, line, phrases)).first()
    assert (None if row is None else [f"{f.arg1}|{f.verb}|{f.arg2}" for f in row.frames]) == expected


def test_units_noise_and_verbs(spark):
    rows = frames.frames(make(spark, "the/DT cat/NN saw/VBD dogs/NN", [(1, 1), (3, 3)]))
    assert sorted(r.unit for r in frames.frame_units(rows, "id").collect()) == ["cat", "dogs", "saw"]
    assert [tuple(r) for r in frames.noise_words(rows).collect()] == [("the", 1)]
    assert [tuple(r) for r in frames.verb_lexicon(rows).collect()] == [("saw", 1)]


def test_rule_parts():
    rule = chunking.parse_rule("T_2T_1P0P1 I I DT NN B")
    assert rule.parts == (("T", (-2,), "I"), ("T", (-1,), "I"), ("P", (0,), "DT"), ("P", (1,), "NN")) and (rule.low, rule.high, rule.out) == (-2, 1, "B")
    assert chunking.parse_rule("W_3_2_1 a O").parts == (("W", (-3, -2, -1), "a"),)


def test_chunker_semantics():
    c = chunking.Chunker(rules=("T0T1 I I B",))
    assert c.tags(["a", "b", "c"], ["NN", "NN", "NN"]) == ["B", "B", "I"]  # old tags within a rule, the end is no I
    assert chunking.Chunker(rules=("P1 ZZZ O",)).tags(["a", "b"], ["NN", "NN"]) == ["I", "O"]
    assert chunking.Chunker(rules=("W_3_2_1P0 x NN O",)).tags(["x", "b", "c", "d"], ["NN"] * 4) == ["I", "I", "I", "O"]  # none where an offset leaves the sentence
    assert chunking.Chunker(rules=()).spans(["a", "'s", "b", "ran"], ["NN", "POS", "NN", "VBD"]) == [(0, 0), (1, 2)]
    assert chunking.Chunker().spans([], []) == []


def test_chunks_and_tags(spark):
    df = spark.createDataFrame([("The old bridge crossed my river.",), ("",), (None,)], "text string")
    rows = tagging.tagged_sentences(df.withColumn("id", F.lit(1)), "id").withColumn("p", chunking.np_chunks(F.col("tokens")))
    row = rows.select("*", chunking.bracketed(F.col("tokens"), F.col("p")).alias("line")).collect()
    assert len(row) == 1 and row[0].line == "[ The/DT old/JJ bridge/NN ] crossed/VBD [ my/PRP$ river/NN ] ./."
    words = spark.createDataFrame([(w,) for w in ["#x", "@a", "http://b", "12", "RT", "café", "running", "quickly", "Paris", "cats", "("]], "w string")
    assert [r.t for r in words.select(tagging.tag_of(F.col("w")).alias("t")).collect()] == ["HT", "USR", "URL", "CD", "RT", "FW", "VBG", "RB", "NNP", "NNS", "-LRB-"]
    tags = spark.createDataFrame([("NN",), ("RP",), ("#",), ("ODD",)], "t string")
    assert [r.c for r in tags.select(tagging.coarse_tag(F.col("t")).alias("c")).collect()] == ["N", "T", ",", "ODD"]


def test_rules_of_a_file_and_annotations(spark, tmp_path):
    (tmp_path / "rules").write_text("T0P0 I NN O\n\n  \r\nT0P0 O VB I\n")
    assert chunking.read_rules(spark, str(tmp_path / "rules")) == ("T0P0 I NN O", "T0P0 O VB I")
    df = spark.createDataFrame([([("a", "DT"), ("bcd", "NN"), ("ran", "VBD"), ("é", "NN")], [(0, 1), (3, 3)]), ([], [])], "tokens array<struct<word: string, tag: string>>, spans array<struct<st: int, ed: int>>")
    got = [[tuple(a) for a in r.a] for r in df.select(chunking.annotations(F.col("tokens"), F.col("spans")).alias("a")).collect()]
    assert got == [[(0, 5, "a bcd"), (10, 11, "é")], []]


def test_sentences_keep_their_digits(spark):
    df = spark.createDataFrame([("0 one. 1 two 10! 22",)], "text string")
    assert df.select(tagging.sentences(F.col("text")).alias("s")).first().s == ["0 one.", "1 two 10!", "22"]


def test_one_pass_is_as_two(spark):
    df = spark.createDataFrame([("The old bridge crossed my river. 7 dogs ran home in 10 days",), (None,), ("café eats",), ("x",)], "text string").withColumn("id", F.lit(1))
    rows = tagging.tagged_sentences(df, "id")
    two = frames.frames(rows.withColumn("phrases", chunking.np_chunks(F.col("tokens"))))
    assert sorted(map(str, frames.chunked_frames(rows).collect())) == sorted(map(str, two.collect()))
    assert frames.with_phrases(rows.drop("phrases"), two, ["id", "sentence"]).count() == rows.count()


ODD_TEXTS = [
    "The old bridge crossed my river.  It fell!? \n\n @bob ran up #home http://t.co/a.b RT x", "a. b c!\u000bd\te . ... f\n.", "", " ", "\t", "\n \n", None, "café Ωmega １２ ٣x 7up _x_ __ -- 😀x😀 éte",
    "don't won’t well-known 'tis (eat) ; : … \u0001 ing ring red bed fly ally its boss buses S As httpfoo HTTP://x @ # @é #é #_ That half", "ſhe Kept Rt rt RTs İs was 0x ²nd", "x\r\ny. \r z w\u0085v", "was " * 400 + "of",
]


def test_counted_sentences_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS + ODD_TEXTS[:1]], "text string")
    rows = tagging.tagged_sentences(df, "text").select(F.array_join(F.transform("tokens", lambda t: F.concat(t.word, F.lit("/"), t.tag)), " ").alias("key"))
    want = sorted(tuple(r) for r in rows.groupBy("key").count().collect())
    assert sorted(tuple(r) for r in tagging.sentence_counts(df, lambda word, tag: f"{word}/{tag}", " ").collect()) == want
    codes = tagging.tagged_sentences(df, "text").select(frames.tag_code(F.transform("tokens", lambda t: t.tag)).alias("code")).distinct()
    assert sorted(frames.sentence_codes(df).collect()) == sorted(codes.collect())


def spelled(code):
    return [{"V": "VBD", "G": "VBG", "P": "IN", "T": "RP", "R": "RB", "W": "NN", "X": "$"}[c] for c in code]


CODES = ["VVXV", "VWPVX", "", "X", "GWWPRGX" * 60, "VX" * 200]


def test_merged_spans_of_codes(spark):
    got = frames.merged_code_spans(spark.createDataFrame([(c,) for c in [*CODES, None]], "code string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((c, *s) for c in CODES for s in brute_merge(brute_spans(spelled(c))))


def once_a_code(query, spark, capsys):
    """As column expressions the matches of a code were made again for each place where a span begins."""
    query(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 2 and "regexp_extract_all" not in plan and "Generate" not in plan and "EvalPython" not in plan


def test_merged_spans_are_found_once_a_code(spark, capsys):
    once_a_code(framing.merged_spans, spark, capsys)


def test_relation_counts_are_those_of_the_columns(spark):
    rng = random.Random(3)
    for _ in range(200):
        cuts = sorted(rng.sample(range(16), 8))
        phrases = [(a, b - rng.randint(0, 1) * (b > a)) for a, b in zip(cuts[::2], [x - 1 for x in cuts[2::2]] + [17], strict=True)]
        phrases = [p for p in phrases if p[0] <= p[1]]
        verbs = [(a, a + rng.randint(0, 9)) for a in sorted(rng.sample(range(14), 3))]
        counts = Counter()
        frames.count_relations(verbs, phrases, counts, 2)
        assert counts == Counter(x for v in verbs for p in phrases for x in [frames._relation(v, p)] * 2)
    spans = [(a, b) for a in range(5) for b in range(a, 5)]
    rows = spark.createDataFrame([(a, b, frames._relation(a, b)) for a in spans for b in spans], "a struct<st: int, ed: int>, b struct<st: int, ed: int>, r string")
    assert rows.where(frames.span_relation(F.col("a"), F.col("b")) != F.col("r")).count() == 0

    texts = [*ODD_TEXTS, "He said that broke the half. 7 half and dogs.", "Bob kept the old bridge of my river, that went up 10 half."] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = tagging.tagged_sentences(df).withColumn("p", chunking.np_chunks(F.col("tokens"))).withColumn("v", frames.verb_spans(F.transform("tokens", lambda t: t.tag)))
    pairs = rows.select(F.explode("v").alias("v"), "p").select("v", F.explode("p").alias("p"))
    want = pairs.groupBy(frames.span_relation(F.col("v"), F.col("p")).alias("relation")).count()
    assert sorted(tuple(r) for r in frames.relation_counts(df).collect()) == sorted(tuple(r) for r in want.collect())


def test_rules_are_tried_where_they_can_hold():
    """Against every rule at every place."""
    rng, rules = random.Random(5), (*chunking.RULES, "W_3_2_1P0 that NN O", "P1 ZZZ B", "T0T1 I I B", "P_1W0 NN that I", "P2P0 NN DT O", "W3 half I")
    chunker = chunking.Chunker(rules)
    for _ in range(500):
        words, pos = zip(*[(rng.choice(["that", "half", "x"]), rng.choice(TAGS)) for _ in range(rng.randint(1, 12))], strict=True)
        columns = {"W": [*words, "ZZZ"], "P": [*pos, "ZZZ"], "T": [*(chunking.POS_TAGS.get(p, "I") for p in pos), "Z"]}
        for rule in map(chunking.parse_rule, rules):
            columns["T"] = [rule.out if rule.holds(i, columns) else t for i, t in enumerate(columns["T"])]
        assert chunker.tags(list(words), list(pos)) == columns["T"][:-1]


def test_span_relations_are_found_once_for_equal_sentences(spark, capsys):
    once_a_code(framing.span_relations, spark, capsys)


def test_verb_spans_are_found_once_a_code(spark, capsys):
    got = frames.code_spans(spark.createDataFrame([(c,) for c in [*CODES, None]], "code string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((c, *s) for c in CODES for s in brute_spans(spelled(c)))
    once_a_code(framing.verb_spans, spark, capsys)

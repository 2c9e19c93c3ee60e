import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burstframe.operators import burst, events, slices, stats


def test_ps_is_the_mean_over_days_with_the_unit(spark):
    rows = [("1", f"a{i}", "x") for i in range(2)] + [("3", f"c{i}", "x") for i in range(4)] + [("3", "c0", "x")]
    units = spark.createDataFrame(rows + [(None, "z", "x"), ("1", None, "x"), ("1", "z", None)], "day string, tweet_id string, unit string")
    sizes = spark.createDataFrame([("1", 10), ("2", 10), ("3", 10)], "day string, n_tweets bigint")
    assert [tuple(r) for r in burst.unit_ps(units, sizes).collect()] == [("x", pytest.approx(0.3))]
    assert burst.unit_ps(units.limit(0), sizes).count() == 0


def test_burst_score(spark):
    df = spark.createDataFrame([(20, 100, 0.1, 10), (10, 100, 0.1, 10), (14, 100, 0.1, 1)], "f bigint, n bigint, ps double, u bigint")
    got = [r.s for r in df.select(burst.burst_score(F.col("f"), F.col("n"), F.col("ps"), F.col("u")).alias("s")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None and got[2] == pytest.approx(0.0)


def test_top_is_root_of_the_day(spark):
    rows = [("1", f"u{i}", 5, 2, float(i), 9) for i in range(10)]
    top = burst.top_bursts(spark.createDataFrame(rows, "day string, unit string, f_st bigint, u_st bigint, wb double, n_tweets bigint")).collect()
    assert sorted((r.seg_id, r.unit) for r in top) == [(0, "u9"), (1, "u8"), (2, "u7"), (3, "u6")]


def brute_slices(hours, step=2):
    start, out = 0, []
    for h in hours:
        if h >= start + step:
            start = h
        out.append(start if h >= start else None)
    return out


def test_slices_against_the_sequence(spark):
    rng = random.Random(3)
    days = {f"d{i}": [min(23, max(0, j // 3 + rng.randint(-4, 4))) for j in range(rng.randint(1, 60))] for i in range(40)} | {"x": [0, 1, 2, 5, 6, 7, 3]}
    rows = [(d, i, h) for d, hs in days.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows + [("x", 99, None)], "day string, line_idx int, hour int")
    got = {(r.day, r.line_idx): r.slice for r in slices.anchored_slices(df).collect()}
    want = {(d, i): s for d, hs in days.items() for i, s in enumerate(brute_slices(hs)) if s is not None}
    assert got == want
    assert [want[("x", i)] for i in range(6)] == [0, 0, 2, 5, 5, 7] and ("x", 6) not in got


def test_block_products_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(d, s, u, w, rng.random()) for d in ("1", "2") for s in (0, 2) for u in range(11) for w in "abcdef" if rng.random() < 0.4 and not (d == "2" and u > 4)]
    df = spark.createDataFrame(rows, "day string, slice int, seg_id int, word string, u double")
    got = {(r.day, r.slice, r.src, r.dst): r.cos for r in slices.pair_cosines(df, block=3).collect()}
    want = {}
    for d, s, a, w, x in rows:
        for e, t, b, v, y in rows:
            if (d, s, w) == (e, t, v) and a < b:
                want[d, s, a, b] = want.get((d, s, a, b), 0) + x * y
    assert got == pytest.approx(want) and len(want) > 50
    assert slices.pair_cosines(df.limit(0)).count() == 0


def test_nearest_and_mutual(spark):
    edges = spark.createDataFrame([("1", 0, 1, 0.5), ("1", 0, 2, 0.5), ("1", 1, 2, 0.1), ("1", 0, 3, 0.9)], "day string, src int, dst int, sim double")
    near = {(r.node, r.nbr) for r in slices.nearest(edges, 1).collect()}
    assert near == {(0, 3), (1, 0), (2, 0), (3, 0)}
    assert {(r.node, r.nbr) for r in slices.mutual(slices.nearest(edges, 1)).collect()} == {(0, 3), (3, 0)}


def test_clusters_follow_the_visits():
    pairs = [(0, 2), (2, 3), (3, 1)]
    both = pairs + [(b, a) for a, b in pairs]
    found = slices.cluster_day(pd.DataFrame({"node": [a for a, _ in both], "nbr": [b for _, b in both], "sim": [1.0] * 6}))
    groups = {}
    for c, n, edges in found:
        groups.setdefault(c, (set(), edges))[0].add(n)
    assert sorted(map(sorted, (g for g, _ in groups.values()))) == [[0, 2], [1, 3]]
    assert all(len(e) == len(g) - 1 for g, e in groups.values())


def test_cluster_table(spark):
    nodes = spark.createDataFrame([("1", 0), ("1", 1), ("1", 2)], "day string, node int")
    edges = spark.createDataFrame([("1", 0, 1, 0.5), ("1", 1, 0, 0.5)], "day string, node int, nbr int, sim double")
    rows = slices.clusters(nodes, edges)
    assert sorted((r.cluster, r.node, r.degree) for r in rows.where("node IS NOT NULL").collect()) == [(0, 0, 1), (0, 1, 1), (1, 2, 1)]
    units = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b_c"), ("1", 2, "d")], "day string, seg_id int, unit string")
    anchors = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("b_c", -1.0), ("d", 0.0)], "gram string, logp double")
    worth = events.phrase_worth(units, anchors)
    assert {r.unit: round(r.worth, 6) for r in worth.collect()} == {"a": 1.0, "b_c": round(2.718281828 - 1, 6), "d": 1.0}
    scores = events.event_scores(rows, units, worth).collect()
    assert [(r.cluster, r.n, round(r.ratio, 6), r["rank"]) for r in scores] == [(0, 2, 1.0, 1)]
    report = events.event_report(rows, events.event_scores(rows, units, worth), units, worth)
    block = events.report_text(report).first().block.split("\n")
    assert len(block) == 6 and block[2] == "0 1" and block[4] == "b_c a" and block[5] == "0-1:0.5000"
    assert events.read_report(events.report_text(report)).first().units == ["b_c", "a"]
    labels = spark.createDataFrame([("1", "a", "a|did|x")], "day string, unit string, label string")
    assert events.relabel_report(events.read_report(events.report_text(report)), labels).first().labels == ["b_c", "a|did|x"]
    assert [tuple(r) for r in events.size_histogram(events.event_scores(rows, units, worth)).collect()] == [("1", 2, 1)]


def test_frame_worth_and_labels(spark):
    anchors = spark.createDataFrame([("a", 0.0)], "gram string, logp double")
    assert events.phrase_worth(spark.createDataFrame([("a|x|a",), ("zz",)], "unit string"), anchors).where("unit = 'a|x|a'").first().worth == pytest.approx(2.0)
    units = spark.createDataFrame([("1", 0, "cat"), ("1", 1, "none")], "day string, seg_id int, unit string")
    frames = spark.createDataFrame([("1", "cat|saw|dog"), ("1", "cat|saw|dog"), ("1", "cat|ate|"), ("1", "x|y|cat")], "day string, frame string")
    assert {r.unit: r.label for r in events.labelled_units(units, frames).collect()} == {"cat": "cat|saw|dog", "none": "none"}


def test_stats(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n bigint")
    assert {r.k: r.pct for r in stats.percentages(counts).collect()} == {"a": 25.0, "b": 75.0}
    values = spark.createDataFrame([(0,), (1,), (7,), (None,)], "v int")
    assert [tuple(r) for r in stats.bucket_counts(values, "v", (0, 1, 5)).collect()] == [(0.0, 1), (1.0, 1), (5.0, 1)]
    rng = random.Random(1)
    places = [(f"u{rng.randint(0, 300)}", rng.randint(0, 10_000)) for _ in range(2000)]
    first = {}
    for u, p in places:
        first[u] = min(p, first.get(u, p))
    want = {u: i for i, (u, _) in enumerate(sorted(first.items(), key=lambda x: (x[1], x[0])))}
    assert {r.u: r.number for r in stats.numbered(spark.createDataFrame(places, "u string, p int"), "u", "p").collect()} == want
    assert stats.numbered(spark.createDataFrame([], "u string, p int"), "u", "p").count() == 0

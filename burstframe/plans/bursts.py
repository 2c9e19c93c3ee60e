"""Queries of the burst and event stages, with the words of tweets as units."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.operators import burst, events, slices
from burstframe.plans.tweets import KNOWN, PLACED, placed_tweets
from burstframe.session import cut, table


#: Units are the words of any script, of any length.
WORDS = r"[\p{L}\p{M}\p{N}_]+"


@dataclass
class Course:
    """The steps of one day-partitioned corpus, each made when first asked for. Steps that several others read are written
    once; the placed tweets are not if `shared` is false, for a query that reads them once."""

    spark: SparkSession
    d: str
    shared: bool = True

    @cached_property
    def social(self) -> DataFrame:
        return table(self.spark, self.d, "social")

    @cached_property
    def placed(self) -> DataFrame:
        rows = placed_tweets(self.spark, self.d)
        return cut(rows) if self.shared else rows

    @cached_property
    def all_units(self) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
        return self.placed.where("text IS NOT NULL").select("day", "tweet_id", F.explode(F.array_distinct(words)).alias("unit"))

    @cached_property
    def units(self) -> DataFrame:
        return burst.keep_units(self.all_units, table(self.spark, self.d, "stop_words"))

    @cached_property
    def ps(self) -> DataFrame:
        return burst.unit_ps(self.units, burst.day_sizes(self.placed))

    @cached_property
    def bursts(self) -> DataFrame:
        return burst.unit_bursts(self.units, burst.known_sizes(self.placed, self.social), self.social, self.ps)

    @cached_property
    def top(self) -> DataFrame:
        return cut(burst.top_bursts(self.bursts))

    @cached_property
    def involved(self) -> DataFrame:
        return burst.involved_tweets(self.units, self.top)

    @cached_property
    def hours(self) -> DataFrame:
        known = self.social.where("tweet_id IS NOT NULL AND hour IS NOT NULL").groupBy("tweet_id").agg(F.min("hour").alias("hour"))
        return self.placed.select("day", "line_idx", "tweet_id").join(known, "tweet_id")

    @cached_property
    def sliced(self) -> DataFrame:
        return slices.anchored_slices(self.hours)

    @cached_property
    def members(self) -> DataFrame:
        held = burst.occurrences(self.units).join(self.top.select("day", "unit", "seg_id"), ["day", "unit"])
        return cut(held.join(self.sliced.select("day", "tweet_id", "slice"), ["day", "tweet_id"]).select("day", "slice", "seg_id", "tweet_id").distinct())

    @cached_property
    def word_df(self) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
        return self.texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    @cached_property
    def texts(self) -> DataFrame:
        return self.placed.where("text IS NOT NULL").select("tweet_id", "text")

    @cached_property
    def tf(self) -> DataFrame:
        return slices.slice_tf(self.members, self.texts)

    @cached_property
    def vectors(self) -> DataFrame:
        return slices.slice_vectors(self.tf, self.word_df, self.texts.agg(F.count(F.lit(1)).alias("n_tweets")))

    @cached_property
    def pairs(self) -> DataFrame:
        return cut(slices.pair_similarities(cut(self.vectors), slices.slice_shares(self.members, self.top)))

    @cached_property
    def knn(self) -> DataFrame:
        return slices.nearest(self.pairs.withColumn("sim", F.round("sim", 9)))

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(slices.clusters(self.top.select("day", F.col("seg_id").alias("node")), slices.mutual(self.knn)))

    @cached_property
    def anchors(self) -> DataFrame:
        """Log shares of the words and word pairs of the labelled corpus."""
        w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 2), "_"))
        docs = table(self.spark, self.d, "corpus_item").where("text IS NOT NULL")
        counts = docs.select(F.explode(F.array_distinct(F.concat(w, pairs))).alias("gram")).where("gram <> ''").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        return counts.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("all")))).select("gram", F.ln(F.col("n") / F.col("all")).alias("logp"))

    @cached_property
    def worth(self) -> DataFrame:
        return cut(events.phrase_worth(self.top, self.anchors))

    @cached_property
    def scores(self) -> DataFrame:
        return events.event_scores(self.clusters, self.top, self.worth)


def unit_day_df(spark: SparkSession, d: str) -> DataFrame:
    return burst.unit_day_df(Course(spark, d, shared=False).units)


def unit_df(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of the units that the labelled corpus knows too."""
    c = Course(spark, d, shared=False)
    known = c.anchors.where("NOT contains(gram, '_')").select(F.col("gram").alias("unit"))
    return burst.unit_df(burst.keep_units(c.all_units, known=known))


def unit_ps(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).ps.select("unit", F.round("ps", 9).alias("ps"))


def burst_units(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).bursts.select("day", "unit", "f_st", "u_st", F.round("wb", 6).alias("wb"))


def burst_topk(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).top.select("day", "seg_id", "unit", "f_st", F.round("wb", 6).alias("wb"))


def involved_tweets(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).involved


def anchored_slices(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d, shared=False).sliced.select("day", "line_idx", "tweet_id", "hour", "slice")


def slice_tf(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).tf


def slice_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).vectors.select("day", "slice", "seg_id", "word", F.round("w", 6).alias("w"))


def slice_norms(spark: SparkSession, d: str) -> DataFrame:
    return slices.slice_norms(Course(spark, d).vectors).withColumn("norm", F.round("norm", 6))


def unit_pair_sim(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).pairs.withColumn("sim", F.round("sim", 6))


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).knn.withColumn("sim", F.round("sim", 6))


def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return slices.mutual(Course(spark, d).knn).select("day", "node", "nbr")


def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).clusters.withColumn("sim", F.round("sim", 6))


def phrase_worth(spark: SparkSession, d: str) -> DataFrame:
    """Worth of the words and of the word pairs of top units."""
    c = Course(spark, d)
    units = c.top.select("unit").unionByName(c.anchors.where("contains(gram, '_')").select(F.col("gram").alias("unit")))
    return events.phrase_worth(units, c.anchors).withColumn("worth", F.round("worth", 6))


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    return Course(spark, d).scores.select("day", "cluster", "n", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"), "rank")


def event_report(spark: SparkSession, d: str) -> DataFrame:
    c = Course(spark, d)
    return events.report_text(events.event_report(c.clusters, c.scores, c.top, c.worth))


def event_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of each event as they are read back from its report, in order of worth."""
    rows = events.read_report(event_report(spark, d))
    return rows.select("day", "rank", F.posexplode("units").alias("pos", "unit"))


def event_histograms(spark: SparkSession, d: str) -> DataFrame:
    scores = Course(spark, d).scores
    sizes = events.size_histogram(scores).select("day", F.lit("size").alias("kind"), F.col("size").cast("int").alias("value"), "n_events")
    ratios = events.ratio_histogram(scores).select("day", F.lit("ratio").alias("kind"), F.col("bucket").alias("value"), "n_events")
    return sizes.unionByName(ratios)


QUERIES = {
    f.__name__: f
    for f in (
        unit_day_df, unit_df, unit_ps, burst_units, burst_topk, involved_tweets, anchored_slices, slice_tf, slice_tfidf, slice_norms, unit_pair_sim,
        knn_edges, mutual_knn, event_clusters, phrase_worth, event_scores, event_report, event_units, event_histograms,
    )
}

_ALL = f"""placed AS ({PLACED}),
all_units AS (SELECT DISTINCT day, tweet_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS unit FROM placed WHERE text IS NOT NULL AND day IS NOT NULL),
units AS (SELECT * FROM all_units WHERE length(unit) >= 1 AND NOT contains(unit, 'http') AND unit NOT IN (SELECT lower(word) FROM stop_words WHERE word IS NOT NULL))"""

def ps_sql(units: str) -> str:
    """Common tables up to ps, for common tables that end in placed and units (day, tweet_id, unit)."""
    return f"""{units},
sizes AS (SELECT day, count(DISTINCT tweet_id) AS n FROM placed WHERE day IS NOT NULL GROUP BY day),
day_df AS (SELECT unit, day, count(*) AS df FROM units GROUP BY unit, day),
ps AS (SELECT unit, avg(df / n) AS ps FROM day_df JOIN sizes USING (day) GROUP BY unit)"""


def burst_sql(units: str) -> str:
    """Common tables up to top (day, seg_id, unit, f_st, wb)."""
    return f"""{ps_sql(units)},
known AS ({KNOWN}),
known_sizes AS (SELECT day, count(*) AS n FROM (SELECT DISTINCT day, tweet_id FROM placed WHERE day IS NOT NULL) JOIN known USING (tweet_id) GROUP BY day),
counts AS (SELECT day, unit, count(*) AS f_st, count(DISTINCT user_id) AS u_st FROM units JOIN known USING (tweet_id) GROUP BY day, unit),
expected AS (SELECT day, unit, f_st, u_st, n, n * ps AS e, sqrt(n * ps * (1 - ps)) AS s FROM counts JOIN ps USING (unit) JOIN known_sizes USING (day)),
bursts AS (SELECT day, unit, f_st, u_st, n, (CASE WHEN f_st >= e + 2 * s THEN 1 ELSE 1 / (1 + exp(-(10 * (f_st - e - s) / s))) END) * log10(u_st) AS wb
    FROM expected WHERE f_st > e),
top AS (SELECT day, (r - 1)::INT AS seg_id, unit, f_st, wb FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY wb DESC, unit) AS r FROM bursts) WHERE r - 1 <= floor(sqrt(n)))"""


_PS, _BURST = ps_sql(_ALL), burst_sql(_ALL)
SLICED = f"""{_BURST},
hours AS (SELECT day, line_idx, tweet_id, hour FROM placed JOIN (SELECT tweet_id, min(hour) AS hour FROM social WHERE tweet_id IS NOT NULL AND hour IS NOT NULL GROUP BY 1) USING (tweet_id)),
maxima AS (SELECT day, line_idx, hour, row_number() OVER (PARTITION BY day ORDER BY line_idx) AS k FROM (
    SELECT *, max(hour) OVER (PARTITION BY day ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hours) WHERE before IS NULL OR hour > before),
starts AS (
    SELECT day, line_idx, k, CASE WHEN hour >= 2 THEN hour ELSE 0 END AS start FROM maxima WHERE k = 1
    UNION ALL
    SELECT m.day, m.line_idx, m.k, CASE WHEN m.hour >= s.start + 2 THEN m.hour ELSE s.start END FROM starts s JOIN maxima m ON m.day = s.day AND m.k = s.k + 1),
sliced AS (SELECT h.day, h.line_idx, h.tweet_id, h.hour, s.start AS slice FROM hours h ASOF JOIN starts s ON h.day = s.day AND h.line_idx >= s.line_idx WHERE h.hour >= s.start),
members AS (SELECT DISTINCT day, slice, seg_id, tweet_id FROM units JOIN top USING (day, unit) JOIN sliced USING (day, tweet_id)),
texts AS (SELECT tweet_id, text FROM placed WHERE text IS NOT NULL),
words AS (SELECT tweet_id, word, count(*) AS n FROM (SELECT tweet_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM texts) WHERE word <> '' GROUP BY 1, 2),
tf AS (SELECT day, slice, seg_id, word, sum(n)::BIGINT AS tf FROM members JOIN words USING (tweet_id) GROUP BY ALL)"""
_VECTORS = f"""{SLICED},
word_df AS (SELECT word, count(*) AS df FROM words GROUP BY word),
vectors AS (SELECT day, slice, seg_id, word, tf * ln((SELECT count(*) FROM texts) // df) AS w FROM tf JOIN word_df USING (word) WHERE (SELECT count(*) FROM texts) // df > 1),
norms AS (SELECT day, slice, seg_id, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY ALL)"""
_PAIRS = f"""{_VECTORS},
shares AS (SELECT day, slice, seg_id, count(DISTINCT tweet_id) / any_value(f_st) AS fw FROM members JOIN top USING (day, seg_id) GROUP BY ALL),
cosines AS (SELECT a.day, a.slice, a.seg_id AS src, b.seg_id AS dst, sum(a.w / na.norm * (b.w / nb.norm)) AS cos
    FROM vectors a JOIN vectors b ON a.day = b.day AND a.slice = b.slice AND a.word = b.word AND a.seg_id < b.seg_id
    JOIN norms na ON na.day = a.day AND na.slice = a.slice AND na.seg_id = a.seg_id JOIN norms nb ON nb.day = b.day AND nb.slice = b.slice AND nb.seg_id = b.seg_id GROUP BY ALL),
pairs AS (SELECT a.day, a.seg_id AS src, b.seg_id AS dst, sum(a.fw * b.fw * coalesce(cos, 0)) AS sim
    FROM shares a JOIN shares b ON a.day = b.day AND a.slice = b.slice AND a.seg_id < b.seg_id
    LEFT JOIN cosines c ON c.day = a.day AND c.slice = a.slice AND c.src = a.seg_id AND c.dst = b.seg_id GROUP BY ALL)"""
_KNN = f"""{_PAIRS},
both_ways AS (SELECT day, src AS node, dst AS nbr, round(sim, 9) AS sim FROM pairs UNION ALL SELECT day, dst, src, round(sim, 9) FROM pairs),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, node ORDER BY sim DESC, nbr)::INT AS rank FROM both_ways) WHERE rank <= 5)"""
_CLUSTERS = f"""{_KNN},
near AS (SELECT day, node, list(nbr ORDER BY nbr) AS near FROM knn k WHERE EXISTS (SELECT 1 FROM knn b WHERE b.day = k.day AND b.node = k.nbr AND b.nbr = k.node) GROUP BY day, node),
visits AS (
    SELECT day, n, 0 AS i, list_transform(range(n), lambda x: -1) AS home, 0 AS made, []::STRUCT(c INT, a INT, b INT)[] AS edges FROM (SELECT day, count(*)::INT AS n FROM top GROUP BY day)
    UNION ALL
    SELECT day, n, i + 1, list_transform(range(n), lambda x: CASE WHEN x = i OR list_contains(fresh, x) THEN c ELSE home[x + 1] END), made + (home[i + 1] < 0)::INT,
        list_concat(edges, list_transform(fresh, lambda x: {{'c': c, 'a': least(i, x)::INT, 'b': greatest(i, x)::INT}}))
    FROM (SELECT v.*, list_filter(coalesce(k.near, []), lambda x: v.home[x + 1] < 0) AS fresh, CASE WHEN v.home[v.i + 1] < 0 THEN v.made ELSE v.home[v.i + 1] END AS c
        FROM visits v LEFT JOIN near k ON k.day = v.day AND k.node = v.i WHERE v.i < v.n)),
settled AS (SELECT * FROM visits WHERE i = n),
taken AS (SELECT day, (e).c AS cluster, (e).a AS src, (e).b AS dst, sim FROM (SELECT day, unnest(edges) AS e FROM settled) JOIN (SELECT day AS d, node, nbr, sim FROM knn) k ON k.d = day AND k.node = (e).a AND k.nbr = (e).b),
housed AS (SELECT day, unnest(home) AS cluster, unnest(range(n))::INT AS node FROM settled),
nodes AS (SELECT h.day, h.cluster, h.node, greatest(1, count(t.src))::INT AS degree FROM housed h LEFT JOIN taken t ON t.day = h.day AND (t.src = h.node OR t.dst = h.node) GROUP BY ALL)"""
_ANCHORS = """docs AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM corpus_item WHERE text IS NOT NULL),
grams AS (SELECT unnest(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i:i+1], '_'))))) AS gram FROM docs),
anchors AS (SELECT gram, ln(count(*) / (SELECT count(*) FROM docs)) AS logp FROM grams WHERE gram <> '' GROUP BY gram)"""


_EVENTS = f"""{_CLUSTERS}, {_ANCHORS},
asked AS (SELECT DISTINCT unit FROM top),
grams_of AS (SELECT unit, contains(unit, '_') AS several, array_to_string(w[i:j], '_') AS gram
    FROM (SELECT unit, string_split(unit, '_') AS w FROM asked), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i), LATERAL (SELECT unnest(range(i, len(w) + 1)) AS j)),
worth AS (SELECT unit, CASE WHEN max(logp) IS NULL THEN 0 WHEN any_value(several) THEN greatest(exp(max(logp)) - 1, 0) ELSE exp(max(logp)) END AS worth
    FROM grams_of LEFT JOIN anchors USING (gram) GROUP BY unit),
members_of AS (SELECT c.day, c.cluster, c.node, c.degree, t.unit, coalesce(w.worth, 0) AS worth FROM nodes c JOIN top t ON t.day = c.day AND t.seg_id = c.node LEFT JOIN worth w USING (unit)),
scores AS (SELECT m.day, m.cluster, m.n, m.worth / m.n * coalesce(e.sim, 0) / m.n AS score
    FROM (SELECT day, cluster, count(*) AS n, sum(worth) AS worth FROM members_of GROUP BY 1, 2) m LEFT JOIN (SELECT day, cluster, sum(sim) AS sim FROM taken GROUP BY 1, 2) e USING (day, cluster)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ratio, cluster)::INT AS rank FROM (SELECT *, max(score) OVER (PARTITION BY day) / score AS ratio FROM scores WHERE score > 0)),
reported AS (
    SELECT r.day, r.rank, r.ratio, m.n, m.nodes, m.by_degree, m.by_worth, coalesce(e.edges, '') AS edges FROM ranked r
    JOIN (SELECT day, cluster, count(*) AS n, string_agg(node::VARCHAR, ' ' ORDER BY node) AS nodes, string_agg(unit, ' ' ORDER BY degree DESC, unit) AS by_degree,
        string_agg(unit, ' ' ORDER BY worth DESC, unit) AS by_worth FROM members_of GROUP BY 1, 2) m USING (day, cluster)
    LEFT JOIN (SELECT day, cluster, string_agg(printf('%d-%d:%.4f', src, dst, sim), ' ' ORDER BY src, dst) AS edges FROM taken GROUP BY 1, 2) e USING (day, cluster))"""

ORACLE = {
    "event_clusters": f"""WITH RECURSIVE {_CLUSTERS} SELECT day, cluster::INT AS cluster, node, degree, NULL::INT AS src, NULL::INT AS dst, NULL::DOUBLE AS sim FROM nodes
        UNION ALL SELECT day, cluster, NULL, NULL, src, dst, round(sim, 6) FROM taken""",
    "event_scores": f"WITH RECURSIVE {_EVENTS} SELECT day, cluster::INT AS cluster, n, round(score, 6) AS score, round(ratio, 6) AS ratio, rank FROM ranked",
    "event_report": f"""WITH RECURSIVE {_EVENTS} SELECT day, rank,
        concat_ws(chr(10), repeat('*', 20), printf('%d %.4f %d', rank, ratio, n), nodes, by_degree, by_worth, edges) AS block FROM reported""",
    "event_units": f"WITH RECURSIVE {_EVENTS} SELECT day, rank, unnest(range(len(u)))::INT AS pos, unnest(u) AS unit FROM (SELECT day, rank, string_split(by_worth, ' ') AS u FROM reported)",
    "event_histograms": f"""WITH RECURSIVE {_EVENTS} SELECT day, 'size' AS kind, n::INT AS value, count(*) AS n_events FROM ranked GROUP BY ALL
        UNION ALL SELECT day, 'ratio', floor(ratio)::INT, count(*) FROM ranked WHERE floor(ratio) <= 10 GROUP BY ALL""",
    "unit_day_df": f"WITH {_PS} SELECT unit, day, df FROM day_df",
    "unit_df": f"WITH {_ALL}, {_ANCHORS} SELECT unit, count(DISTINCT tweet_id) AS df FROM all_units WHERE NOT contains(unit, 'http') AND unit IN (SELECT gram FROM anchors) GROUP BY unit",
    "unit_ps": f"WITH {_PS} SELECT unit, round(ps, 9) AS ps FROM ps",
    "burst_units": f"WITH {_BURST} SELECT day, unit, f_st, u_st, round(wb, 6) AS wb FROM bursts",
    "burst_topk": f"WITH {_BURST} SELECT day, seg_id, unit, f_st, round(wb, 6) AS wb FROM top",
    "involved_tweets": f"WITH {_BURST} SELECT DISTINCT day, tweet_id FROM units JOIN top USING (day, unit)",
    "anchored_slices": f"WITH RECURSIVE {SLICED} SELECT day, line_idx, tweet_id, hour, slice FROM sliced",
    "slice_tf": f"WITH RECURSIVE {SLICED} SELECT * FROM tf",
    "slice_tfidf": f"WITH RECURSIVE {_VECTORS} SELECT day, slice, seg_id, word, round(w, 6) AS w FROM vectors",
    "slice_norms": f"WITH RECURSIVE {_VECTORS} SELECT day, slice, seg_id, round(norm, 6) AS norm FROM norms",
    "unit_pair_sim": f"WITH RECURSIVE {_PAIRS} SELECT day, src, dst, round(sim, 6) AS sim FROM pairs",
    "knn_edges": f"WITH RECURSIVE {_KNN} SELECT day, node, nbr, round(sim, 6) AS sim, rank FROM knn",
    "mutual_knn": f"WITH RECURSIVE {_KNN} SELECT a.day, a.node, a.nbr FROM knn a JOIN knn b ON a.day = b.day AND a.node = b.nbr AND a.nbr = b.node",
    "phrase_worth": f"""WITH {_BURST}, {_ANCHORS},
        asked AS (SELECT unit FROM top UNION SELECT gram FROM anchors WHERE contains(gram, '_')),
        runs AS (SELECT unit, contains(unit, '_') AS several, array_to_string(w[i:j], '_') AS gram
            FROM (SELECT unit, string_split(unit, '_') AS w FROM asked), range(1, 9) a(i), range(1, 9) b(j) WHERE i <= j AND j <= len(w))
        SELECT unit, round(CASE WHEN max(logp) IS NULL THEN 0 WHEN any_value(several) THEN greatest(exp(max(logp)) - 1, 0) ELSE exp(max(logp)) END, 6) AS worth
        FROM runs LEFT JOIN anchors USING (gram) GROUP BY unit""",
}

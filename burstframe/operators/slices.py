"""Intra-day slices, sliced similarities, nearest neighbours and clusters of bursty units."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of a day at most, and nearest neighbours.
SLICES, NEIGHBOURS = 12, 5
#: Units of a block of the similarity product.
BLOCK = 128


def shift_hour(hour: Column, by: int = 8) -> Column:
    return F.pmod(hour + by, F.lit(24))


def slice_starts(maxima: Column, step: int) -> Column:
    """For the rising maxima of the hours seen, the start of the slice that each falls in: a slice is closed by the first
    hour `step` or more after its start, and that hour starts the next."""
    folded = F.aggregate(
        maxima,
        F.array().cast("array<int>"),
        lambda acc, h: F.array_append(acc, F.when(h >= F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + step, h).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    return folded


def anchored_slices(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """rows (day, line_idx, hour, ...) with slice, the start hour; rows of an hour before the current slice are late and
    dropped, and so are rows without an hour.

    Only a new maximum of the hours can close a slice, so the slices of a day follow from its at most 24 maxima. Those
    need, for each (day, hour), only the first place where the hour occurs: a small aggregate. No task sorts a day.
    """
    step = 24 // slices
    rows = rows.where("day IS NOT NULL AND hour IS NOT NULL")
    firsts = rows.groupBy("day", "hour").agg(F.min("line_idx").alias("first"))  # at most 24 rows a day
    order = F.array_sort(F.collect_list(F.struct("first", F.col("hour").cast("int").alias("hour"))))
    days = firsts.groupBy("day").agg(order.alias("seen"))
    rising = F.filter("seen", lambda x, i: F.coalesce(x.hour > F.array_max(F.transform(F.slice("seen", 1, i), lambda y: y.hour)), F.lit(True)))
    days = days.withColumn("rising", rising)
    days = days.withColumn("starts", slice_starts(F.transform("rising", lambda x: x.hour), step))
    spans = days.select("day", F.arrays_zip(F.transform("rising", lambda x: x["first"]).alias("since"), F.col("starts").alias("start")).alias("spans"))
    joined = rows.join(F.broadcast(spans), "day")  # a row for each day
    begun = F.element_at(F.filter("spans", lambda s: s.since <= F.col("line_idx")), -1)
    return joined.withColumn("slice", begun.start).where("hour >= slice").drop("spans")


def slice_tf(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(day, slice, seg_id, word, tf): words of the lower-cased texts of a unit's tweets in a slice.

    members is (day, slice, seg_id, tweet_id), distinct; texts (tweet_id, text), one row a tweet.
    """
    used = texts.join(members.select("tweet_id").distinct(), "tweet_id", "left_semi")
    words = used.select("tweet_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("word"))
    words = words.groupBy("tweet_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return members.join(words, "tweet_id").groupBy("day", "slice", "seg_id", "word").agg(F.sum("n").alias("tf"))


def slice_vectors(tf: DataFrame, word_df: DataFrame, size: DataFrame) -> DataFrame:
    """(day, slice, seg_id, word, w): tf times ln of the whole-number ratio n_tweets / df. Words without a df are dropped,
    and so are weights of 0, which add nothing to products and norms. size is one row with n_tweets."""
    idf = F.ln(F.floor(F.col("n_tweets") / F.col("df")))
    return tf.join(word_df, "word").crossJoin(F.broadcast(size)).select("day", "slice", "seg_id", "word", (F.col("tf") * idf).alias("w")).where("w <> 0 AND w IS NOT NULL")


def slice_norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("day", "slice", "seg_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def slice_shares(members: DataFrame, top: DataFrame) -> DataFrame:
    """(day, slice, seg_id, fw): the part of a unit's tweets of the day that lie in the slice."""
    counts = members.groupBy("day", "slice", "seg_id").agg(F.countDistinct("tweet_id").alias("f_stm"))
    return counts.join(top.select("day", "seg_id", "f_st"), ["day", "seg_id"]).select("day", "slice", "seg_id", (F.col("f_stm") / F.col("f_st")).alias("fw"))


def _block_cosines(block: pa.Table) -> pa.Table:
    """Cosines of the units of one block with those of another, or of its own: a product of two matrices."""
    left = np.array(block["side"]) == 0
    words = np.unique(np.array(block["word"]), return_inverse=True)[1]
    ids, u = np.array(block["seg_id"]), np.array(block["u"])

    def matrix(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, place = np.unique(ids[side], return_inverse=True)
        out = np.zeros((len(units), words.max(initial=-1) + 1))
        out[place, words[side]] = u[side]
        return units, out

    (a, one), (b, other) = matrix(left), matrix(~left)
    cos = one @ other.T
    i, j = np.nonzero((a[:, None] < b[None, :]) & (cos != 0))
    same = lambda name: pa.array([block[name][0].as_py()] * len(i), block[name].type)
    return pa.table({"day": same("day"), "slice": same("slice"), "src": pa.array(a[i], pa.int32()), "dst": pa.array(b[j], pa.int32()), "cos": pa.array(cos[i, j])})


def pair_cosines(unit: DataFrame, block: int = BLOCK) -> DataFrame:
    """(day, slice, src, dst, cos), src < dst, of unit vectors (day, slice, seg_id, word, u) with a word in common.

    A join on the word would make a row for each word that two units share. Here the units of a slice are cut into blocks
    of `block`, each pair of blocks is one matrix product, and only its results, at most as many as pairs of units, leave
    the task. A vector is repeated once for each block of its day: units of a day are the square root of its tweets.
    """
    numbered = unit.select("day", "slice", F.col("seg_id").cast("int").alias("seg_id"), F.xxhash64("word").alias("word"), "u").withColumn("own", F.floor(F.col("seg_id") / block).cast("int"))
    last = numbered.groupBy("day").agg(F.max("own").alias("last"))  # a row for each day
    numbered = numbered.join(F.broadcast(last), "day")
    one = numbered.withColumns({"side": F.lit(0), "a": F.col("own"), "b": F.explode(F.sequence("own", "last"))})
    other = numbered.withColumns({"side": F.lit(1), "b": F.col("own"), "a": F.explode(F.sequence(F.lit(0), "own"))})
    fields = ["day", "slice", "a", "b", "side", "seg_id", "word", "u"]
    kinds = {f.name: f.dataType.simpleString() for f in unit.schema}
    schema = f"day {kinds['day']}, slice {kinds['slice']}, src INT, dst INT, cos DOUBLE"
    return one.select(*fields).unionByName(other.select(*fields)).groupBy("day", "slice", "a", "b").applyInArrow(_block_cosines, schema)


def pair_similarities(vectors: DataFrame, shares: DataFrame) -> DataFrame:
    """(day, src, dst, sim), src < dst: the sum over slices of share times share times cosine. Pairs of units that meet in
    a slice have a row even at similarity 0, as the neighbour search expects: units of a day are the square root of its
    tweets, and pairs their square, as many as tweets."""
    unit = vectors.join(slice_norms(vectors), ["day", "slice", "seg_id"]).select("day", "slice", "word", "seg_id", (F.col("w") / F.col("norm")).alias("u"))
    cosines = pair_cosines(unit)
    s = shares.select("day", "slice", F.col("seg_id").alias("src"), F.col("fw").alias("fa"))
    d = shares.select("day", "slice", F.col("seg_id").alias("dst"), F.col("fw").alias("fb"))
    met = s.join(d, ["day", "slice"]).where("src < dst")
    sims = met.join(cosines, ["day", "slice", "src", "dst"], "left").withColumn("sim", F.col("fa") * F.col("fb") * F.coalesce("cos", F.lit(0.0)))
    return sims.groupBy("day", "src", "dst").agg(F.sum("sim").alias("sim"))


def nearest(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(day, node, nbr, sim, rank): the k most similar neighbours of each node, equal ones by number; edges count for both ends."""
    both = edges.select("day", F.col("src").alias("node"), F.col("dst").alias("nbr"), "sim").unionByName(
        edges.select("day", F.col("dst").alias("node"), F.col("src").alias("nbr"), "sim")
    )
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("day", "node").orderBy(F.desc("sim"), "nbr")))
    return ranked.where(F.col("rank") <= k)


def mutual(knn: DataFrame) -> DataFrame:
    """Neighbours that name each other; both directions are kept."""
    back = knn.select("day", F.col("nbr").alias("node"), F.col("node").alias("nbr"))
    return knn.join(back, ["day", "node", "nbr"], "left_semi")


def cluster_day(edges: pd.DataFrame) -> list[tuple[int, int, list[tuple[int, int, float]]]]:
    """(cluster, node, edges) of one day. Nodes are visited in order; a visitor takes each mutual neighbour that no cluster
    has yet into its own, and the edge with it. One that is left alone is a cluster of its own."""
    near: dict[int, list[tuple[int, float]]] = {}
    for node, nbr, sim in zip(edges["node"].tolist(), edges["nbr"].tolist(), edges["sim"].tolist(), strict=True):
        near.setdefault(int(node), [])
        if nbr is not None and nbr == nbr:
            near[int(node)].append((int(nbr), float(sim)))
    home: dict[int, int] = {}
    taken: dict[int, list[tuple[int, int, float]]] = {}
    for node in sorted(near):
        for nbr, sim in sorted(near[node]):
            if nbr in home:
                continue
            cluster = home.setdefault(node, len(taken))
            taken.setdefault(cluster, [])
            home[nbr] = cluster
            taken[cluster].append((min(node, nbr), max(node, nbr), sim))
        if node not in home:
            home[node] = len(taken)
            taken[home[node]] = []
    return [(c, n, taken[c]) for n, c in sorted(home.items())]


def clusters(nodes: DataFrame, mutual_edges: DataFrame) -> DataFrame:
    """(day, cluster, node, degree, src, dst, sim) in long form: a row for each node, with src null, and one for each edge,
    with node null. A day has as many nodes as the square root of its tweets, so one task a day is enough."""
    rows = nodes.select("day", "node").join(mutual_edges.select("day", "node", "nbr", "sim"), ["day", "node"], "left")

    def run(day: pd.DataFrame) -> pd.DataFrame:
        found = cluster_day(day)
        out, seen = [], set()
        degree: dict[int, int] = {}
        for c, _, edges in found:
            if c not in seen:
                seen.add(c)
                for a, b, sim in edges:
                    degree[a] = degree.get(a, 0) + 1
                    degree[b] = degree.get(b, 0) + 1
                    out.append((c, None, None, a, b, sim))
        out += [(c, n, degree.get(n, 1), None, None, None) for c, n, _ in found]
        table = pd.DataFrame(out, columns=["cluster", "node", "degree", "src", "dst", "sim"])
        table = table.astype({"cluster": "Int32", "node": "Int32", "degree": "Int32", "src": "Int32", "dst": "Int32", "sim": "float64"})
        table.insert(0, "day", day["day"].iloc[0])
        return table

    kind = rows.schema["day"].dataType.simpleString()
    return rows.groupBy("day").applyInPandas(run, f"day {kind}, cluster INT, node INT, degree INT, src INT, dst INT, sim DOUBLE")

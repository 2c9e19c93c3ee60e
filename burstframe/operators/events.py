"""Worth, score, report and labels of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstframe.functions import text as tx

FRAMES_KEPT = 10


def phrase_worth(units: DataFrame, anchors: DataFrame, slot: str | None = "|") -> DataFrame:
    """(unit, worth) of distinct units: a single word is worth exp(logp) if it is an anchor, a phrase the most that exp(logp) - 1
    reaches among its contiguous parts, at least 0; a frame the sum over its slots. anchors is (gram, logp), words of a
    gram joined by _; it may be large, so the planner chooses the join."""
    distinct = units.select("unit").distinct()
    slots = F.split("unit", rf"\{slot}") if slot else F.array("unit")
    parts = distinct.select("unit", F.posexplode(slots).alias("slot", "phrase")).where("phrase <> ''")
    grams = parts.select("unit", "slot", F.contains("phrase", F.lit("_")).alias("several"), F.explode(tx.sub_phrases(F.col("phrase"))).alias("gram"))
    best = anchors.groupBy("gram").agg(F.max("logp").alias("logp"))
    known = grams.join(best, "gram", "left").groupBy("unit", "slot", "several").agg(F.max("logp").alias("logp"))
    value = F.when(F.col("logp").isNull(), 0.0).when(F.col("several"), F.greatest(F.exp("logp") - 1, F.lit(0.0))).otherwise(F.exp("logp"))
    return distinct.join(known.groupBy("unit").agg(F.sum(value).alias("worth")), "unit", "left").select("unit", F.coalesce("worth", F.lit(0.0)).alias("worth"))


def event_scores(clusters: DataFrame, units: DataFrame, worth: DataFrame) -> DataFrame:
    """(day, cluster, n, score, ratio, rank): mean worth times mean edge similarity; events without a score above 0 are
    left out; ratio is the day's best score over the event's, rank follows it, equal ones by cluster."""
    nodes = clusters.where("node IS NOT NULL").join(units.select("day", F.col("seg_id").alias("node"), "unit"), ["day", "node"]).join(worth, "unit", "left")
    a = nodes.groupBy("day", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("worth", F.lit(0.0))).alias("worth"))
    b = clusters.where("src IS NOT NULL").groupBy("day", "cluster").agg(F.sum("sim").alias("sim"))
    scored = a.join(b, ["day", "cluster"], "left").withColumn("score", F.col("worth") / F.col("n") * F.coalesce("sim", F.lit(0.0)) / F.col("n")).where("score > 0")
    day = W.partitionBy("day")
    ratio = F.max("score").over(day) / F.col("score")
    return scored.withColumn("ratio", ratio).withColumn("rank", F.row_number().over(day.orderBy("ratio", "cluster"))).select("day", "cluster", "n", "score", "ratio", "rank")


def unit_frames(frames: DataFrame, units: DataFrame, keep: int = FRAMES_KEPT) -> DataFrame:
    """(day, unit, frame, n, rank): the frames that hold a unit as one of their slots, counted by occurrence, the `keep`
    most frequent, equal ones by text. frames is (day, frame) with arg1|verb|arg2; slots of one character label nothing."""
    slots = frames.select("day", "frame", F.explode(F.array_distinct(F.split("frame", r"\|"))).alias("unit")).where("length(unit) > 1")
    used = slots.join(units.select("day", "unit").distinct(), ["day", "unit"], "left_semi")
    counted = used.groupBy("day", "unit", "frame").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("day", "unit").orderBy(F.desc("n"), "frame")))
    return ranked.where(F.col("rank") <= keep)


def labelled_units(units: DataFrame, frames: DataFrame) -> DataFrame:
    """(day, seg_id, unit, label): the most frequent frame of each unit, or the unit itself."""
    best = unit_frames(frames, units).where("rank = 1").select("day", "unit", F.col("frame").alias("frame_label"))
    return units.join(best, ["day", "unit"], "left").select("day", "seg_id", "unit", F.coalesce("frame_label", "unit").alias("label"))


def event_report(clusters: DataFrame, scores: DataFrame, units: DataFrame, worth: DataFrame) -> DataFrame:
    """(day, rank, ratio, nodes, units_by_degree, units_by_worth, edges) of the scored events, in nested form. The arrays
    of an event hold at most the units of a day."""
    nodes = clusters.where("node IS NOT NULL").join(units.select("day", F.col("seg_id").alias("node"), "unit"), ["day", "node"]).join(worth, "unit", "left")

    def listed(key: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct((-key).alias("k"), F.col("unit").alias("unit"))))
        return F.transform(rows, lambda r: r.unit)

    a = nodes.groupBy("day", "cluster").agg(
        F.array_sort(F.collect_list("node")).alias("nodes"), listed(F.col("degree")).alias("units_by_degree"), listed(F.coalesce("worth", F.lit(0.0))).alias("units_by_worth")
    )
    b = clusters.where("src IS NOT NULL").groupBy("day", "cluster").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "sim"))).alias("edges"))
    return scores.join(a, ["day", "cluster"]).join(b, ["day", "cluster"], "left").select("day", "rank", "ratio", "nodes", "units_by_degree", "units_by_worth", "edges")


def report_text(report: DataFrame) -> DataFrame:
    """(day, rank, block): the fixed block of six lines."""
    edges = F.array_join(F.transform("edges", lambda e: F.format_string("%d-%d:%.4f", e.src, e.dst, e.sim)), " ")
    lines = F.concat_ws(
        "\n", F.lit("*" * 20), F.format_string("%d %.4f %d", "rank", "ratio", F.size("nodes")), F.array_join(F.transform("nodes", lambda n: n.cast("string")), " "),
        F.array_join("units_by_degree", " "), F.array_join("units_by_worth", " "), edges,
    )
    return report.select("day", "rank", lines.alias("block"))


def read_report(blocks: DataFrame) -> DataFrame:
    """(day, rank, units): the worth-ordered units of a report's blocks."""
    return blocks.select("day", "rank", F.split(F.get(F.split("block", "\n"), F.lit(4)), " ").alias("units"))


def relabel_report(units: DataFrame, labels: DataFrame) -> DataFrame:
    """(day, rank, labels): the units of each event in order, each by its label if it has one."""
    rows = units.select("day", "rank", F.posexplode("units").alias("i", "unit"))
    named = rows.join(labels.select("day", "unit", "label").distinct(), ["day", "unit"], "left").withColumn("name", F.coalesce("label", "unit"))
    listed = named.groupBy("day", "rank").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("x"))
    return listed.select("day", "rank", F.array_distinct(F.transform("x", lambda x: x["name"])).alias("labels"))


def size_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("day", F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("n_events"))


def ratio_histogram(scores: DataFrame, most: int = 10) -> DataFrame:
    """Events by whole-number ratio, up to `most`."""
    return scores.withColumn("bucket", F.floor("ratio").cast("int")).where(F.col("bucket") <= most).groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("n_events"))

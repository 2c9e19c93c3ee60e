"""The stream-like steps on Structured Streaming: deduplication, daily windows, anchored slices and stateless filters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from burstframe.operators import chunking, tagging
from burstframe.session import shared_folder


def deduplicated(tweets: DataFrame, key: str = "id_str", time: str = "received_at", delay: str = "14 days") -> DataFrame:
    """The first row of each tweet. A repeat that comes more than `delay` behind the stream is late and may be dropped or
    kept; state older than that is forgotten. Rows without a key or time are left out."""
    return tweets.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(tweets: DataFrame, time: str = "received_at", delay: str = "14 days") -> DataFrame:
    """(day, n): rows of each day, final once the watermark has passed its end."""
    counts = tweets.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "n")


def daily_totals(tweets: DataFrame, time: str = "received_at") -> DataFrame:
    """(day, n): rows of each day so far, for output in full after each batch. The state is one number a day, so nothing is
    ever late, whatever the order of the input."""
    counts = tweets.where(F.col(time).isNotNull()).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "n")


def anchored_slices(rows: DataFrame, step: int = 2) -> DataFrame:
    """(day, tweet_id, hour, slice) of rows that come in order within each day: an hour `step` or more after the start of
    the current slice starts the next; rows before the current slice are late and dropped. The state of a day is one
    number. Rows without a day or hour are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else 0
        for batch in batches:
            kept = []
            for place, hour in enumerate(batch["hour"].tolist()):
                if hour >= start + step:
                    start = hour
                if hour >= start:
                    kept.append((place, start))
            out = batch.iloc[[p for p, _ in kept]][["tweet_id", "hour"]].copy()
            out.insert(0, "day", key[0])
            out["slice"] = [s for _, s in kept]
            yield out
        state.update((int(start),))

    used = rows.where("day IS NOT NULL AND hour IS NOT NULL").select("day", "tweet_id", F.col("hour").cast("int").alias("hour"))
    return used.groupBy("day").applyInPandasWithState(
        run, "day STRING, tweet_id STRING, hour INT, slice INT", "start INT", "append", GroupStateTimeout.NoTimeout
    )


def in_languages(tweets: DataFrame, langs: list[str]) -> DataFrame:
    """Original tweets of the languages that have a text."""
    return tweets.where(F.col("lang").isin(langs) & (F.col("retweet_count") == 0) & (F.length("text") > 0))


def chunked_lines(lines: DataFrame, text: Column) -> DataFrame:
    """Adds sentence and line, the number and the bracketed form of each sentence of a text; a stateless map. A text
    without sentences keeps one row, whose sentence is null and whose line is empty."""
    split = lines.select("*", F.posexplode_outer(tagging.sentences(text)).alias("sentence", "line"))
    tagged = split.withColumn("tokens", tagging.tag_sentence(F.coalesce("line", F.lit(""))))
    chunked = tagged.withColumn("spans", chunking.np_chunks(F.col("tokens")))
    return chunked.withColumn("line", chunking.bracketed(F.col("tokens"), F.col("spans"))).drop("tokens", "spans")


def run_available(stream: DataFrame) -> DataFrame:
    """What a stream gives for all input that is there now, through a file sink."""
    folder = shared_folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover
        raise RuntimeError(str(query.exception()))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_available_in_full(stream: DataFrame) -> DataFrame:
    """What an aggregating stream gives after all input that is there now, the groups that are still open included: each
    batch's whole result is written, and the last one read."""
    folder, schema = shared_folder(stream.sparkSession, "stream"), stream.schema
    done = [-1]

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        done[0] = batch

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("complete").start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(schema).parquet(f"{folder}/batch-{done[0]}") if done[0] >= 0 else spark.createDataFrame([], schema)

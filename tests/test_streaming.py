from pyspark.sql import functions as F

from burstframe.operators import chunking, tagging
from burstframe.streaming import tweets as st
from test_events import brute_slices


def source(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_dedup_and_language(spark, tmp_path):
    df = spark.createDataFrame([("1", "2013-01-01 00:00:00"), ("1", "2013-01-01 05:00:00"), ("2", "2013-01-02 00:00:00"), (None, "2013-01-02 00:00:00")], "id_str string, t string")
    df = df.select("id_str", F.to_timestamp("t").alias("received_at"), F.lit("en").alias("lang"), F.lit(0).alias("retweet_count"), F.lit("x").alias("text"))
    stream = source(spark, tmp_path, df)
    assert sorted(r.id_str for r in st.run_available(st.deduplicated(stream)).collect()) == ["1", "2"]
    assert st.run_available(st.in_languages(stream, ["de"])).count() == 0


def test_stateful_slices(spark, tmp_path):
    hours = [0, 1, 2, 5, 3, 6, 7, 23, 4]
    df = spark.createDataFrame([("1", str(i), h) for i, h in enumerate(hours)], "day string, tweet_id string, hour int")
    got = {int(r.tweet_id): r.slice for r in st.run_available(st.anchored_slices(source(spark, tmp_path, df))).collect()}
    assert got == {i: s for i, s in enumerate(brute_slices(hours)) if s is not None}


def test_days_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([("2013-01-01 01:00:00", "The dog ran."), ("2013-01-01 02:00:00", ""), ("2013-01-09 00:00:00", None)], "t string, text string")
    df = df.select(F.to_timestamp("t").alias("received_at"), "text")
    stream = source(spark, tmp_path, df)
    assert [(str(r.day), r.n) for r in st.run_available(st.daily_counts(stream, delay="1 day")).collect()] == [("2013-01-01", 2)]
    lines = [r.line for r in st.run_available(st.chunked_lines(stream, F.col("text")).select("line")).collect()]
    assert "[ The/DT dog/NN ] ran/VBD ./." in lines


def test_chunks_of_all_sentences(spark, tmp_path):
    df = spark.createDataFrame([("1", "The dog ran. A cat sat!\nWe saw it"), ("2", "\n\n"), ("3", "No end")], "id_str string, text string")
    got = [tuple(r) for r in st.run_available(st.chunked_lines(source(spark, tmp_path, df), F.col("text")).select("id_str", "sentence", "line")).collect()]
    batch = tagging.tagged_sentences(df, "id_str").withColumn("phrases", chunking.np_chunks(F.col("tokens")))
    want = [tuple(r) for r in batch.select("id_str", "sentence", chunking.bracketed(F.col("tokens"), F.col("phrases"))).collect()]
    assert len(want) == 4 and sorted(want) == sorted(r for r in got if r[1] is not None)
    assert [r for r in got if r[1] is None] == [("2", None, "")]


def test_days_of_two_batches(spark, tmp_path):
    """The second file holds rows long before those of the first; none is lost."""
    for k, days in enumerate((["09", "09", "10"], ["01", "09", "02"])):
        df = spark.createDataFrame([(f"2013-01-{x} 01:00:00",) for x in days], "t string").select(F.to_timestamp("t").alias("received_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {str(r.day)[-2:]: r.n for r in st.run_available_in_full(st.daily_totals(stream)).collect()}
    assert got == {"09": 3, "10": 1, "01": 1, "02": 1}
    one = st.run_available(st.daily_counts(stream, delay="14 days"))  # final days only, and within the delay nothing is late
    assert one.count() == 0

"""Reading and writing the pipeline's formats. Binary object streams of other tools become Parquet tables here."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from burstframe.functions import text as tx

MIN_LINE = 20
#: Fields of the format, in its order.
TWEET_DDL = (
    "id_str STRING, text STRING, created_at STRING, retweet_count BIGINT, retweeted BOOLEAN, favorited BOOLEAN, in_reply_to_status_id_str STRING, lang STRING, "
    "entities STRUCT<user_mentions: ARRAY<STRUCT<screen_name: STRING>>, hashtags: ARRAY<STRUCT<text: STRING>>, urls: ARRAY<STRUCT<url: STRING>>, symbols: ARRAY<STRUCT<text: STRING>>>, "
    "user STRUCT<id_str: STRING, screen_name: STRING, name: STRING, description: STRING, created_at: STRING, location: STRING, lang: STRING, "
    "statuses_count: BIGINT, favourites_count: BIGINT, listed_count: BIGINT, friends_count: BIGINT, followers_count: BIGINT>"
)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files. Line numbers are counted within each file, so a file is read by one task; where
    only the first line matters, data_lines reads large files in parts."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files without the first line of each. Files are split as the reader sees fit: the first line of
    a file is the first of the part that begins at its start, so no part needs to know of the others."""
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            names, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for place in zip(names, starts, strict=True):
                kept.append(place == seen or place[1] != 0)
                seen = place
            yield batch.select([0, 2]).filter(pa.array(kept, pa.bool_()))

    return parts.mapInArrow(run, "path STRING, line STRING")


def day_lines(spark: SparkSession, path: str, days: list[str], prefix: str = "") -> DataFrame:
    """(path, line_no, line) of the text files of a folder whose names begin with the prefix and end in one of the days.
    Other files are not opened."""
    wanted = f"{prefix}*{{{','.join(sorted(set(days)))}}}"
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=wanted).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def read_days(spark: SparkSession, path: str, days: list[str], day: str = "day") -> DataFrame:
    """The rows of some days of a table that write_by_day wrote, days as they were written; folders of other days are not
    opened."""
    each = [spark.read.parquet(f"{path}/{day}={x}").withColumn(day, F.lit(x)) for x in sorted(set(days))]
    return reduce(DataFrame.unionByName, each)


def json_lines(lines: DataFrame, min_line: int = MIN_LINE) -> DataFrame:
    """Tweets of (day, line_no, line): without each day's first line, short lines, malformed ones and those without id_str.

    The length test comes before the parser. Fields of another type than expected are null.
    """
    parsed = F.from_json("line", TWEET_DDL + ", broken STRING", {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"})
    rows = lines.where((F.col("line_no") > 0) & (F.length("line") >= min_line)).select("day", "line_no", parsed.alias("t"))
    return rows.where("t.id_str IS NOT NULL").select("day", "line_no", "t.*").drop("broken")


def unescape(line: Column) -> Column:
    """Doubled backslashes of a line that was escaped twice."""
    return F.replace(line, F.lit("\\\\"), F.lit("\\"))


def tweet_projection(tweets: DataFrame) -> DataFrame:
    """The 13 flat fields of a tweet."""
    return tweets.where("id_str IS NOT NULL").select(
        "id_str", F.col("user.id_str").alias("user_id_str"), "text", "created_at",
        F.col("entities.user_mentions.screen_name").alias("user_mentions"), F.col("entities.hashtags.text").alias("hashtags"),
        F.col("entities.urls.url").alias("urls"), "retweet_count", "retweeted", "favorited", "in_reply_to_status_id_str", "lang",
        F.col("entities.symbols.text").alias("symbols"),
    )


def user_projection(tweets: DataFrame) -> DataFrame:
    """The 12 fields of each tweet's user, for tweets that have one."""
    return tweets.where("user IS NOT NULL AND user.id_str IS NOT NULL").select("user.*")


def tsv(lines: DataFrame, column: str = "line") -> DataFrame:
    """(id, text): first and last field of lines with two fields or more."""
    parts = F.split(F.col(column), "\t")
    return lines.where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).alias("id"), F.element_at(parts, -1).alias("text"))


def pairs(lines: DataFrame, separator: str = " ", column: str = "line") -> DataFrame:
    """(key, value) of dictionary lines; blank lines are skipped."""
    parts = F.split(F.trim(F.col(column)), separator, 2)
    return lines.where(F.length(F.trim(F.col(column))) > 0).select(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def tagged(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.where(F.length(F.trim(F.col(column))) > 0).withColumn("tokens", tx.split_tagged(F.trim(F.col(column))))


def chunk_spans(lines: DataFrame, column: str = "line") -> DataFrame:
    """spans (st, ed) of bracketed text: tokens without / are brackets, a final ] may stick to the last tag.

    A bracket at place p after k brackets stands before token p - k. Brackets without a partner are left out.
    """
    parts = F.split(F.regexp_replace(F.trim(F.col(column)), r"(/[^\s\]]+)\]$", "$1 ]"), r"\s+")
    places = F.filter(F.transform(parts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~F.contains(x.t, F.lit("/")))
    at = F.transform(places, lambda x, k: F.struct(x.t.alias("t"), (x.i - k).alias("at")))
    spans = F.transform(
        F.filter(F.transform(at, lambda x, k: F.struct(x.t.alias("t"), x["at"].alias("st"), F.get(at, k + 1).alias("next"))), lambda x: (x.t == "[") & (x.next.t == "]")),
        lambda x: F.struct(x.st.alias("st"), (x.next["at"] - 1).alias("ed")),
    )
    return lines.withColumn("spans", spans)


def corpus_from_paths(spark: SparkSession, path: str) -> DataFrame:
    """(domain, lang, doc, text) of files at domain/lang/doc."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), "value")
    return files.select(F.element_at("p", -3).alias("domain"), F.element_at("p", -2).alias("lang"), F.element_at("p", -1).alias("doc"), F.col("value").alias("text"))


def corpus_from_list(spark: SparkSession, list_path: str) -> DataFrame:
    """(domain, lang, doc, text) of the files that a text file names, one path a line; blank lines are skipped. The paths
    are read by the driver, as any list of files to open is."""
    paths = [r.value.strip() for r in spark.read.text(list_path).where("trim(value) <> ''").distinct().toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "domain string, lang string, doc string, text string")
    files = spark.read.text(paths, wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), "value")
    return files.select(F.element_at("p", -3).alias("domain"), F.element_at("p", -2).alias("lang"), F.element_at("p", -1).alias("doc"), F.col("value").alias("text"))


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """Each line of a text as a document of its own; blank lines are left out."""
    rows = corpus.select("domain", "lang", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.where(F.length(F.trim("text")) > 0).select("domain", "lang", F.concat_ws("#", "doc", F.col("line_no").cast("string")).alias("doc"), "text")


def write_by_day(df: DataFrame, path: str, day: str = "day") -> None:
    """One directory for each day; rows of a day are gathered by several tasks, so that none holds a whole hot day."""
    df.write.mode("overwrite").partitionBy(day).parquet(path)


def write_lines(df: DataFrame, path: str, *columns: str, order: tuple[str, ...] = ()) -> None:
    """Tab-separated text, in order if one is given."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_feature_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A set of tables that belong together, each in a folder of its name."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_df(df: DataFrame, sizes: DataFrame, path: str) -> None:
    """Document frequencies (unit, df) as text in the order of units, after a header line with the totals of the days:
    # and day:n for each. sizes has a row for each day."""
    days = F.array_sort(F.collect_list(F.concat_ws(":", "day", F.col("n_tweets").cast("string"))))
    header = sizes.agg(F.concat(F.lit("#\t"), F.array_join(days, " ")).alias("value")).select(F.lit("").alias("unit"), "value")
    rows = df.select("unit", F.concat_ws("\t", "unit", F.col("df").cast("string")).alias("value"))
    header.withColumn("k", F.lit(0)).unionByName(rows.withColumn("k", F.lit(1))).orderBy("k", "unit").select("value").write.mode("overwrite").text(path)


def read_df(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unit, df) and (day, n_tweets) of what write_df wrote."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    days = parts.where("p[0] = '#'").select(F.explode(F.split(F.get("p", F.lit(1)), " ")).alias("d")).where("d <> ''")
    sizes = days.select(F.substring_index("d", ":", 1).alias("day"), F.substring_index("d", ":", -1).cast("bigint").alias("n_tweets"))
    return parts.where("p[0] <> '#'").select(F.get("p", F.lit(0)).alias("unit"), F.get("p", F.lit(1)).cast("bigint").alias("df")), sizes


def write_counts(counts: DataFrame, path: str) -> None:
    """(class, n) numbered in the order of classes, as CSV: the index of a corpus. Classes do not grow with the corpus."""
    ids = F.row_number().over(W.orderBy("class")) - 1
    counts.select("class", "n").withColumn("id", ids).select("id", "class", "n").orderBy("id").coalesce(1).write.mode("overwrite").csv(path)


def write_weights(df: DataFrame, path: str, by_weight: bool = False) -> None:
    """(term, weight) as CSV, in order of terms or of falling weights; a weight may be an array, one column each."""
    kind = df.schema["weight"].dataType
    if isinstance(kind, ArrayType):
        width = df.agg(F.max(F.size("weight"))).first()[0] or 0
        columns = [F.get("weight", F.lit(i)).alias(f"w{i}") for i in range(width)]
    else:
        columns = [F.col("weight")]
    rows = df.orderBy(F.desc("weight"), "term") if by_weight else df.orderBy("term")
    rows.select("term", *columns).write.mode("overwrite").csv(path)


def write_features(features: DataFrame, path: str) -> None:
    """One term a line, in order."""
    write_lines(features, path, "term", order=("term",))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("term")).distinct()


def write_id_text(df: DataFrame, path: str, key: str, text: str) -> None:
    """Two sets of text files, ids and texts, that agree line by line: both are written from one ordered table. Line breaks
    in texts become spaces."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ").alias("t")).orderBy("k", "t")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").orderBy("k", "t")
    stored.select(F.col("k").alias("value")).write.mode("overwrite").text(f"{path}/ids")
    stored.select(F.col("t").alias("value")).write.mode("overwrite").text(f"{path}/texts")


def read_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(term, weight ARRAY<DOUBLE>); nan counts as 0."""
    rows = spark.read.schema(", ".join(["term STRING", *(f"w{i} DOUBLE" for i in range(width))])).csv(path)
    return rows.select("term", F.array(*(F.nanvl(f"w{i}", F.lit(0.0)) for i in range(width))).alias("weight"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight); nan counts as 0."""
    rows = spark.read.schema("term STRING, weight DOUBLE").csv(path)
    return rows.select("term", F.nanvl("weight", F.lit(0.0)).alias("weight"))

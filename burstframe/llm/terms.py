"""Term statistics of a collection: counts of every distinct term, and how distinctive a term is of its record.

Terms are the pieces of the lower-cased text between spaces, tabs, line feeds and carriage returns, without leading
and trailing ASCII punctuation. A record is one id; its rows repeat text and entities, and where they differ the
greatest value counts. Null texts are no records; empty texts are records without terms; null ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstframe.session import cut

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RARE_RECORDS = 2
COMMON_SHARE = 0.1
#: Size of the prior, as a multiple of the collection's own counts.
PRIOR_WEIGHT = 0.3
#: A term that makes up at least this share of all occurrences is joined by broadcast: at most 1 / HOT_SHARE terms are
#: that frequent, however large the collection is.
HOT_SHARE = 0.001


def terms(text: Column) -> Column:
    pieces = F.split(F.lower(text), "[ \\t\\n\\r]")
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(PUNCTUATION))), lambda p: p != "")


def tweet_records(raw: DataFrame) -> DataFrame:
    """One row per id_str: its text, and the texts of its hashtags."""
    return (
        raw.where(F.col("id_str").isNotNull())
        .groupBy("id_str")
        .agg(F.max("text").alias("text"), F.max(F.col("entities.hashtags.text")).alias("hashtags"))
    )


def _tags(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t.isNotNull() & (t != "")), lambda t: F.lower(t))


def _counted(listed: Column) -> Column:
    """(term, tf) of each distinct term of an array, by its runs in sorted order."""
    places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda s, p: F.transform(p, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s)) - at).alias("tf")))
    none = F.array().cast("array<struct<term: string, tf: int>>")
    # transform over a one-element array binds the sorted terms, and then the places, to a name, so that each is worked out once
    bound = F.transform(F.array(F.array_sort(listed)), lambda s: F.transform(F.array(places(s)), lambda p: runs(s, p)))
    return F.when(F.size(listed) > 0, F.get(F.get(bound, F.lit(0)), F.lit(0))).otherwise(none)


def term_fields(records: DataFrame) -> DataFrame:
    """(id, field, counts): the terms of each record and of each field that it belongs to, as an array of (term, tf)."""
    fields = F.array(
        F.struct(F.lit("text").alias("field"), terms(F.col("text")).alias("terms")),
        F.struct(F.lit("hashtags").alias("field"), _tags(F.col("hashtags")).alias("terms")),
    )
    rows = records.select(F.col("id_str").alias("id"), F.inline(fields))
    rows = rows.where(F.col("terms").isNotNull() & ((F.col("field") == "text") | (F.size("terms") > 0)))
    return rows.select("id", "field", _counted(F.col("terms")).alias("counts"))


def field_sizes(records: DataFrame) -> DataFrame:
    """(field, total): the records of each field; no term is made for it."""
    tagged = F.size(_tags(F.col("hashtags"))) > 0
    one = records.agg(F.count_if(F.col("text").isNotNull()).alias("text"), F.count_if(F.coalesce(tagged, F.lit(False))).alias("hashtags"))
    pairs = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("total")), F.struct(F.lit("hashtags").alias("field"), F.col("hashtags").alias("total")))
    return one.select(F.inline(pairs))


def term_counts(fields: DataFrame) -> DataFrame:
    """(field, term, n_occurrences, n_records): sums of the per-record counts, combined by hash before the shuffle."""
    return (
        fields.select("field", F.inline("counts"))
        .groupBy("field", "term")
        .agg(F.sum("tf").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    )


def marked_terms(records: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """term_counts with mark: rare in at most `rare` records, else common from a share `common` of them, else null.

    A term that is both (in a tiny collection) has a row for either mark. An empty collection gives no rows.
    """
    marks = F.filter(
        F.array(
            F.when(F.col("n_records") <= rare, "rare"),
            F.when(F.col("n_records") >= common * F.col("total"), "common"),
        ),
        lambda m: m.isNotNull(),
    )
    return (
        term_counts(term_fields(records))
        .join(F.broadcast(field_sizes(records)), "field")  # one row per field
        .select("field", "term", "n_occurrences", "n_records", F.explode_outer(marks).alias("mark"))
    )


def z_score(tf: Column, length: Column, held: Column, total: Column, weight: float = PRIOR_WEIGHT) -> Column:
    """Log-odds of a term in the record against the rest, over its standard error.

    tf and length count occurrences in the record, held and total those in the whole collection, so held - tf and
    total - length are the rest. The Dirichlet prior is informative: the collection's counts times `weight`.
    """
    prior, priors = held * weight, total * weight
    inside = F.ln((tf + prior) / (length + priors - tf - prior))
    outside = F.ln((held - tf + prior) / (total - length + priors - held + tf - prior))
    return (inside - outside) / F.sqrt(1 / (tf + prior) + 1 / (held - tf + prior))


def term_scores(fields: DataFrame, asked: DataFrame | None = None, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """(id, term, tf, n_occurrences, n_records, z) of every term of every text, or of the records in `asked` (column id)
    only; z is null where the collection has no other term.

    Counts always cover the whole collection. Records without terms give no rows; repeated ids in `asked` count once.
    """
    texts = cut(fields.where("field = 'text'"))  # read by the counts, the total and the records themselves
    counts = term_counts(texts).select("term", "n_occurrences", "n_records")
    totals = texts.select(F.aggregate("counts", F.lit(0).cast("bigint"), lambda n, c: n + c.tf).alias("length")).agg(F.sum("length").cast("double").alias("total"))
    own = texts if asked is None else texts.join(asked.select("id").distinct(), "id", "left_semi")
    length = F.aggregate("counts", F.lit(0.0), lambda n, c: n + c.tf)
    own = own.select("id", length.alias("length"), F.inline("counts"))
    known = counts.crossJoin(F.broadcast(totals))  # totals is one row
    hot = F.col("n_occurrences") >= HOT_SHARE * F.col("total")
    wide = own.join(F.broadcast(known.where(hot)), "term", "left")
    cold = wide.where("n_records IS NULL").drop("n_occurrences", "n_records", "total").join(known.where(~hot), "term")
    scored = wide.where("n_records IS NOT NULL").unionByName(cold)
    z = z_score(F.col("tf").cast("double"), F.col("length"), F.col("n_occurrences").cast("double"), F.col("total"), weight)
    z = F.when(F.col("n_occurrences") < F.col("total"), z)
    return scored.select("id", "term", "tf", "n_occurrences", "n_records", z.alias("z"))


def most_distinctive(scores: DataFrame) -> DataFrame:
    """(id, term): the term with the highest z of each record; of equal ones the smallest, and any before those without z."""
    best = F.min_by(F.col("term"), F.struct(F.coalesce(-F.col("z"), F.lit(float("inf"))).alias("z"), F.col("term")))
    return scores.groupBy("id").agg(best.alias("term"))

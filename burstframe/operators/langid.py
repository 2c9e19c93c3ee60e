"""Training of a language identifier: n-grams, document frequencies, information gain, feature choice, naive Bayes.

A corpus is (doc, domain, lang, text), one row a document. Terms are byte n-grams (BINARY) or words (STRING). Postings
are (term, class, n). Class counts (languages, domains) do not grow with the corpus and are broadcast; so are feature
sets, whose size the parameters bound. Documents with a null text or class have no terms; empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ORDER, TOKENS_PER_ORDER, FEATURES_PER_LANG, SAMPLE_SIZE = 4, 15000, 300, 140
Tokenizer = Callable[[Column], Column]


def byte_ngrams(text: Column, low: int = 1, high: int = MAX_ORDER) -> Column:
    """All byte n-grams of orders low to high at every position, the shorter ones of the end included; none for a text of
    fewer than high - 1 bytes."""
    b = F.encode(text, "UTF-8")
    n = F.octet_length(b)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    orders = F.sequence(F.lit(low), F.lit(high))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(orders, lambda k: i + k - 1 <= n), lambda k: F.substring(b, i, k))))
    return F.when((n >= max(1, high - 1)), grams).otherwise(F.array().cast("array<binary>"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_ngrams(text: Column, low: int = 1, high: int = 3, separator: str = " ") -> Column:
    """Word n-grams of orders low to high at the positions where the longest fits; the end has no shorter ones."""
    w = words(text)
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - high + 1, F.lit(1)))
    orders = F.sequence(F.lit(low), F.lit(high))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(orders, lambda k: F.array_join(F.slice(w, i, k), separator))))
    return F.when(n >= high, grams).otherwise(F.array().cast("array<string>"))


def sampled(text: Column, count: int, size: int = SAMPLE_SIZE, seed: int = 0) -> Column:
    """`count` pieces of `size` characters from places drawn by a hash of the text."""
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", text, k.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    places = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: (drawn(k) % F.greatest(F.length(text) - size + 1, F.lit(1))).cast("int") + 1)
    return F.transform(places, lambda p: F.substring(text, p, F.lit(size)))


def index(corpus: DataFrame, langs: list[str] | None = None, domains: list[str] | None = None, min_domain: int = 1, proportion: float = 1.0, seed: int = 0) -> DataFrame:
    """The corpus with whitelists, a Bernoulli sample, and only languages that min_domain domains or more cover."""
    kept = corpus.where("doc IS NOT NULL AND lang IS NOT NULL AND domain IS NOT NULL AND text IS NOT NULL")
    if langs is not None:
        kept = kept.where(F.col("lang").isin(langs))
    if domains is not None:
        kept = kept.where(F.col("domain").isin(domains))
    if proportion < 1:
        kept = kept.sample(proportion, seed)
    return kept.join(F.broadcast(coverage(kept).where(F.col("n_domains") >= min_domain).select("lang")), "lang", "left_semi")


def coverage(corpus: DataFrame) -> DataFrame:
    """(lang, n_domains)."""
    return corpus.groupBy("lang").agg(F.countDistinct("domain").alias("n_domains"))


def class_sizes(corpus: DataFrame, column: str) -> DataFrame:
    """(class, n_docs)."""
    return corpus.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n_docs"))


def postings(corpus: DataFrame, column: str, tokenizer: Tokenizer = byte_ngrams, term_frequency: bool = False, features: DataFrame | None = None) -> DataFrame:
    """(term, class, n): documents of the class with the term, or occurrences. Counts are combined before the shuffle."""
    terms = tokenizer(F.col("text"))
    rows = corpus.where(F.col(column).isNotNull()).select(F.col(column).alias("class"), F.explode(terms if term_frequency else F.array_distinct(terms)).alias("term"))
    if features is not None:
        rows = rows.join(F.broadcast(features.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", "class").agg(F.count(F.lit(1)).alias("n"))


def term_df(posted: DataFrame) -> DataFrame:
    """(term, df): summed over the classes."""
    return posted.groupBy("term").agg(F.sum("n").alias("df"))


def _best(rows: DataFrame, groups: list[str], order: list[Column], n: int, parts: int = 32) -> DataFrame:
    """The first n rows of each group. They are ranked in `parts` parts by the hash of the term first, so that no task sorts
    a whole group; the best of all parts are at most `parts` times the result."""
    rank = lambda *by: F.row_number().over(W.partitionBy(*groups, *by).orderBy(*order))
    kept = rows.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts))).withColumn("_rank", rank("_part")).where(F.col("_rank") <= n)
    return kept.withColumn("_rank", rank()).where(F.col("_rank") <= n).drop("_rank", "_part")


def select_df(df: DataFrame, per_order: int = TOKENS_PER_ORDER, by_order: bool = True) -> DataFrame:
    """(term, df): the most frequent terms of each length, or of all; equal ones by term."""
    order = [F.desc("df"), F.asc("term")]
    if not by_order:
        return df.orderBy(*order).limit(per_order)
    return _best(df.withColumn("_length", F.length("term")), ["_length"], order, per_order).drop("_length")


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)


def entropy(total: Column, sum_xlogx: Column) -> Column:
    """Of counts with this total and sum of x ln x; 0 if there are none."""
    return F.when(total > 0, F.ln(total.cast("double")) - sum_xlogx / total).otherwise(0.0)


def gain_all(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, ig): information gain of a term's presence about all classes."""
    totals = sizes.agg(F.sum("n_docs").alias("n_all"), F.sum(xlogx(F.col("n_docs"))).alias("x_all"))  # one row
    joined = posted.join(F.broadcast(sizes), "class")
    # Classes without the term have all their documents in the absent cell: the sum over all classes, less that of the present ones.
    cells = joined.groupBy("term").agg(
        F.sum("n").alias("pos"), F.sum(xlogx(F.col("n"))).alias("x_pos"), F.sum(xlogx(F.col("n_docs") - F.col("n")) - xlogx(F.col("n_docs"))).alias("x_diff")
    )
    cells = cells.crossJoin(F.broadcast(totals)).withColumn("neg", F.col("n_all") - F.col("pos")).withColumn("x_neg", F.col("x_all") + F.col("x_diff"))
    before = entropy(F.col("n_all"), F.col("x_all"))
    after = (F.col("pos") * entropy(F.col("pos"), F.col("x_pos")) + F.col("neg") * entropy(F.col("neg"), F.col("x_neg"))) / F.col("n_all")
    return cells.select("term", (before - after).alias("ig"))


def _two(a: Column, b: Column) -> Column:
    return entropy(a + b, xlogx(a) + xlogx(b))


def gain_each(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, class, ig): information gain about one class against the rest, for every class, also those without the term."""
    total = sizes.agg(F.sum("n_docs").alias("n_all"))
    grid = term_df(posted).crossJoin(F.broadcast(sizes.crossJoin(F.broadcast(total))))  # every term with each of the few classes
    cells = grid.join(posted, ["term", "class"], "left").withColumn("a", F.coalesce("n", F.lit(0)))
    a, n_class, n_all = F.col("a"), F.col("n_docs"), F.col("n_all")
    b, c = F.col("df") - a, n_class - a
    d = n_all - n_class - b
    ig = _two(n_class, n_all - n_class) - ((a + b) * _two(a, b) + (c + d) * _two(c, d)) / n_all
    return cells.select("term", "class", ig.alias("ig"))


def language_domain_weights(lang_gain: DataFrame, domain_gain: DataFrame | None) -> DataFrame:
    """(term, class, ld): the gain about a language less that about all domains; without domains the gain itself."""
    if domain_gain is None:
        return lang_gain.withColumnRenamed("ig", "ld")
    return lang_gain.join(domain_gain.withColumnRenamed("ig", "ig_domain"), "term").select("term", "class", (F.col("ig") - F.col("ig_domain")).alias("ld"))


def select_ld(weights: DataFrame, per_class: int = FEATURES_PER_LANG) -> DataFrame:
    """(term), distinct: the best terms of each class, equal ones by term. Weights are compared to 12 decimals, so that
    the order of a sum cannot decide."""
    return _best(weights, ["class"], [F.desc(F.round("ld", 12)), F.asc("term")], per_class).select("term").distinct()


def matches(corpus: DataFrame, features: DataFrame, tokenizer: Tokenizer = byte_ngrams) -> DataFrame:
    """(doc_key, term, tf): all occurrences, overlapping ones too, of the features in each text. doc_key is any column of
    that name, a document's key."""
    rows = corpus.select("doc_key", F.explode(tokenizer(F.col("text"))).alias("term"))
    return rows.join(F.broadcast(features.select("term").distinct()), "term", "left_semi").groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("tf"))


def bayes_prior(corpus: DataFrame) -> DataFrame:
    """(lang, logp): ln of the number of documents, not normalized."""
    return class_sizes(corpus, "lang").select(F.col("class").alias("lang"), F.ln(F.col("n_docs").cast("double")).alias("logp"))


def bayes_likelihood(counts: DataFrame, features: DataFrame, langs: DataFrame) -> DataFrame:
    """(term, lang, logp): ln((1 + n) / (number of features + all n of the language)) for every feature and language.

    counts is (term, class, n) by occurrence.
    """
    distinct = features.select("term").distinct()
    grid = distinct.crossJoin(F.broadcast(langs.select("lang"))).join(counts.withColumnRenamed("class", "lang"), ["term", "lang"], "left")
    grid = grid.select("term", "lang", F.coalesce("n", F.lit(0)).alias("n"))
    sums = grid.groupBy("lang").agg(F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("all"))
    joined = grid.join(F.broadcast(sums), "lang")
    return joined.select("term", "lang", (F.ln(1.0 + F.col("n")) - F.ln((F.col("n_features") + F.col("all")).cast("double"))).alias("logp"))


def classify(texts: DataFrame, prior: DataFrame, likelihood: DataFrame, tokenizer: Tokenizer = byte_ngrams) -> DataFrame:
    """(doc_key, lang, confidence) of each row of (doc_key, text): the language of the highest sum of prior and weighted
    likelihoods, equal ones by name, with its share of the languages. A text without features has the prior's. The model
    is bounded by the number of features and is broadcast: terms that are no features never leave their task, and what is
    shuffled is one sum for each text and language."""
    by_term = likelihood.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("lang", "logp"))).alias("langs"))
    rows = texts.select("doc_key", F.explode(tokenizer(F.col("text"))).alias("term")).join(F.broadcast(by_term), "term")
    sums = rows.select("doc_key", F.inline("langs")).groupBy("doc_key", "lang").agg(F.sum("logp").alias("s"))
    grid = texts.select("doc_key").distinct().crossJoin(F.broadcast(prior))  # each text with the few languages
    scored = grid.join(sums, ["doc_key", "lang"], "left").withColumn("score", F.round(F.col("logp") + F.coalesce("s", F.lit(0.0)), 9))
    best = scored.groupBy("doc_key").agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("best"), F.max("score").alias("top"))
    share = scored.join(best, "doc_key").groupBy("doc_key", "best").agg((1 / F.sum(F.exp(F.col("score") - F.col("top")))).alias("confidence"))
    return share.select("doc_key", F.col("best").alias("lang"), "confidence")


def in_language(texts: DataFrame, classified: DataFrame, langs: list[str]) -> DataFrame:
    return texts.join(classified.where(F.col("lang").isin(langs)).select("doc_key"), "doc_key", "left_semi")


def english_tweets(tweets: DataFrame, share: float = 0.8) -> DataFrame:
    """Tweets labelled en, or of whose words the share or more is classified so: (lang, words ARRAY<STRUCT<word, lang>>)."""
    words_en = F.size(F.filter("words", lambda w: w.lang == "en"))
    return tweets.where((F.col("lang") == "en") | ((F.size("words") > 0) & (words_en >= share * F.size("words"))))


def softmax_terms(likelihood: DataFrame) -> DataFrame:
    """(term, lang, p): exp of the log-probabilities, summing to 1 in each language."""
    sums = likelihood.groupBy("lang").agg(F.sum(F.exp("logp")).alias("z"))
    return likelihood.join(F.broadcast(sums), "lang").select("term", "lang", (F.exp("logp") / F.col("z")).alias("p"))


def pair_weights(probabilities: DataFrame, normalized: bool = True) -> DataFrame:
    """(lang1, lang2, term, weight), lang1 < lang2: the difference of a term's probabilities, over their sum in all
    languages if normalized."""
    total = F.sum("p").over(W.partitionBy("term"))
    p = probabilities.withColumn("all", total)
    a = p.select("term", "all", F.col("lang").alias("lang1"), F.col("p").alias("p1"))
    b = p.select("term", F.col("lang").alias("lang2"), F.col("p").alias("p2"))
    weight = F.abs(F.col("p1") - F.col("p2")) / (F.col("all") if normalized else F.lit(1.0))
    return a.join(b, "term").where("lang1 < lang2").select("lang1", "lang2", "term", weight.alias("weight"))


def feature_table(features: DataFrame, df: DataFrame, lang_gain: DataFrame, domain_gain: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(term, length, df, ig_domain, ig_lang, by_lang): what is known of each feature; ig_lang is the most over languages,
    by_lang an array of (lang, ig, p)."""
    each = lang_gain.withColumnRenamed("class", "lang").join(probabilities, ["term", "lang"], "left")
    each = each.groupBy("term").agg(F.max("ig").alias("ig_lang"), F.array_sort(F.collect_list(F.struct("lang", "ig", "p"))).alias("by_lang"))
    out = features.select("term").distinct().join(df, "term").join(domain_gain.withColumnRenamed("ig", "ig_domain"), "term").join(each, "term")
    return out.select("term", F.length("term").alias("length"), "df", "ig_domain", "ig_lang", "by_lang")


def train(
    corpus: DataFrame, tokenizer: Tokenizer = byte_ngrams, per_order: int = TOKENS_PER_ORDER, per_lang: int = FEATURES_PER_LANG, use_domains: bool = True,
    features: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, prior, likelihood): the whole course from an indexed corpus; features may be given instead of chosen."""
    if features is None:
        domains = postings(corpus, "domain", tokenizer)
        candidates = select_df(term_df(domains), per_order)
        lang_gain = gain_each(postings(corpus, "lang", tokenizer, features=candidates), class_sizes(corpus, "lang"))
        domain_gain = gain_all(domains.join(candidates.select("term"), "term", "left_semi"), class_sizes(corpus, "domain")) if use_domains else None
        features = select_ld(language_domain_weights(lang_gain, domain_gain), per_lang)
    prior = bayes_prior(corpus)
    counts = postings(corpus, "lang", tokenizer, term_frequency=True, features=features)
    return features, prior, bayes_likelihood(counts, features, prior)


def merge_postings(*posted: DataFrame) -> DataFrame:
    """(term, class, n) of several tables of postings together, as of the parts of a corpus."""
    every = posted[0].select("term", "class", "n")
    for more in posted[1:]:
        every = every.unionByName(more.select("term", "class", "n"))
    return every.groupBy("term", "class").agg(F.sum("n").alias("n"))


def items(corpus: DataFrame) -> DataFrame:
    """(domain, lang, doc), distinct."""
    return corpus.select("domain", "lang", "doc").distinct()


def save_model(path: str, features: DataFrame, prior: DataFrame, likelihood: DataFrame) -> None:
    """The trained model as three tables under a folder."""
    for name, table in (("features", features), ("prior", prior), ("likelihood", likelihood)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, prior, likelihood) as save_model wrote them, as classify takes them."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("features", "prior", "likelihood"))  # type: ignore[return-value]

"""Queries of the language-identification trainer on the labelled corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.operators import langid as li
from burstframe.plans.tweets import FIRST, first_rows
from burstframe.session import cut, table

ORDERS, PER_ORDER, PER_LANG = li.MAX_ORDER, li.TOKENS_PER_ORDER, li.FEATURES_PER_LANG


def grams(text: Column) -> Column:
    return li.byte_ngrams(text, 1, ORDERS)


@dataclass
class Training:
    """The steps of the training. The corpus is of fixed size; tables that several steps read are written once."""

    spark: SparkSession
    d: str

    @cached_property
    def corpus(self) -> DataFrame:
        """Spread over all cores: the file is small and a text has four n-grams for each of its bytes."""
        return cut(li.index(table(self.spark, self.d, "corpus_item")).repartition(self.spark.sparkContext.defaultParallelism))

    @cached_property
    def domains(self) -> DataFrame:
        return cut(li.postings(self.corpus, "domain", grams))

    @cached_property
    def candidates(self) -> DataFrame:
        return cut(li.select_df(li.term_df(self.domains), PER_ORDER))

    @cached_property
    def lang_gain(self) -> DataFrame:
        return cut(li.gain_each(li.postings(self.corpus, "lang", grams, features=self.candidates), li.class_sizes(self.corpus, "lang")))

    @cached_property
    def domain_gain(self) -> DataFrame:
        return li.gain_all(self.domains.join(F.broadcast(self.candidates.select("term")), "term", "left_semi"), li.class_sizes(self.corpus, "domain"))

    @cached_property
    def features(self) -> DataFrame:
        return cut(li.select_ld(li.language_domain_weights(self.lang_gain, self.domain_gain), PER_LANG))

    @cached_property
    def prior(self) -> DataFrame:
        return li.bayes_prior(self.corpus)

    @cached_property
    def likelihood(self) -> DataFrame:
        return cut(li.bayes_likelihood(li.postings(self.corpus, "lang", grams, term_frequency=True, features=self.features), self.features, self.prior))


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("term", F.lower(F.hex("term")))


def lang_coverage(spark: SparkSession, d: str) -> DataFrame:
    return li.coverage(table(spark, d, "corpus_item"))


def lang_dist(spark: SparkSession, d: str) -> DataFrame:
    c = Training(spark, d).corpus
    by = [li.class_sizes(c, k).select(F.lit(k).alias("kind"), "class", "n_docs") for k in ("lang", "domain")]
    return by[0].unionByName(by[1])


def min_domain_prune(spark: SparkSession, d: str) -> DataFrame:
    """Documents of languages that four domains or more of the chosen ones cover."""
    return li.index(table(spark, d, "corpus_item"), domains=["news", "forum", "wiki", "chat"], min_domain=4).select("domain", "lang", "doc")


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    from burstframe.sources.readers import corpus_lines as lines

    return lines(table(spark, d, "corpus_item").withColumn("text", F.regexp_replace("text", r"([.!?]) ", "$1\n"))).select("domain", "lang", "doc", F.length("text").alias("n_chars"))


def ngram_df(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).domains)


def ngram_tf(spark: SparkSession, d: str) -> DataFrame:
    return _hex(li.postings(Training(spark, d).corpus, "lang", grams, term_frequency=True))


def word_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return li.postings(Training(spark, d).corpus, "lang", li.word_ngrams)


def word_df(spark: SparkSession, d: str) -> DataFrame:
    return li.postings(Training(spark, d).corpus, "lang", li.words)


def sampled_df(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies in drawn pieces of each text."""
    c = Training(spark, d).corpus
    pieces = c.select("doc", "domain", "lang", F.explode(li.sampled(F.col("text"), 2)).alias("text"))
    return _hex(li.postings(pieces, "lang", grams))


def df_select(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).candidates)


def df_select_all(spark: SparkSession, d: str) -> DataFrame:
    return _hex(li.select_df(li.term_df(Training(spark, d).domains), PER_ORDER, by_order=False))


def ig_domain(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).domain_gain).withColumn("ig", F.round("ig", 8))


def ig_lang_bin(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).lang_gain).withColumn("ig", F.round("ig", 8))


def ld_select(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).features)


def nb_prior(spark: SparkSession, d: str) -> DataFrame:
    return Training(spark, d).prior.withColumn("logp", F.round("logp", 8))


def nb_ptc(spark: SparkSession, d: str) -> DataFrame:
    return _hex(Training(spark, d).likelihood).withColumn("logp", F.round("logp", 8))


def nb_classify(spark: SparkSession, d: str) -> DataFrame:
    """The labelled texts, classified."""
    t = Training(spark, d)
    texts = t.corpus.select(F.concat_ws("/", "domain", "lang", "doc").alias("doc_key"), "text")
    return li.classify(texts, t.prior, t.likelihood, grams).select("doc_key", "lang")


def language_texts(spark: SparkSession, d: str) -> DataFrame:
    """The labelled texts that are classified as one of two languages."""
    t = Training(spark, d)
    texts = t.corpus.select(F.concat_ws("/", "domain", "lang", "doc").alias("doc_key"), "text")
    return li.in_language(texts, li.classify(texts, t.prior, t.likelihood, grams), ["en", "ru"]).select("doc_key")


def trained_model(spark: SparkSession, d: str) -> DataFrame:
    """The likelihoods of the whole course in one call."""
    _, _, likelihood = li.train(Training(spark, d).corpus, grams)
    return _hex(likelihood).withColumn("logp", F.round("logp", 8))


def tweet_languages(spark: SparkSession, d: str) -> DataFrame:
    """All tweets with a text, classified."""
    t = Training(spark, d)
    texts = first_rows(table(spark, d, "raw_tweet")).where("text IS NOT NULL").select(F.col("id_str").alias("doc_key"), "text")
    return li.classify(texts, t.prior, t.likelihood, grams).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def english_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tweets labelled en, or of whose words four fifths or more are classified so."""
    t = Training(spark, d)
    tweets = first_rows(table(spark, d, "raw_tweet")).where("text IS NOT NULL").select("id_str", "lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("tokens"))
    words = tweets.select(F.explode("tokens").alias("doc_key")).distinct().withColumn("text", F.col("doc_key"))
    known = li.classify(words, t.prior, t.likelihood, grams).select(F.col("doc_key").alias("word"), F.col("lang").alias("word_lang"))
    read = tweets.select("id_str", F.explode("tokens").alias("word")).join(known, "word").groupBy("id_str").agg(F.collect_list(F.struct("word", F.col("word_lang").alias("lang"))).alias("words"))
    return li.english_tweets(tweets.join(read, "id_str", "left").select("id_str", "lang", F.coalesce("words", F.array().cast("array<struct<word: string, lang: string>>")).alias("words"))).select("id_str")


def bl_weights(spark: SparkSession, d: str) -> DataFrame:
    return _hex(li.pair_weights(li.softmax_terms(Training(spark, d).likelihood))).withColumn("weight", F.round("weight", 8))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    t = Training(spark, d)
    df = li.feature_table(t.features, li.term_df(t.domains), t.lang_gain, t.domain_gain, li.softmax_terms(t.likelihood))
    return _hex(df).select("term", "length", "df", F.round("ig_domain", 8).alias("ig_domain"), F.round("ig_lang", 8).alias("ig_lang"), F.size("by_lang").alias("n_langs"))


def top_features(spark: SparkSession, d: str) -> DataFrame:
    from burstframe.operators.stats import top_rows

    return top_rows(feature_table(spark, d).select("term", "ig_lang"), "ig_lang", "term", 25)


QUERIES = {
    f.__name__: f
    for f in (
        lang_coverage, lang_dist, min_domain_prune, corpus_lines, ngram_df, ngram_tf, word_ngrams, word_df, sampled_df, df_select, df_select_all, ig_domain,
        ig_lang_bin, ld_select, nb_prior, nb_ptc, nb_classify, language_texts, trained_model, tweet_languages, english_filter, bl_weights, feature_table, top_features,
    )
}

_CORPUS = "corpus AS (SELECT domain || '/' || lang || '/' || doc AS id, domain, lang, doc, text, lower(hex(encode(text))) AS h FROM corpus_item WHERE doc IS NOT NULL AND lang IS NOT NULL AND domain IS NOT NULL AND text IS NOT NULL)"


def _grams(high: int) -> str:
    return f"""hits AS (SELECT id, domain, lang, substr(h, 2 * i - 1, 2 * k) AS term FROM corpus, range(1, {high + 1}) a(k), LATERAL (SELECT unnest(range(1, length(h) // 2 - k + 2)) AS i)
        WHERE length(h) // 2 >= {max(1, high - 1)})"""


_TERMS = f"""{_CORPUS}, {_grams(ORDERS)}, seen AS (SELECT DISTINCT id, domain, lang, term FROM hits),
by_domain AS (SELECT term, domain AS class, count(*) AS n FROM seen GROUP BY 1, 2),
df AS (SELECT term, sum(n)::BIGINT AS df FROM by_domain GROUP BY term),
candidates AS (SELECT term, df FROM (SELECT *, row_number() OVER (PARTITION BY length(term) ORDER BY df DESC, term) AS r FROM df) WHERE r <= {PER_ORDER})"""
_X = "(CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END)"
_GAINS = f"""{_TERMS},
domain_sizes AS (SELECT domain AS class, count(*) AS m FROM corpus GROUP BY 1), lang_sizes AS (SELECT lang AS class, count(*) AS m FROM corpus GROUP BY 1),
total AS (SELECT count(*) AS t FROM corpus),
domain_cells AS (SELECT term, class, coalesce(n, 0) AS n, m FROM candidates CROSS JOIN domain_sizes LEFT JOIN by_domain USING (term, class)),
domain_sums AS (SELECT term, sum(n) AS pos, sum({_X.format('n')}) AS xp, sum(m - n) AS neg, sum({_X.format('(m - n)')}) AS xn, sum({_X.format('m')}) AS xa, sum(m) AS t FROM domain_cells GROUP BY term),
domain_gain AS (SELECT term, ln(t) - xa / t - (CASE WHEN pos > 0 THEN pos * (ln(pos) - xp / pos) ELSE 0 END + CASE WHEN neg > 0 THEN neg * (ln(neg) - xn / neg) ELSE 0 END) / t AS ig FROM domain_sums),
by_lang AS (SELECT term, lang AS class, count(*) AS n FROM seen GROUP BY 1, 2),
lang_cells AS (SELECT term, class, coalesce(n, 0) AS a, df - coalesce(n, 0) AS b, m - coalesce(n, 0) AS c, t - m - (df - coalesce(n, 0)) AS d, m, t
    FROM candidates CROSS JOIN lang_sizes CROSS JOIN total LEFT JOIN by_lang USING (term, class)),
lang_gain AS (SELECT term, class, ln(t) - ({_X.format('m')} + {_X.format('(t - m)')}) / t
    - (CASE WHEN a + b > 0 THEN (a + b) * (ln(a + b) - ({_X.format('a')} + {_X.format('b')}) / (a + b)) ELSE 0 END
     + CASE WHEN c + d > 0 THEN (c + d) * (ln(c + d) - ({_X.format('c')} + {_X.format('d')}) / (c + d)) ELSE 0 END) / t AS ig FROM lang_cells)"""
LD = f"""{_GAINS},
features AS (SELECT DISTINCT term FROM (SELECT term, row_number() OVER (PARTITION BY class ORDER BY round(l.ig - g.ig, 12) DESC, term) AS r
    FROM lang_gain l JOIN domain_gain g USING (term)) WHERE r <= {PER_LANG})"""
_NB = f"""{LD},
prior AS (SELECT lang, ln(count(*)) AS logp FROM corpus GROUP BY lang),
tf AS (SELECT term, lang, count(*) AS n FROM hits SEMI JOIN features USING (term) GROUP BY 1, 2),
grid AS (SELECT term, lang, coalesce(n, 0) AS n FROM features CROSS JOIN prior LEFT JOIN tf USING (term, lang)),
ptc AS (SELECT term, lang, ln(1 + n) - ln(count(*) OVER (PARTITION BY lang) + sum(n) OVER (PARTITION BY lang)) AS logp FROM grid)"""

_NB_CLASSIFY = f"""WITH {_NB}, doc_tf AS (SELECT id, term, count(*) AS tf FROM hits SEMI JOIN features USING (term) GROUP BY 1, 2),
        sums AS (SELECT id, lang, sum(tf * logp) AS s FROM doc_tf JOIN ptc USING (term) GROUP BY 1, 2),
        scored AS (SELECT c.id, p.lang, round(p.logp + coalesce(s, 0), 9) AS score FROM (SELECT DISTINCT id FROM corpus) c CROSS JOIN prior p LEFT JOIN sums ON sums.id = c.id AND sums.lang = p.lang)
        SELECT id AS doc_key, lang FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r FROM scored) WHERE r = 1"""


def _classified(asked: str) -> str:
    return f"""hexed AS (SELECT id, lower(hex(encode(text))) AS h FROM {asked}),
own AS (SELECT id, substr(h, 2 * i - 1, 2 * k) AS term FROM hexed, range(1, {ORDERS + 1}) a(k), LATERAL (SELECT unnest(range(1, length(h) // 2 - k + 2)) AS i)
    WHERE length(h) // 2 >= {max(1, ORDERS - 1)}),
own_sums AS (SELECT id, lang, sum(logp) AS s FROM own JOIN ptc USING (term) GROUP BY 1, 2),
own_scores AS (SELECT a.id, p.lang, round(p.logp + coalesce(s, 0), 9) AS score FROM {asked} a CROSS JOIN prior p LEFT JOIN own_sums o ON o.id = a.id AND o.lang = p.lang),
classified AS (SELECT id, lang, 1 / z AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r,
    sum(exp(score - top)) OVER (PARTITION BY id) AS z FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM own_scores)) WHERE r = 1)"""


ORACLE = {
    "corpus_lines": """SELECT domain, lang, doc || '#' || (i - 1) AS doc, length(l[i])::INT AS n_chars
        FROM (SELECT domain, lang, doc, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS l FROM corpus_item), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
        WHERE trim(l[i]) <> ''""",
    "lang_coverage": "SELECT lang, count(DISTINCT domain) AS n_domains FROM corpus_item GROUP BY lang",
    "lang_dist": f"WITH {_CORPUS} SELECT 'lang' AS kind, lang AS class, count(*) AS n_docs FROM corpus GROUP BY lang UNION ALL SELECT 'domain', domain, count(*) FROM corpus GROUP BY domain",
    "min_domain_prune": f"""WITH {_CORPUS}, kept AS (SELECT * FROM corpus WHERE domain IN ('news', 'forum', 'wiki', 'chat'))
        SELECT domain, lang, doc FROM kept WHERE lang IN (SELECT lang FROM kept GROUP BY lang HAVING count(DISTINCT domain) >= 4)""",
    "ngram_df": f"WITH {_TERMS} SELECT term, class, n FROM by_domain",
    "ngram_tf": f"WITH {_CORPUS}, {_grams(ORDERS)} SELECT term, lang AS class, count(*) AS n FROM hits GROUP BY 1, 2",
    "word_ngrams": f"""WITH {_CORPUS}, split AS (SELECT id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM corpus)
        SELECT term, lang AS class, count(DISTINCT id) AS n FROM (SELECT id, lang, array_to_string(w[i:i+k-1], ' ') AS term
        FROM split, range(1, 4) a(k), LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)) GROUP BY 1, 2""",
    "word_df": f"""WITH {_CORPUS} SELECT term, lang AS class, count(DISTINCT id) AS n
        FROM (SELECT id, lang, unnest(regexp_split_to_array(text, '\\s+')) AS term FROM corpus) WHERE term <> '' GROUP BY 1, 2""",
    "df_select": f"WITH {_TERMS} SELECT term, df FROM candidates",
    "df_select_all": f"WITH {_TERMS} SELECT term, df FROM df ORDER BY df DESC, term LIMIT {PER_ORDER}",
    "ig_domain": f"WITH {_GAINS} SELECT term, round(ig, 8) AS ig FROM domain_gain",
    "ig_lang_bin": f"WITH {_GAINS} SELECT term, class, round(ig, 8) AS ig FROM lang_gain",
    "ld_select": f"WITH {LD} SELECT term FROM features",
    "nb_prior": f"WITH {_CORPUS} SELECT lang, round(ln(count(*)), 8) AS logp FROM corpus GROUP BY lang",
    "nb_ptc": f"WITH {_NB} SELECT term, lang, round(logp, 8) AS logp FROM ptc",
    "trained_model": f"WITH {_NB} SELECT term, lang, round(logp, 8) AS logp FROM ptc",
    "nb_classify": _NB_CLASSIFY,
    "language_texts": f"SELECT doc_key FROM ({_NB_CLASSIFY}) WHERE lang IN ('en', 'ru')",
    "sampled_df": f"""WITH {_CORPUS}, pieces AS (SELECT id || '|' || k AS id, lang, lower(hex(encode(substr(text, (('0x' || substr(md5(concat_ws('|', text, k::VARCHAR, '0')), 1, 8))::BIGINT
            % greatest(length(text) - {li.SAMPLE_SIZE} + 1, 1) + 1)::INT, {li.SAMPLE_SIZE})))) AS h FROM corpus, range(1, 3) r(k)),
        drawn AS (SELECT DISTINCT id, lang, substr(h, 2 * i - 1, 2 * k) AS term FROM pieces, range(1, {ORDERS + 1}) a(k), LATERAL (SELECT unnest(range(1, length(h) // 2 - k + 2)) AS i)
            WHERE length(h) // 2 >= {max(1, ORDERS - 1)})
        SELECT term, lang AS class, count(*) AS n FROM drawn GROUP BY 1, 2""",
    "tweet_languages": f"""WITH {_NB}, asked AS (SELECT id_str AS id, text FROM ({FIRST}) WHERE text IS NOT NULL), {_classified("asked")}
        SELECT lang, count(*) AS n, round(avg(confidence), 4) AS confidence FROM classified GROUP BY lang""",
    "english_filter": f"""WITH {_NB}, tweets AS (SELECT id_str, lang, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS tokens FROM ({FIRST}) WHERE text IS NOT NULL),
        held AS (SELECT id_str, unnest(tokens) AS id FROM tweets), asked AS (SELECT DISTINCT id, id AS text FROM held), {_classified("asked")},
        shares AS (SELECT id_str, avg(CASE WHEN classified.lang = 'en' THEN 1 ELSE 0 END) AS share FROM held JOIN classified USING (id) GROUP BY id_str)
        SELECT id_str FROM tweets LEFT JOIN shares USING (id_str) WHERE lang = 'en' OR share >= 0.8""",
    "bl_weights": f"""WITH {_NB}, soft AS (SELECT term, lang, exp(logp) / sum(exp(logp)) OVER (PARTITION BY lang) AS p FROM ptc),
        sums AS (SELECT term, sum(p) AS z FROM soft GROUP BY term)
        SELECT a.lang AS lang1, b.lang AS lang2, term, round(abs(a.p - b.p) / z, 8) AS weight FROM soft a JOIN soft b USING (term) JOIN sums USING (term) WHERE a.lang < b.lang""",
    "feature_table": f"""WITH {LD} SELECT term, (length(term) // 2)::INT AS length, df, round(g.ig, 8) AS ig_domain, round(max(l.ig), 8) AS ig_lang, count(*)::INT AS n_langs
        FROM features JOIN df USING (term) JOIN domain_gain g USING (term) JOIN lang_gain l USING (term) GROUP BY term, df, g.ig""",
    "top_features": f"""WITH {LD} SELECT term, round(max(l.ig), 8) AS ig_lang FROM features JOIN lang_gain l USING (term) GROUP BY term ORDER BY 2 DESC, term LIMIT 25""",
}

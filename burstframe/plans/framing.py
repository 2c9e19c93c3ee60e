"""Queries of tagging, chunking and frame extraction, and the course from tweets to labelled events by frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstframe.operators import burst, chunking, events, frames, tagging
from burstframe.plans.bursts import burst_sql
from burstframe.plans.tweets import PLACED, placed_tweets
from burstframe.session import table
from burstframe.sources import readers


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all placed tweets; those with foreign words are left out when frames are made."""
    return tagging.tagged_sentences(placed_tweets(spark, d), "day", "tweet_id")


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).withColumn("phrases", chunking.np_chunks(F.col("tokens")))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.chunked_frames(_sentences(spark, d))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tag sequences."""
    return _sentences(spark, d).select(F.transform("tokens", lambda t: t.tag).alias("tags")).distinct()


def tag_codes(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select(frames.tag_code(F.col("tags")).alias("code")).distinct()


def verb_spans(spark: SparkSession, d: str) -> DataFrame:
    return frames.code_spans(frames.sentence_codes(placed_tweets(spark, d)))


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    return frames.merged_code_spans(frames.sentence_codes(placed_tweets(spark, d)))


def span_relations(spark: SparkSession, d: str) -> DataFrame:
    """How the phrases of sentences lie to their verb spans."""
    return frames.relation_counts(placed_tweets(spark, d))


def np_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunked(spark, d)
    return rows.select("day", "tweet_id", "sentence", chunking.bracketed(F.col("tokens"), F.col("phrases")).alias("line"))


def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """The phrases as they are read back from the bracketed text."""
    rows = readers.chunk_spans(np_chunks(spark, d), "line")
    return rows.select("day", "tweet_id", "sentence", F.inline("spans"))


def proper_ends(spark: SparkSession, d: str) -> DataFrame:
    """How many phrases end in a proper noun."""
    ends = _chunked(spark, d).select("tokens", F.explode("phrases").alias("p"))
    return ends.groupBy(tagging.proper_noun_end(F.col("tokens"), F.col("p.ed")).alias("proper")).agg(F.count(F.lit(1)).alias("n"))


def joined_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of sentences whose phrases come from another table, by the sentence."""
    keys = ["day", "tweet_id", "sentence"]
    found = frames.with_phrases(_sentences(spark, d), _chunked(spark, d).select(*keys, "phrases"), keys)
    return frames.frames(found).select(*keys, F.explode("frames").alias("f")).select(*keys, "f.*")


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("day", "tweet_id", "sentence", F.explode("frames").alias("f")).select("day", "tweet_id", "sentence", "f.*")


def frame_elements(spark: SparkSession, d: str) -> DataFrame:
    units = frames.frame_units(_frames(spark, d), "day", "tweet_id")
    return burst.unit_day_df(burst.keep_units(units, table(spark, d, "stop_words")))


def noise_words(spark: SparkSession, d: str) -> DataFrame:
    return frames.noise_words(_frames(spark, d))


def verb_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return frames.verb_lexicon(_frames(spark, d))


def frame_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Top bursty frame elements of each day with their most frequent frame."""
    rows = _frames(spark, d)
    units = burst.keep_units(frames.frame_units(rows, "day", "tweet_id"), table(spark, d, "stop_words"))
    placed, social = placed_tweets(spark, d), table(spark, d, "social")
    ps = burst.unit_ps(units, burst.day_sizes(placed))
    top = burst.top_bursts(burst.unit_bursts(units, burst.known_sizes(placed, social), social, ps))
    texts = rows.select("day", F.explode("frames").alias("f")).select("day", frames.frame_text(F.col("f")).alias("frame"))
    return events.labelled_units(top, texts)


QUERIES = {
    f.__name__: f
    for f in (tag_codes, verb_spans, merged_spans, span_relations, np_chunks, chunk_scan, proper_ends, joined_frames, frame_rows, frame_elements, noise_words, verb_lexicon, frame_bursts)
}
_TOKEN = r"https?://\S+|[@#]\w+|[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"


def listed(table: dict[str, str], word: str) -> str:
    return " ".join(f"WHEN {word} IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words.split(' '))}) THEN '{key}'" for key, words in table.items())


_TAG = rf"""CASE WHEN starts_with(w, 'http') THEN 'URL' WHEN starts_with(w, '@') AND length(w) > 1 THEN 'USR' WHEN starts_with(w, '#') AND length(w) > 1 THEN 'HT'
    WHEN lower(w) = 'rt' THEN 'RT' WHEN w = ',' THEN ',' WHEN w IN (';', ':') THEN ':' WHEN w IN ('.', '!', '?', '…') THEN '.' WHEN w = '(' THEN '-LRB-' WHEN w = ')' THEN '-RRB-'
    WHEN regexp_full_match(w, '[^\p{{L}}\p{{N}}_]+') THEN 'SYM' WHEN regexp_matches(w, '^[0-9]') THEN 'CD' WHEN regexp_matches(w, '[^ -~]') THEN 'FW'
    {listed(tagging.LEXICON, 'lower(w)')}
    WHEN regexp_full_match(lower(w), '..+ing') THEN 'VBG' WHEN regexp_full_match(lower(w), '..+ed') THEN 'VBD' WHEN regexp_full_match(lower(w), '..+ly') THEN 'RB'
    WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' WHEN regexp_full_match(lower(w), '..+[^s]s') THEN 'NNS' ELSE 'NN' END"""

def tagged_sql(texts: str, *keys: str) -> str:
    """Common table tagged (keys, sentence, words, tags) of a query with keys and text."""
    named = "".join(f"{k}, " for k in keys)
    return rf"""lines AS (SELECT {named}unnest(range(len(l)))::INT AS sentence, unnest(l) AS line FROM (SELECT {named}list_filter(list_transform(
    regexp_split_to_array(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({texts}) WHERE text IS NOT NULL)),
tagged AS (SELECT {named}sentence, words, list_transform(words, lambda w: {_TAG}) AS tags FROM (SELECT *, regexp_extract_all(line, '{_TOKEN}') AS words FROM lines))"""


_TAGGED = tagged_sql(PLACED, "day", "tweet_id")
_CODES = f"""{_TAGGED},
codes AS (SELECT DISTINCT array_to_string(list_transform(tags, lambda t: CASE {listed(frames.CODES, 't')} ELSE 'X' END), '') AS code FROM tagged)"""


def _found(pattern: str) -> str:
    return f"""SELECT code, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS st, length(found[i]) AS n
        FROM (SELECT code, regexp_split_to_array(code, '{pattern}') AS gaps, regexp_extract_all(code, '{pattern}') AS found FROM codes), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)"""


_SPANS = f"""{_CODES},
spans AS (SELECT code, st::INT AS st, max(st + n - 1)::INT AS ed FROM ({_found(frames.SHORT)} UNION ALL {_found(frames.LONG)}) GROUP BY code, st),
islands AS (SELECT code, st, ed, sum(CASE WHEN st > before OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY st) AS k
    FROM (SELECT *, max(ed) OVER (PARTITION BY code ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans))"""



def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def chunked_sql(texts: str, *keys: str) -> str:
    """Common table chunked (keys, sentence, words, tags, sts, eds) of a query with keys and text: where phrases begin and
    end. One common table for each rule; every place is tested against the tags as they were before the rule."""
    tags = chunking.POS_TAGS
    outside, begins = (_quoted([t for t, c in tags.items() if c == x]) for x in "OB")
    named = ", ".join(keys)
    steps = [f"""rule_0 AS (SELECT {named}, sentence, words, tags, list_append(words, 'ZZZ') AS W, list_append(tags, 'ZZZ') AS P,
    list_append(list_transform(tags, lambda t: CASE WHEN t IN ({outside}) THEN 'O' WHEN t IN ({begins}) THEN 'B' ELSE 'I' END), 'Z') AS T FROM tagged)"""]
    for k, line in enumerate(chunking.RULES):
        r = chunking.parse_rule(line)
        tests = " AND ".join("(" + " OR ".join(f"{kind}[i + {o}] = '{value}'" for o in offsets) + ")" for kind, offsets, value in r.parts)
        steps.append(f"""rule_{k + 1} AS (SELECT * REPLACE (list_transform(range(1, len(W) + 1),
    lambda i: CASE WHEN i + {r.low} >= 1 AND i + {r.high} <= len(W) AND {tests} THEN '{r.out}' ELSE T[i] END) AS T) FROM rule_{k})""")
    return tagged_sql(texts, *keys) + ",\n" + ",\n".join(steps) + f""",
chunked AS (SELECT {named}, sentence, words, tags,
    list_filter(range(len(words)), lambda i: T[i + 1] = 'B' OR (T[i + 1] = 'I' AND (i = 0 OR T[i] = 'O'))) AS sts,
    list_filter(range(len(words)), lambda i: T[i + 1] <> 'O' AND (i + 1 = len(words) OR T[i + 2] IN ('B', 'O'))) AS eds FROM rule_{len(chunking.RULES)})"""


_CHUNKED = chunked_sql(PLACED, "day", "tweet_id")
BRACKETED = """array_to_string(list_transform(range(len(words)), lambda i: CASE WHEN list_contains(sts, i) THEN '[ ' ELSE '' END || words[i + 1] || '/' || tags[i + 1]
    || CASE WHEN list_contains(eds, i) THEN ' ]' ELSE '' END), ' ')"""
_PHRASES = "list_transform(range(1, len(sts) + 1), lambda k: {'st': sts[k], 'ed': eds[k]})"
_NOUN = "starts_with(tags[{0} + 1], 'NN')"


def _stripped(tag: str, phrases: str) -> str:
    """Phrases without a tag at their ends; one of that tag alone becomes empty, its end before its beginning."""
    other = f"list_filter(range(p.st, p.ed + 1), lambda i: tags[i + 1] <> '{tag}')"
    return f"list_transform({phrases}, lambda p: {{'st': coalesce(list_min({other}), p.ed + 1), 'ed': coalesce(list_max({other}), p.ed)}})"


def _frames_sql() -> str:
    steps = [f"strip_0 AS (SELECT * EXCLUDE (sts, eds), {_PHRASES} AS phrases FROM chunked WHERE len(list_filter(tags, lambda t: starts_with(t, 'FW'))) = 0)"]
    for k, tag in enumerate(frames.STRIPPED):
        steps.append(f"strip_{k + 1} AS (SELECT * REPLACE (list_filter({_stripped(tag, 'phrases')}, lambda p: p.st <= p.ed) AS phrases) FROM strip_{k})")
    slot = lambda st, ed: f"lower(array_to_string(list_transform(list_filter(words[{st} + 1:{ed} + 1], lambda w: w <> ''), lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@usr' ELSE replace(w, '|', '') END), '_'))"
    return f"""{_CHUNKED},
{_SPANS.removeprefix(_TAGGED + ",").strip()},
merged AS (SELECT code, list({{'st': st, 'ed': ed}} ORDER BY st) AS verbs FROM (SELECT code, k, min(st) AS st, max(ed) AS ed FROM islands GROUP BY code, k) GROUP BY code),
{", ".join(steps)},
marked AS (SELECT *, list_transform(phrases, lambda p: {{'p': p, 'm': list_filter(range(p.st, p.ed + 1), lambda i: left(tags[i + 1], 1) IN (',', '.'))}}) AS found FROM strip_{len(frames.STRIPPED)}),
refined AS (SELECT * EXCLUDE (phrases, found), flatten(list_transform(found, lambda f: CASE WHEN len(f.m) = 0 THEN [f.p] ELSE list_filter(list_transform(range(0, len(f.m) + 1),
    lambda k: {{'st': CASE WHEN k = 0 THEN f.p.st ELSE f.m[k] + 1 END, 'ed': CASE WHEN k = len(f.m) THEN f.p.ed ELSE f.m[k + 1] - 1 END}}), lambda p: p.ed >= 0 AND {_NOUN.format('p.ed')}) END)) AS phrases FROM marked),
verbs AS (SELECT r.*, list_filter(phrases, lambda p: len(list_filter(tags[p.st + 1:p.ed + 1], lambda t: t IN ({_quoted(list(frames.NO_ARGUMENT))}))) = 0) AS valid,
    unnest(m.verbs) AS v, unnest(range(len(m.verbs))) AS place
    FROM (SELECT *, array_to_string(list_transform(tags, lambda t: CASE {listed(frames.CODES, 't')} ELSE 'X' END), '') AS code FROM refined) r JOIN merged m USING (code)),
near AS (SELECT *, list_last(list_filter(valid, lambda p: p.ed < v.st)) AS left_np, list_first(list_filter(valid, lambda p: p.st > v.ed)) AS right_np,
    list_max(list_filter(range(0, v.st), lambda i: {_NOUN.format('i')})) AS left_n, list_min(list_filter(range(v.ed + 1, len(tags)), lambda i: {_NOUN.format('i')})) AS right_n FROM verbs),
placed_slots AS (SELECT *,
    coalesce(left_np, CASE WHEN left_n IS NOT NULL THEN {{'st': CASE WHEN len(phrases) = 0 AND left_n > 0 AND {_NOUN.format('(left_n - 1)')} THEN left_n - 1 ELSE left_n END, 'ed': left_n}} END) AS a1,
    coalesce(right_np, CASE WHEN right_n IS NOT NULL THEN {{'st': right_n, 'ed': CASE WHEN len(phrases) = 0 AND right_n + 1 < len(tags) AND {_NOUN.format('(right_n + 1)')} THEN right_n + 1 ELSE right_n END}} END) AS a2 FROM near),
slots AS (SELECT day, tweet_id, sentence, place, words, CASE WHEN a1 IS NULL THEN '' ELSE {slot('a1.st', 'a1.ed')} END AS s1, {slot('v.st', 'v.ed')} AS s2,
    CASE WHEN a2 IS NULL THEN '' ELSE {slot('a2.st', 'a2.ed')} END AS s3 FROM placed_slots),
{repeats_sql("SELECT s1 AS s FROM slots UNION SELECT s2 FROM slots UNION SELECT s3 FROM slots")},
frames AS (SELECT day, tweet_id, sentence, place, words, a.out AS arg1, b.out AS verb, c.out AS arg2
    FROM slots JOIN short a ON a.s = s1 JOIN short b ON b.s = s2 JOIN short c ON c.s = s3),
frame_units AS (SELECT day, tweet_id, unnest([arg1, verb, arg2]) AS unit FROM frames),
placed AS ({PLACED}),
units AS (SELECT DISTINCT day, tweet_id, unit FROM frame_units WHERE unit <> '' AND day IS NOT NULL AND NOT contains(unit, 'http')
    AND unit NOT IN (SELECT lower(word) FROM stop_words WHERE word IS NOT NULL))"""


def repeats_sql(words: str) -> str:
    """Common table short (s, out) for a query with s: four or more repeats of a unit of word characters, the longest unit
    first, become three of its last character. One step for each place of a string."""
    return f"""repeat_steps AS (
    SELECT s, 1 AS pos, '' AS out FROM (SELECT DISTINCT s FROM ({words}))
    UNION ALL
    SELECT s, CASE WHEN n > 0 THEN pos + n * list_max(list_filter(range(4, (length(s) - pos + 1) // n + 1), lambda r: repeat(substr(s, pos, n), r) = substr(s, pos, n * r))) ELSE pos + 1 END,
        out || CASE WHEN n > 0 THEN repeat(substr(s, pos + n - 1, 1), 3) ELSE substr(s, pos, 1) END
    FROM (SELECT *, coalesce(list_max(list_filter(range(1, (length(s) - pos + 1) // 4 + 1),
        lambda k: repeat(substr(s, pos, k), 4) = substr(s, pos, 4 * k) AND regexp_full_match(substr(s, pos, k), '\\w+'))), 0) AS n FROM repeat_steps WHERE pos <= length(s))),
short AS (SELECT s, out FROM repeat_steps WHERE pos > length(s))"""


_FRAMES = _frames_sql()
_FRAME_BURST = burst_sql(_FRAMES)

ORACLE = {
    "np_chunks": f"WITH {_CHUNKED} SELECT day, tweet_id, sentence, {BRACKETED} AS line FROM chunked",
    "chunk_scan": f"WITH {_CHUNKED} SELECT day, tweet_id, sentence, unnest(sts)::INT AS st, unnest(eds)::INT AS ed FROM chunked",
    "proper_ends": f"""WITH {_CHUNKED} SELECT starts_with(tags[ed + 1], 'NNP') AS proper, count(*) AS n FROM (SELECT tags, unnest(eds) AS ed FROM chunked) GROUP BY 1""",
    "span_relations": f"""WITH {_CHUNKED}, {_SPANS.removeprefix(_TAGGED + ",").strip()},
        pairs AS (SELECT s.st AS st1, s.ed AS ed1, c.st AS st2, c.ed AS ed2 FROM spans s
            JOIN (SELECT array_to_string(list_transform(tags, lambda t: CASE {listed(frames.CODES, 't')} ELSE 'X' END), '') AS code, unnest(sts) AS st, unnest(eds) AS ed FROM chunked) c USING (code))
        SELECT CASE WHEN ed2 + 1 < st1 THEN 'left' WHEN ed2 + 1 = st1 THEN 'left adjacent' WHEN st2 > ed1 + 1 THEN 'right' WHEN st2 = ed1 + 1 THEN 'right adjacent'
            WHEN st2 <= st1 AND ed1 <= ed2 THEN 'cover' WHEN st1 <= st2 AND ed2 <= ed1 THEN 'insider' WHEN st2 < st1 THEN 'left intersaction' ELSE 'right intersaction' END AS relation, count(*) AS n
        FROM pairs GROUP BY 1""",
    "frame_rows": f"WITH RECURSIVE {_FRAMES} SELECT day, tweet_id, sentence, arg1, verb, arg2 FROM frames",
    "joined_frames": f"WITH RECURSIVE {_FRAMES} SELECT day, tweet_id, sentence, arg1, verb, arg2 FROM frames",
    "frame_elements": f"WITH RECURSIVE {_FRAMES} SELECT unit, day, count(*) AS df FROM units GROUP BY unit, day",
    "verb_lexicon": f"WITH RECURSIVE {_FRAMES} SELECT verb, count(*) AS n FROM frames GROUP BY verb",
    "noise_words": f"""WITH RECURSIVE {_FRAMES},
        heard AS (SELECT day, tweet_id, sentence, any_value(words) AS words, flatten(list(string_split(lower(translate(concat_ws('|', arg1, verb, arg2), '|_', '  ')), ' '))) AS framed FROM frames GROUP BY 1, 2, 3)
        SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(words, lambda w: lower(w)), lambda w: NOT list_contains(framed, w))) AS word FROM heard)
        WHERE word NOT IN (SELECT unnest(framed) FROM heard) GROUP BY word""",
    "frame_bursts": f"""WITH RECURSIVE {_FRAME_BURST},
        texts_of AS (SELECT day, concat_ws('|', arg1, verb, arg2) AS frame FROM frames),
        held AS (SELECT day, unit, frame, count(*) AS n FROM (SELECT day, frame, unnest(list_distinct(string_split(frame, '|'))) AS unit FROM texts_of) WHERE length(unit) > 1 GROUP BY ALL),
        best AS (SELECT day, unit, frame FROM (SELECT *, row_number() OVER (PARTITION BY day, unit ORDER BY n DESC, frame) AS r FROM held) WHERE r = 1)
        SELECT day, seg_id, unit, coalesce(frame, unit) AS label FROM top LEFT JOIN best USING (day, unit)""",
    "tag_codes": f"WITH {_CODES} SELECT code FROM codes",
    "verb_spans": f"WITH {_SPANS} SELECT code, st, ed FROM spans",
    "merged_spans": f"WITH {_SPANS} SELECT code, min(st) AS st, max(ed) AS ed FROM islands GROUP BY code, k",
}

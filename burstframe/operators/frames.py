"""Verb spans and argument-verb-argument frames of tagged sentences.

Tags are coded as one character each, so that patterns over tags are patterns over a string and places in it are places in
the sentence. Spans are (st, ed), both inclusive and counted from 0. Patterns are matched in Python: the JVM's regular
expressions need stack in proportion to a match, and give no places.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from burstframe.functions import text as tx
from burstframe.operators import tagging
from burstframe.operators.chunking import RULES, Chunker, parse_rule
from burstframe.operators.tagging import lookup

#: Tags by code. $ and PRP$ break a run of words, as X.
CODES = {
    "R": "RB", "V": "MD VB VBD VBP VBZ", "G": "VBG VBN", "P": "IN TO", "T": "RP",
    "W": "CD DT JJ JJR JJS NN NNS NNP NNPS POS PRP RBR RBS",
}
_VERB, _PREP = "R?[VG]T?R?", "R?[PT]R?"
SHORT = f"(?:{_VERB}(?:{_PREP})?)+"
LONG = f"(?:{_VERB}(?:[WRG]*(?:{_PREP})+)?)+"
STRIPPED = ("UH", ",", ".", "-LRB-", "-RRB-")
NO_ARGUMENT = ("WDT", "WP", "WP$", "EX")
_CODE_OF = {name: code for code, names in CODES.items() for name in names.split()}
_SPAN = StructType([StructField("st", IntegerType()), StructField("ed", IntegerType())])


def tag_code(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.coalesce(lookup(CODES, t), F.lit("X"))), "")


def _spans(code: str) -> list[dict[str, int]]:
    ends: dict[int, int] = {}
    for pattern in (SHORT, LONG):
        for m in re.finditer(pattern, code):
            ends[m.start()] = max(ends.get(m.start(), -1), m.end() - 1)
    return [{"st": s, "ed": e} for s, e in sorted(ends.items())]


def _merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """merge_spans() of spans in order, in Python."""
    out: list[dict[str, int]] = []
    for s in spans:
        if out and s["st"] <= out[-1]["ed"]:
            out[-1]["ed"] = max(out[-1]["ed"], s["ed"])
        else:
            out.append(dict(s))
    return out


def code_spans(codes: DataFrame) -> DataFrame:
    """(code, st, ed): the verb spans of each (code)."""
    return _span_rows(codes, _spans)


def merged_code_spans(codes: DataFrame) -> DataFrame:
    """(code, st, ed): the merged verb spans of each (code)."""
    return _span_rows(codes, lambda code: _merged(_spans(code)))


def _span_rows(codes: DataFrame, find: Callable[[str], list[dict[str, int]]]) -> DataFrame:
    """Rows are made in the pass that finds the spans: an array to inline would be found again by the filter on its size that
    the planner moves below the count of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(code, s["st"], s["ed"]) for code in batch.column(0).to_pylist() if code for s in find(code)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["code", "st", "ed"])

    return codes.select("code").mapInArrow(run, "code STRING, st INT, ed INT")


def sentence_codes(texts: DataFrame) -> DataFrame:
    """(code): the distinct tag codes of the sentences of (text)."""
    return tagging.sentence_counts(texts, lambda _word, tag: _CODE_OF.get(tag, "X")).select(F.col("key").alias("code"))


@F.pandas_udf(ArrayType(_SPAN))
def _spans_of(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in codes:
        yield pd.Series([None if c is None else _spans(c) for c in batch], dtype=object)


def verb_spans(tags: Column) -> Column:
    """The longest span from each place where a short or a long relation begins, in order."""
    return _spans_of(tag_code(tags))


def merge_spans(spans: Column) -> Column:
    """Spans in order, merged where one begins at or before the end of the last; those that only touch stay apart."""
    ordered = F.array_sort(spans)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.st.alias("st"), F.greatest(last.ed, s.ed).alias("ed"))))
        return F.when((F.size(acc) > 0) & (s.st <= last.ed), joined).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast("array<struct<st: int, ed: int>>"), step)


def span_relation(a: Column, b: Column) -> Column:
    """Where b lies to a, by eight names. The names, spelled as the format has them."""
    st1, ed1, st2, ed2 = a.st, a.ed, b.st, b.ed
    return (
        F.when(ed2 + 1 < st1, "left").when(ed2 + 1 == st1, "left adjacent").when(st2 > ed1 + 1, "right").when(st2 == ed1 + 1, "right adjacent")
        .when((st2 <= st1) & (ed1 <= ed2), "cover").when((st1 < st2) & (ed2 <= ed1), "insider").when((st1 == st2) & (ed2 < ed1), "insider")
        .when((st2 < st1) & (ed2 < ed1), "left intersaction").otherwise("right intersaction")
    )


Span = tuple[int, int]


def _relation(a: Span, b: Span) -> str:
    """span_relation(), in Python."""
    (st1, ed1), (st2, ed2) = a, b
    if ed2 < st1:
        return "left adjacent" if ed2 + 1 == st1 else "left"
    if st2 > ed1:
        return "right adjacent" if st2 == ed1 + 1 else "right"
    if st2 <= st1 and ed1 <= ed2:
        return "cover"
    if st1 <= st2 and ed2 <= ed1:
        return "insider"
    return "left intersaction" if st2 < st1 else "right intersaction"


def count_relations(verbs: list[Span], phrases: list[Span], counts: Counter[str], n: int = 1) -> None:
    """Adds n for each verb span and phrase to the count of their relation. Phrases are in order and apart, so those that lie
    wholly to one side are counted without looking at each."""
    starts, ends = [p[0] for p in phrases], [p[1] for p in phrases]
    for v in verbs:
        first, last = bisect_left(ends, v[0] - 1), bisect_right(starts, v[1] + 1)
        for name, k in (("left", first), ("right", len(phrases) - last)):
            if k:
                counts[name] += n * k
        for p in phrases[first:last]:
            counts[_relation(v, p)] += n


def relation_counts(texts: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(relation, n): how the phrases of the sentences of (text) lie to their verb spans. Both follow from the tags and the
    words that rules name, so sentences that agree in those are counted first and worked out once."""
    named = frozenset(v for r in rules if r.strip() for k, _, v in parse_rule(r).parts if k == "W")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(rules)
        counts: Counter[str] = Counter()
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [x.partition("/") for x in key.split(" ")] if key else []
                words, tags = [p[2] for p in parts], [p[0] for p in parts]
                verbs = _spans("".join(_CODE_OF.get(t, "X") for t in tags))
                if verbs:
                    count_relations([(s["st"], s["ed"]) for s in verbs], chunker.spans(words, tags), counts, n)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["relation", "n"])

    keys = tagging.sentence_counts(texts, lambda word, tag: f"{tag}/{word}" if word in named else tag, " ")
    return keys.mapInArrow(run, "relation STRING, n BIGINT").groupBy("relation").agg(F.sum("n").alias("n"))


def refine_phrase(tags: list[str], span: Span) -> list[Span]:
    """The phrase without interjections, marks and brackets at its ends; if commas or stops are inside, the pieces between
    them that end in a noun."""
    st, ed = span
    for tag in STRIPPED:
        while st <= ed and tags[st] == tag:
            st += 1
        while st <= ed and tags[ed] == tag:
            ed -= 1
    if st > ed:
        return []
    marks = [i for i in range(st, ed + 1) if tags[i][:1] in (",", ".")]
    ends = [m - 1 for m in marks] + [ed]
    pieces = list(zip([st, *(m + 1 for m in marks)], ends, strict=True))
    return [p for p in pieces if p[1] >= 0 and tags[p[1]].startswith("NN")] if marks else pieces


def arguments(tags: list[str], phrases: list[Span], verb: Span) -> tuple[Span | None, Span | None]:
    """The spans of the nearest valid phrases before and after a verb. Without any phrase in the sentence the nearest noun,
    with one more beside it; with none that fits the nearest noun alone; else none."""
    valid = [p for p in phrases if not any(tags[i] in NO_ARGUMENT for i in range(p[0], p[1] + 1))]
    before = next((p for p in reversed(valid) if p[1] < verb[0]), None)
    after = next((p for p in valid if p[0] > verb[1]), None)
    noun = [t.startswith("NN") for t in tags]
    if before is None:
        i = next((i for i in range(verb[0] - 1, -1, -1) if noun[i]), -1)
        if i >= 0:
            before = (i - 1 if not phrases and i > 0 and noun[i - 1] else i, i)
    if after is None:
        i = next((i for i in range(verb[1] + 1, len(tags)) if noun[i]), -1)
        if i >= 0:
            after = (i, i + 1 if not phrases and i + 1 < len(tags) and noun[i + 1] else i)
    return before, after


def _text(words: list[str], span: Span | None) -> str:
    if span is None:
        return ""
    kept = ("@usr" if w[0] == "@" and len(w) > 1 else w.replace("|", "") for w in words[span[0] : span[1] + 1] if w)
    return re.sub(r"((\w)+)\1{3,}", r"\2\2\2", "_".join(kept).lower())


def extract(words: list[str], tags: list[str], phrases: list[Span]) -> list[dict[str, str]]:
    """The frames of one sentence, by the place of their verbs; none if it has a foreign word."""
    if any(t.startswith("FW") for t in tags):
        return []
    code = "".join(_CODE_OF.get(t, "X") for t in tags)
    verbs = [(s["st"], s["ed"]) for s in _merged(_spans(code))]
    refined = [p for span in phrases for p in refine_phrase(tags, span)]
    out = []
    for st, ed in verbs:
        arg1, arg2 = arguments(tags, refined, (st, ed))
        out.append({"arg1": _text(words, arg1), "verb": _text(words, (st, ed)), "arg2": _text(words, arg2)})
    return out


_FRAMES = ArrayType(StructType([StructField(n, StringType()) for n in ("arg1", "verb", "arg2")]))


@F.pandas_udf(_FRAMES)
def _extract(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in columns:
        rows = zip(*batch, strict=True)
        found = [extract(list(w), list(t), [] if st is None else list(zip(st.tolist(), ed.tolist(), strict=True))) for w, t, st, ed in rows]
        yield pd.Series(found, dtype=object)


def frames(sentences: DataFrame, phrases: str = "phrases") -> DataFrame:
    """Adds frames, an array of (arg1, verb, arg2), to rows with tokens and phrases. Sentences with a foreign word and
    sentences without a verb span have no row. phrases may be null or empty.

    The arguments of a verb depend on each other's choices, which as one expression would be worked out again for every
    use; one Arrow pass does each sentence once.
    """
    part = lambda column, field: F.transform(column, lambda x: x[field])
    found = _extract(part("tokens", "word"), part("tokens", "tag"), part(phrases, "st"), part(phrases, "ed"))
    return sentences.withColumn("frames", found).where(F.size("frames") > 0)


def chunked_frames(sentences: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Adds phrases and frames to rows with tokens, in one pass over each sentence; rows as frames keeps them."""

    @F.pandas_udf(StructType([StructField("phrases", ArrayType(_SPAN)), StructField("frames", _FRAMES)]))
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        chunker = Chunker(rules)
        for words, tags in columns:
            rows = [(list(w), list(t)) for w, t in zip(words, tags, strict=True)]
            spans = [chunker.spans(w, t) for w, t in rows]
            yield pd.DataFrame({"phrases": [[{"st": a, "ed": b} for a, b in s] for s in spans], "frames": [extract(w, t, s) for (w, t), s in zip(rows, spans, strict=True)]})

    made = run(F.transform("tokens", lambda t: t.word), F.transform("tokens", lambda t: t.tag))
    return sentences.withColumn("_made", made).select(*sentences.columns, "_made.phrases", "_made.frames").where(F.size("frames") > 0)


def with_phrases(sentences: DataFrame, chunks: DataFrame, keys: list[str], phrases: str = "phrases") -> DataFrame:
    """Adds phrases to sentences from a table of them, by the keys of a sentence; null for one that has no row there."""
    return sentences.join(chunks.select(*keys, phrases).dropDuplicates(keys), keys, "left")


def frame_text(frame: Column) -> Column:
    return F.concat_ws("|", frame.arg1, frame.verb, frame.arg2)


def frame_units(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., unit): each non-empty slot of each frame."""
    slots = F.flatten(F.transform("frames", lambda f: F.array(f.arg1, f.verb, f.arg2)))
    return rows.select(*keys, F.explode(F.filter(slots, lambda s: s != "")).alias("unit"))


def noise_words(rows: DataFrame) -> DataFrame:
    """(word, n): words of sentences that are in no frame of theirs, without those that are in any frame."""
    words = rows.select(F.transform("tokens", lambda t: F.lower(t.word)).alias("words"), F.flatten(F.transform("frames", lambda f: F.split(tx.plain_words(frame_text(f)), " "))).alias("framed"))
    out = words.select(F.explode(F.filter("words", lambda w: ~F.array_contains("framed", w))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return out.join(words.select(F.explode("framed").alias("word")).distinct(), "word", "left_anti")


def verb_lexicon(rows: DataFrame) -> DataFrame:
    """(verb, n)."""
    return rows.select(F.explode("frames").alias("f")).groupBy(F.col("f.verb").alias("verb")).agg(F.count(F.lit(1)).alias("n"))

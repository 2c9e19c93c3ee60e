"""Base noun phrases by ordered transformation rules.

A sentence starts with a chunk tag for each part of speech. Each rule, in order, is tested at every place against the tags
as they were before the rule, and changes the tags where it holds. Rules see one place beyond the end of the sentence.
This is a sequential fold over thousands of rules, so it runs in Python on Arrow batches; a sentence is only tested
against rules whose words and parts of speech all occur in it, at the places of one of them. Sentences without tokens have no phrases; null stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

END = ("ZZZ", "ZZZ", "Z")
#: The chunk tag that each Penn tag begins with, and of the tags that tweets add.
POS_TAGS = {
    "#": "I", "$": "I", "''": "O", "(": "O", ")": "O", ",": "O", "-LRB-": "O", "-RRB-": "O", ".": "O", ":": "O", "CC": "O", "CD": "I", "DT": "I",
    "EX": "I", "FW": "I", "HT": "I", "IN": "O", "JJ": "I", "JJR": "I", "JJS": "I", "MD": "O", "NN": "I", "NNP": "I", "NNPS": "I", "NNS": "I", "PDT": "I",
    "POS": "B", "PRP": "I", "PRP$": "I", "RB": "O", "RBR": "O", "RBS": "I", "RP": "O", "RT": "O", "SYM": "O", "TO": "O", "UH": "O", "URL": "O", "USR": "I",
    "VB": "O", "VBD": "O", "VBG": "O", "VBN": "O", "VBP": "O", "VBZ": "O", "WDT": "I", "WP": "I", "WP$": "I", "WRB": "B", "``": "O",
}
#: A small rule set of our own; a larger one can be given as lines of the same form, or read from a file.
RULES = (
    "T0P0P1 I PRP VBD I", "T0P0P1 O VBG NN I", "T0P0P1 O VBN NN I", "T_1T0P0 I I DT B", "T_1T0P0 I I PRP$ B", "T_1T0P0P1 I I EX VBZ B",
    "T0P0P1 O RB JJ I", "T0P0P_1 I EX VBD O", "T0W0P1 I that VBD I", "T0P0P1P2 O CC NN ZZZ O", "T0P0W_1 I CD half I", "T_1T0P0P1 I I WDT VBD B",
)
_PART = re.compile(r"([TWP])((?:_?[0-3])+)")
_SPANS = ArrayType(StructType([StructField("st", IntegerType()), StructField("ed", IntegerType())]))


@dataclass(frozen=True)
class Rule:
    """parts: (T, W or P; offsets, one of which must fit; value), all of which must hold."""

    parts: tuple[tuple[str, tuple[int, ...], str], ...]
    out: str
    low: int
    high: int

    def holds(self, i: int, columns: dict[str, list[str]]) -> bool:
        n = len(columns["W"])
        if not (0 <= i + self.low and i + self.high < n):
            return False
        return all(any(columns[kind][i + o] == value for o in offsets) for kind, offsets, value in self.parts)


def parse_rule(line: str) -> Rule:
    fields = line.split()
    parts = []
    for (kind, digits), value in zip(_PART.findall(fields[0]), fields[1:], strict=False):
        parts.append((kind, tuple(int(d.replace("_", "-")) for d in re.findall("_?[0-3]", digits)), value))
    offsets = [o for _, os, _ in parts for o in os]
    return Rule(tuple(parts), fields[-1], min([0, *offsets]), max([0, *offsets]))


def read_rules(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The rules of a text file in their order, one a line; blank lines are skipped. Rules are applied one after the other to
    every sentence, so there are thousands at most, and they go to every task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).where("trim(line) <> ''")
    return tuple(r.line for r in lines.orderBy("place").collect())


class Chunker:
    def __init__(self, rules: tuple[str, ...] = RULES, pos_tags: dict[str, str] | None = None, unknown: str = "I") -> None:
        self.rules = [parse_rule(r) for r in rules if r.strip()]
        self.needs = [{(k, v) for k, _, v in r.parts if k != "T"} for r in self.rules]
        self.wanted = set().union(*self.needs)
        self.anchors = [next(((k, v, o[0]) for k, o, v in r.parts if k != "T" and len(o) == 1), None) for r in self.rules]
        self.pos_tags = POS_TAGS if pos_tags is None else pos_tags
        self.unknown = unknown

    def tags(self, words: list[str], pos: list[str]) -> list[str]:
        columns = {"W": [*words, END[0]], "P": [*pos, END[1]], "T": [*(self.pos_tags.get(p, self.unknown) for p in pos), END[2]]}
        places: dict[tuple[str, str], list[int]] = {}
        for kind in "WP":
            for i, value in enumerate(columns[kind]):
                if (kind, value) in self.wanted:
                    places.setdefault((kind, value), []).append(i)
        everywhere = range(len(columns["T"]))
        for rule, need, anchor in zip(self.rules, self.needs, self.anchors, strict=True):
            if need <= places.keys():
                at = everywhere if anchor is None else [i - anchor[2] for i in places[anchor[:2]]]
                for i in [i for i in at if i in everywhere and rule.holds(i, columns)]:
                    columns["T"][i] = rule.out
        return columns["T"][:-1]

    def spans(self, words: list[str], pos: list[str]) -> list[tuple[int, int]]:
        """First and last place of each phrase. B ends a phrase and begins the next, O ends one."""
        out: list[tuple[int, int]] = []
        start = -1
        for i, tag in enumerate(self.tags(words, pos)):
            if start >= 0 and tag in "BO":
                out.append((start, i - 1))
                start = i if tag == "B" else -1
            elif start < 0 and tag in "BI":
                start = i
        return [*out, (start, len(words) - 1)] if start >= 0 else out


def np_chunks(tokens: Column, rules: tuple[str, ...] = RULES) -> Column:
    """ARRAY<STRUCT<st, ed>> of an array of (word, tag)."""

    @F.pandas_udf(_SPANS)
    def run(words: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        chunker = Chunker(rules)
        for w, p in words:
            spans = [None if a is None else chunker.spans(list(a), list(b)) for a, b in zip(w, p, strict=True)]
            yield pd.Series([None if s is None else [{"st": a, "ed": b} for a, b in s] for s in spans], dtype=object)

    return run(F.transform(tokens, lambda t: t.word), F.transform(tokens, lambda t: t.tag))


def annotations(tokens: Column, spans: Column) -> Column:
    """ARRAY<STRUCT<start, end, text>>: the phrases as annotations of the sentence whose tokens stand with one space between:
    characters from start to before end."""
    words = F.transform(tokens, lambda t: t.word)
    start = lambda i: F.length(F.array_join(F.slice(words, 1, i), " ")) + F.when(i > 0, 1).otherwise(0)
    text = lambda s: F.array_join(F.slice(words, s.st + 1, s.ed - s.st + 1), " ")
    return F.transform(spans, lambda s: F.struct(start(s.st).alias("start"), (start(s.st) + F.length(text(s))).alias("end"), text(s).alias("text")))


def bracketed(tokens: Column, spans: Column) -> Column:
    """[ a/DT b/NN ] c/VB: the text form."""
    opened = lambda i: F.when(F.exists(spans, lambda s: s.st == i), "[ ").otherwise("")
    closed = lambda i: F.when(F.exists(spans, lambda s: s.ed == i), " ]").otherwise("")
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(opened(i), t.word, F.lit("/"), t.tag, closed(i))), " ")

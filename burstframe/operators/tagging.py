"""Sentences and part-of-speech tags by a small deterministic tagger, in Column expressions; counts of equal sentences are
made in one Arrow pass with the same rules in Python."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Closed-class words of the tagger; the words of a tag are separated by spaces.
LEXICON = {
    "DT": "the a an this that these those each every some any no",
    "IN": "of in on at by with from for about before after during under over behind near between into because while since as if than",
    "TO": "to",
    "CC": "and or but so nor yet",
    "PRP": "i you he she it we they me him them us everyone nobody someone",
    "PRP$": "my your his her its our their",
    "MD": "can could may might must shall should will would",
    "VBZ": "is has does",
    "VBP": "am are have do",
    "VBD": "was were had did broke found kept began bought brought caught chose drove felt forgot gave got heard held knew led left lost made met paid ran said sat saw sent sold spoke stood stopped took told thought went won wrote",
    "VB": "be",
    "RB": "not never again very too also just now then always",
    "WDT": "which",
    "WP": "who whom what",
    "WRB": "when where why how",
    "EX": "there",
    "RP": "up out off down",
    "UH": "oh wow well lol",
    "JJ": "new old last big final quiet huge small long late early free blue red broken wrong second main local",
}
#: Penn tags and the coarse tag of each in the tag set of tweets; of two for one tag the later counts.
COARSE_OF = {
    "#": ",", "$": ",", "''": ",", "(": ",", ")": ",", ",": ",", "-LRB-": ",", "-RRB-": ",", ".": ",", ":": ",", "CC": "&", "CD": "$", "DT": "D",
    "EX": "X", "FW": "G", "IN": "P", "JJ": "A", "JJR": "A", "JJS": "A", "LS": "G", "MD": "V", "NN": "N", "NNP": "^", "NNPS": "^", "NNS": "N", "PDT": "X",
    "POS": "G", "PRP": "O", "PRP$": "D", "RB": "R", "RBR": "R", "RBS": "R", "RP": "T", "RT": "~", "SYM": "G", "TO": "P", "UH": "!", "URL": "U", "USR": "@",
    "VB": "V", "VBD": "V", "VBG": "V", "VBN": "V", "VBP": "V", "VBZ": "V", "WDT": "D", "WP": "O", "WP$": "D", "WRB": "R", "``": ",",
}
COARSE = {coarse: " ".join(t for t, c in COARSE_OF.items() if c == coarse) for coarse in dict.fromkeys(COARSE_OF.values())}


def sentences(text: Column) -> Column:
    """Pieces between line breaks and ends of sentences; empty ones are left out."""
    pieces = F.split(F.regexp_replace(text, r"([.!?]+)\s+", "$1\n"), "\n+")
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda s: s != "")


def tokens(sentence: Column) -> Column:
    """Words, mentions, tags and links, with punctuation marks apart."""
    return F.regexp_extract_all(sentence, F.lit(r"https?://\S+|[@#]\w+|[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"), F.lit(0))


def lookup(table: dict[str, str], word: Column) -> Column:
    """The key whose list of words holds the word, else null. Long lists are hashed sets in the plan."""
    found = F.lit(None).cast("string")
    for key, words in reversed(table.items()):
        found = F.when(word.isin(words.split(" ")), key).otherwise(found)
    return found


def tag_of(word: Column) -> Column:
    """The tag of a token of tokens(). Tests are comparisons of ends and lengths; a regular expression is left only for the
    marks, which are single characters."""
    low = F.lower(word)
    known = lookup(LEXICON, low)
    first = F.substring(word, 1, 1)
    ends = lambda end, more: F.endswith(low, F.lit(end)) & (F.length(low) >= len(end) + more)
    shape = (
        F.when(word.startswith("http"), "URL")
        .when((first == "@") & (F.length(word) > 1), "USR")
        .when((first == "#") & (F.length(word) > 1), "HT")
        .when(low == "rt", "RT")
        .when(word == ",", ",")
        .when(word.isin(";", ":"), ":")
        .when(word.isin(".", "!", "?", "…"), ".")
        .when(word == "(", "-LRB-")
        .when(word == ")", "-RRB-")
        .when((F.length(word) == 1) & word.rlike(r"[^\p{L}\p{N}_]"), "SYM")
        .when(first.between("0", "9"), "CD")
        .when(F.octet_length(word) > F.char_length(word), "FW")
    )
    suffix = (
        F.when(ends("ing", 2), "VBG")
        .when(ends("ed", 2), "VBD")
        .when(ends("ly", 2), "RB")
        .when(first.between("A", "Z"), "NNP")
        .when(ends("s", 3) & ~F.endswith(low, F.lit("ss")), "NNS")
        .otherwise("NN")
    )
    return F.coalesce(shape, known, suffix)


def tag_sentence(sentence: Column) -> Column:
    return F.transform(tokens(sentence), lambda w: F.struct(w.alias("word"), tag_of(w).alias("tag")))


def tagged_sentences(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., sentence, tokens): a row for each sentence of (keys..., text); a sentence is not blank and so has a token. Whole
    texts are tagged."""
    rows = texts.where("text IS NOT NULL").select(*keys, F.posexplode(sentences(F.col("text"))).alias("sentence", "line"))
    return rows.select(*keys, "sentence", tag_sentence(F.col("line")).alias("tokens"))


def coarse_tag(tag: Column) -> Column:
    """The coarse tag; unmapped tags stay."""
    return F.coalesce(lookup(COARSE, tag), tag)


def has_foreign(tokens_: Column) -> Column:
    return F.exists(tokens_, lambda t: t.tag.startswith("FW"))


def tagged_text(tokens_: Column, separator: str = "/") -> Column:
    return F.array_join(F.transform(tokens_, lambda t: F.concat(t.word, F.lit(separator), t.tag)), " ")


def proper_noun_end(tokens_: Column, end: Column) -> Column:
    return F.get(tokens_, end).tag.startswith("NNP")


#: The patterns of sentences() and tokens(): Python's letters and digits are those of L and N, its spaces are not those of the JVM.
_SPACE = r" \t\n\x0b\f\r"
_BREAK = re.compile(rf"(?<=[.!?])[{_SPACE}]+|\n+")
_TOKEN = re.compile(rf"https?://[^{_SPACE}]+|[@#][A-Za-z0-9_]+|\w+(?:['’-]\w+)*|[^{_SPACE}\w]")
_MARKS = {",": ",", ";": ":", ":": ":", ".": ".", "!": ".", "?": ".", "…": ".", "(": "-LRB-", ")": "-RRB-"}
_TAG_OF: dict[str, str] = {}
for _tag, _words in LEXICON.items():
    for _word in _words.split(" "):
        _TAG_OF.setdefault(_word, _tag)
#: Words whose labels a worker keeps.
MAX_WORDS = 100_000


def split_sentences(text: str) -> list[str]:
    """sentences() of a text, in Python."""
    return [s for s in (p.strip(" ") for p in _BREAK.split(text)) if s]


def split_tokens(sentence: str) -> list[str]:
    """tokens() of a sentence, in Python."""
    return _TOKEN.findall(sentence)


def word_tag(word: str) -> str:
    """tag_of() of a token, in Python."""
    low = word.lower()
    if word.startswith("http"):
        return "URL"
    if len(word) > 1 and word[0] in "@#":
        return "USR" if word[0] == "@" else "HT"
    if low == "rt":
        return "RT"
    if word in _MARKS:
        return _MARKS[word]
    if len(word) == 1 and word != "_" and not word.isalnum():
        return "SYM"
    if "0" <= word[0] <= "9":
        return "CD"
    if not word.isascii():
        return "FW"
    if low in _TAG_OF:
        return _TAG_OF[low]
    for end, tag in (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB")):
        if low.endswith(end) and len(low) >= len(end) + 2:
            return tag
    if "A" <= word[0] <= "Z":
        return "NNP"
    return "NNS" if len(low) >= 4 and low[-1] == "s" and low[-2] != "s" else "NN"


class _Labels(dict):
    """Labels of words, made when first met. Links, mentions and hashtags are not kept, they rarely come again."""

    def __init__(self, label: Callable[[str, str], str]) -> None:
        self.label = label

    def __missing__(self, word: str) -> str:
        tag = word_tag(word)
        out = self.label(word, tag)
        if len(self) < MAX_WORDS and tag not in ("URL", "USR", "HT"):
            self[word] = out
        return out


def sentence_counts(texts: DataFrame, label: Callable[[str, str], str], separator: str = "") -> DataFrame:
    """(key, n): how many sentences of (text) have the same labels of words and tags, the key being the labels joined. Equal
    sentences are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(label)
        for batch in batches:
            counts = Counter(separator.join(map(labels.__getitem__, split_tokens(s))) for text in batch.column(0).to_pylist() for s in split_sentences(text))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["key", "n"])

    rows = texts.where("text IS NOT NULL").select("text").mapInArrow(run, "key STRING, n BIGINT")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))

"""Languages of texts and of the segments of mixed ones, by prediction by partial matching.

For each language of the labelled texts, and for all of them together, a byte context tree of variable order is counted
and then frozen. A symbol that a context has seen n times out of N, with d distinct symbols, costs -log2(n / (N + d))
bits there; an unseen one costs the escape -log2(d / (N + d)) and is coded by the next shorter context, down to a uniform
byte. Contexts begin at the space before a word and the space after it is coded too, so a word's code length in every
language is a fixed vector: it is worked out once for each distinct token that a worker meets, and texts are sums over
their tokens. A language may also escape from a whole word, at FOREIGN_BITS, to the tree of all languages, as one strange
name would else outweigh a clause; a token that repeats the one before is coded by that alone, at no cost that depends on
the language. Within these rules code lengths are exact.

A text is first given to the language that codes it shortest. Where a run of its words is coded shorter by another
language, by more than two switches cost, the text is cut by the cheapest path through (word, language), with
SWITCH_BITS for each change. A segment counts if it can be a clause: enough words, not spelled as a title.
Tags, mentions, links, numbers, emoji, laughter and pieces without letters carry no bits; odd characters are read as
what they look like.

Null, empty and blank texts, and texts without a clause, have no segment. Repeated rows of a record give equal rows.
Without labelled texts no text has a language.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstframe.llm.confusables import consistent

ORDER = 5
SWITCH_BITS = 16.0
#: Cost of coding a word by the tree of all languages: one word of 256 is no word of the language it stands in.
FOREIGN_BITS = 8.0
#: A text needs so many words to have a language.
LEAST_WORDS = 3
#: A segment of a mixed text is a clause if it has so many words, distinct ones known from the labelled texts of its
#: language, and of those ones that are not capitalised as in a title.
CLAUSE_WORDS, CLAUSE_KNOWN, CLAUSE_PLAIN = 4, 3, 2
#: Labelled rows that are read for the model at most, and bytes of each language.
MAX_ROWS, MAX_BYTES = 50_000, 2_000_000
MAX_TOKENS = 500_000
#: Codes (ISO 639) and English names.
NAMES = {
    "en": "en eng english", "es": "es spa spanish castilian", "pt": "pt por portuguese", "fr": "fr fra fre french", "de": "de deu ger german",
    "it": "it ita italian", "nl": "nl nld dut dutch flemish", "id": "id ind in indonesian", "ru": "ru rus russian",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
#: Links, dotted names, mentions, tags, entities and what has digits. Runs are only tried from where they begin, so that
#: even a piece of very many characters takes as many steps.
_SKIP = re.compile(r"https?:\S*|www\.\S+|\(at\)|(?<![\w+-])[\w+-]+(?:\.[\w-]+)+|[@#$]\w+|&#?\w+;|(?<![^\W_])[^\W_]*\d\w*")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*")
#: Laughter and shorthand without a language.
_LAUGH = re.compile(r"(?:[aeh]*(?:h[aeiou]){2,}h?|(?:ja){2,}j?|(?:k){3,}|(?:rs){2,}|(?:wk)+w?|lo+l|lmf?ao|rofl|x+d+|rt|omg|wtf|(?:хa|ха){2,}х?|haha\w*|mdr+|hmm+|o+h+|a+h+)")


#: A word of more letters than this with at most so many different ones is laughter or a stretched sound.
LONG_LAUGH, LAUGH_LETTERS = 100, 4


def _readable(token: str) -> str:
    """A token as it is read, without the pieces that belong to no language: of addresses nothing is left."""
    pieces = (consistent(token) or "").split()
    kept = (p for p in pieces if not ("[at]" in p or "[dot]" in p or "." in p[p.find("@", 1) + 2 : -1] and p.find("@", 1) > 0))
    return " ".join(_SKIP.sub(" ", p) for p in kept)


def _is_laugh(word: str) -> bool:
    return len(set(word)) <= LAUGH_LETTERS if len(word) > LONG_LAUGH else bool(_LAUGH.fullmatch(word))


def label_language(label: str | None) -> str | None:
    """The language that a label names, by code or English name, with or without region; else null."""
    return next((_BY_NAME[p] for p in re.split(r"[^a-z]+", (label or "").lower()) if p in _BY_NAME), None)


class ContextTrees:
    """The trees of the languages as one table: a row of bits by context and symbol, one for each language and one for all."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER) -> None:
        self.order = order
        self.languages = tuple(sorted(code for code, own in texts.items() if own))
        self.known = {code: {w for t in texts[code] for w in _WORD.findall(t.lower())} for code in self.languages}
        counts: list[dict[bytes, int]] = []
        every: dict[bytes, int] = defaultdict(int)
        for code in self.languages:
            seen: dict[bytes, int] = defaultdict(int)
            for word, n in self.words(texts[code]).items():
                for i in range(1, len(word)):
                    for k in range(min(order, i) + 1):
                        seen[word[i - k : i + 1]] += n
                        every[word[i - k : i + 1]] += n
            counts.append(seen)
        counts.append(every)
        total: list[dict[bytes, int]] = [defaultdict(int) for _ in counts]
        kinds: list[dict[bytes, int]] = [defaultdict(int) for _ in counts]
        for lang, seen in enumerate(counts):
            for key, n in seen.items():
                total[lang][key[:-1]] += n
                kinds[lang][key[:-1]] += 1
        contexts = sorted({c for t in total for c in t}, key=len)
        keys = sorted({k for c in counts for k in c}, key=len)
        rows: list[list[float]] = [[8.0] * len(counts)]  # row 0: a uniform byte
        self.escape: dict[bytes, int] = {}
        self.symbol: dict[bytes, int] = {}
        for context in contexts:
            self.escape[context] = len(rows)
            rows.append([math.log2((t[context] + d[context]) / d[context]) if context in t else 0.0 for t, d in zip(total, kinds, strict=True)])
        for key in keys:
            context, shorter = key[:-1], rows[self.symbol.get(key[1:], 0) if len(key) > 1 else 0]
            escapes = rows[self.escape[context]]
            row = [
                math.log2((t[context] + d[context]) / c[key]) if key in c else e + s
                for c, t, d, e, s in zip(counts, total, kinds, escapes, shorter, strict=True)
            ]
            self.symbol[key] = len(rows)
            rows.append(row)
        self.bits = np.array(rows, dtype=np.float32)

    @staticmethod
    def words(texts: list[str]) -> dict[bytes, int]:
        out: dict[bytes, int] = defaultdict(int)
        for text in texts:
            for w in _WORD.findall(text.lower()):
                out[coded(w)] += 1
        return out

    def rows_of(self, word: bytes) -> list[int]:
        """The rows of `bits` whose sum is the code length of the word."""
        out, symbol, escape, order = [], self.symbol, self.escape, self.order
        for i in range(1, len(word)):
            for k in range(min(order, i), -1, -1):
                row = symbol.get(word[i - k : i + 1])
                if row is not None:
                    out.append(row)
                    break
                row = escape.get(word[i - k : i])
                if row is not None:
                    out.append(row)
            else:
                out.append(0)
        return out


def coded(word: str) -> bytes:
    return b" " + word.replace("’", "'").encode("utf-8", "replace") + b" "


class Reader:
    """Reads texts with the trees; keeps what it has worked out for tokens."""

    def __init__(self, trees: ContextTrees) -> None:
        self.trees, self.languages = trees, trees.languages
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.bits = np.zeros((1 << 12, len(self.languages)), np.float32)
        self.words = np.zeros(1 << 12, np.int32)
        self.titled = np.zeros(1 << 12, bool)

    def _learn(self, tokens: list[str]) -> None:
        new = [t for t in dict.fromkeys(tokens) if t not in self.ids]
        start = len(self.ids)
        while start + len(new) > len(self.words):
            self.bits = np.concatenate((self.bits, np.zeros_like(self.bits)))
            self.words = np.concatenate((self.words, np.zeros_like(self.words)))
            self.titled = np.concatenate((self.titled, np.zeros_like(self.titled)))
        rows: list[int] = []
        firsts: list[int] = []
        at: list[int] = []
        for n, token in enumerate(new, start):
            self.ids[token] = n
            found = [w for w in _WORD.findall(_readable(token)) if not _is_laugh(w.lower())]
            self.words[n] = len(found)
            self.titled[n] = bool(found) and all(w[0].isupper() and not w[1:2].isupper() for w in found)
            for w in found:
                own = self.trees.rows_of(coded(w.lower()))
                firsts.append(len(rows))
                rows += own
                at.append(n)
        if rows:
            words = np.add.reduceat(self.trees.bits[np.array(rows)], firsts, axis=0)
            words = np.minimum(words[:, :-1], words[:, -1:] + FOREIGN_BITS)
            np.add.at(self.bits, np.array(at), words - words.min(1, keepdims=True))  # what all languages pay decides nothing

    def tokens_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Token numbers of all texts in one array, and where each text begins in it."""
        if len(self.ids) > MAX_TOKENS:
            self.clear()
        pieces = [t.split() if t else [] for t in texts]
        flat = [p for ps in pieces for p in ps]
        missing = [p for p in flat if p not in self.ids]
        if missing:
            self._learn(missing)
        ids = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
        return ids, starts, pieces

    def bits_of(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The tokens' bits; of a token that comes several times in a row only the first counts."""
        bits = self.bits[ids].astype(np.float64)
        again = np.concatenate(([False], ids[1:] == ids[:-1])) if len(ids) else np.zeros(0, bool)
        again[starts[:-1][starts[:-1] < len(ids)]] = False
        bits[again] = 0
        return bits

    def candidates(self, bits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bits of each text, and whether a run of its words is coded shorter by another language by SWITCH_BITS."""
        n = len(starts) - 1
        filled = np.flatnonzero(np.diff(starts))
        totals = np.zeros((n, len(self.languages)))
        mixed = np.zeros(n, bool)
        if len(filled) == 0:
            return totals, mixed
        first = starts[:-1][filled]
        totals[filled] = np.add.reduceat(bits, first, axis=0)
        best = totals.argmin(1)
        text = np.repeat(np.arange(n), np.diff(starts))
        own = bits[np.arange(len(bits)), best[text]]
        far = 100.0 + bits.max() * np.diff(starts).max()
        drop = np.zeros(len(bits))
        drop[first] = far  # each text starts far below the one before it, so that running minima begin anew
        for lang in range(len(self.languages)):
            before = np.concatenate(([0.0], np.cumsum(own - bits[:, lang] - drop)))
            low = before[:-1].copy()
            low[first] -= far
            gain = before[1:] - np.minimum.accumulate(low)
            mixed[filled] |= np.maximum.reduceat(gain, first) > SWITCH_BITS
        return totals, mixed

    def cut(self, bits: np.ndarray) -> list[tuple[int, int, int]]:
        """(language, first token, end) of the cheapest path."""
        cost = bits[0].copy()
        back = np.empty(bits.shape, np.int64)
        stay = np.arange(len(self.languages))
        for i in range(1, len(bits)):
            low = int(cost.argmin())
            change = cost[low] + SWITCH_BITS < cost
            back[i] = np.where(change, low, stay)
            cost = np.where(change, cost[low] + SWITCH_BITS, cost) + bits[i]
        lang, end, out = int(cost.argmin()), len(bits), []
        for i in range(len(bits) - 1, 0, -1):
            if back[i][lang] != lang:
                out.append((lang, i, end))
                lang, end = int(back[i][lang]), i
        return [(lang, 0, end), *out[::-1]]

    def is_clause(self, tokens: list[str], lang: int) -> bool:
        words = [w for t in tokens for w in _WORD.findall(_readable(t))]
        known = {w.lower() for w in words} & self.trees.known[self.languages[lang]]
        plain = sum(w.lower() in known and (w[0].islower() or (len(w) > 1 and w.isupper())) for w in words)
        return len(words) >= CLAUSE_WORDS and len(known) >= CLAUSE_KNOWN and plain >= CLAUSE_PLAIN

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float, str]]]:
        """(language, confidence, words) of the segments of each text."""
        if not self.languages:
            return [[] for _ in texts]
        ids, starts, pieces = self.tokens_of(texts)
        bits = self.bits_of(ids, starts)
        totals, mixed = self.candidates(bits, starts)
        counts = np.concatenate(([0], np.cumsum(self.words[ids])))
        plain = np.concatenate(([0], np.cumsum(np.where(self.titled[ids], 0, self.words[ids]))))
        enough = (counts[starts[1:]] - counts[starts[:-1]] >= LEAST_WORDS) & (plain[starts[1:]] > plain[starts[:-1]])
        best = totals.argmin(1)
        sure = confidence(totals)
        out: list[list[tuple[str, float, str]]] = []
        for i, tokens in enumerate(pieces):
            own: list[tuple[str, float, str]] = []
            if enough[i]:
                if mixed[i]:
                    part = bits[starts[i] : starts[i + 1]]
                    for lang, a, b in self.cut(part):
                        if self.is_clause(tokens[a:b], lang):
                            own.append((self.languages[lang], float(confidence(part[a:b].sum(0, keepdims=True))[0]), " ".join(tokens[a:b])))
                if len({s[0] for s in own}) < 2:
                    code = own[0][0] if own else self.languages[best[i]]
                    own = [(code, own[0][1] if own else float(sure[i]), " ".join(tokens))]
            out.append(own)
        return out


def confidence(bits: np.ndarray) -> np.ndarray:
    """The share of the best language if each has 2 ** -bits."""
    return 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)


_READERS: dict[str, Reader] = {}


def _reader(trees: ContextTrees, key: str) -> Reader:
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(trees)
    return _READERS[key]


def train(corpus: DataFrame) -> ContextTrees:
    """Trees from (lang, text), on the driver; at most MAX_ROWS rows, chosen by hash, and MAX_BYTES of each language."""
    rows = corpus.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").orderBy(F.xxhash64("text"), "text").limit(MAX_ROWS)
    texts: dict[str, list[str]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for row in rows.toLocalIterator():
        code = label_language(row.lang) or row.lang.strip().lower()
        if code and size[code] < MAX_BYTES:
            texts[code].append(row.text)
            size[code] += len(row.text.encode())
    return ContextTrees(texts)


_SEGMENT = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.string())])


def identify(records: DataFrame, trees: ContextTrees, words: bool = True) -> DataFrame:
    """(src, rec_id, label_lang, segments) for rows with src, rec_id, label and text.

    label_lang is the language that the label names, or null; segments has lang, confidence and, if asked for, words.
    """
    shared = records.sparkSession.sparkContext.broadcast(trees)  # bounded by MAX_BYTES
    key = f"{id(trees)}-{len(trees.bits)}-{float(trees.bits.sum())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value, key)
        for batch in batches:
            found = reader.segments(batch.column(3).to_pylist())
            labels = [label_language(x) or ((x or "").strip().lower() if (x or "").strip().lower() in reader.languages else None) for x in batch.column(2).to_pylist()]
            rows = [[{"lang": g, "confidence": c, "words": w if words else None} for g, c, w in own] for own in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(rows, pa.list_(_SEGMENT))],
                ["src", "rec_id", "label_lang", "segments"],
            )

    return records.select("src", "rec_id", "label", "text").mapInArrow(
        run, "src STRING, rec_id STRING, label_lang STRING, segments ARRAY<STRUCT<lang: STRING, confidence: DOUBLE, words: STRING>>"
    )


def wrong_labels(identified: DataFrame) -> DataFrame:
    """(src, rec_id, lang), distinct: texts in several languages, and texts in one that their label does not name."""
    langs = F.array_distinct("segments.lang")
    case = (F.size(langs) > 1) | ((F.size(langs) == 1) & ~F.get(langs, F.lit(0)).eqNullSafe(F.col("label_lang")))
    return identified.where(case).select("src", "rec_id", F.explode(langs).alias("lang")).distinct()


def tweet_and_document_texts(raw: DataFrame, documents: DataFrame) -> DataFrame:
    """All rows; a record's rows repeat its text and label, so they need no shuffle before they are read."""
    tweets = raw.select(F.lit("raw_tweet").alias("src"), F.col("id_str").alias("rec_id"), F.col("lang").alias("label"), "text")
    docs = documents.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), F.col("lang").alias("label"), "text")
    return tweets.unionByName(docs).where("rec_id IS NOT NULL")

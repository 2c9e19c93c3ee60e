"""Texts that stop before the end of what was written, and how often each source cuts.

The vocabulary of the corpus is a trie, kept as a table of its nodes: the hash of each prefix with the words below it. A
text is cut if what it ends in, without dots and the link that a cutting source adds, is
- a mark that only a break leaves: half a character, escape or entity, an open bracket, a hyphen inside a word, a bare link;
- a word, tag or number that is next to unknown against the words of which it is a proper prefix;
- words that the corpus next to never ends a sentence with, judged by the last two, backed by the last one;
- or any words without a full stop, if the length is one at which the source cuts. It cuts at a length, in characters or
  bytes and with one style of ending, if most of its texts that end there without punctuation are cut by the rules above.

All but the last need shares only, no absolute counts, so they decide alike in a small and in a large corpus.

Null, empty and blank texts are no cases. A null source is judged by the lengths at which all sources together cut.
Whole texts are read, in one pass that gives their endings and the counts of the corpus. Endings are read as what they
look like, odd characters or not. Repeated texts count for themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from burstframe.llm.confusables import consistent
from burstframe.session import cut

#: A last word is unknown if it occurs less than UNKNOWN times as often as the words of which it is a proper prefix, and
#: suspect below SUSPECT; there must be LEAST_BELOW of these.
UNKNOWN, SUSPECT, LEAST_BELOW = 0.05, 0.2, 4
#: Words that end less than NEVER of the sentences they stand in are cut after; a suspect word is, below SELDOM. Shares are
#: smoothed by BACKOFF occurrences of the shorter run.
NEVER, SELDOM, BACKOFF = 0.05, 0.3, 2.0
#: A length is a limit if so many texts, and such a share of them, are cut there.
LIMIT_TEXTS, LIMIT_SHARE = 4, 0.6
#: Entries that a task combines before it hands them on, and tokens that a worker keeps.
MAX_ENTRIES, MAX_TOKENS = 200_000, 500_000
#: Parts that the texts with one ending are spread over.
SALTS = 8
#: Chunks between spaces that the patterns of endings reach back at most: a signature of twenty characters, and more.
CHUNKS = 12

_TOKEN = re.compile(r"https?:\S*|(?<!\w)[@#$]\w+|[^\W_]+(?:['’-][^\W_]+)*|[.!?…]+|\n+|[^\s\w]|_")
_MARK = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\u00[0-9a-fA-F]{2}|&#?\w{0,6}|\s[\[{]|\w-|https?:(?:/{0,2}|//[\w.-]*/?\w{0,2}))$")
_LINK = re.compile(r"\s*https?://[\w.-]+\.\w+/\w{3,}$")
_DOTS = re.compile(r"\s?(…|(?<!\.)\.{3,})$")
_TAG = re.compile(r"(?:^|\s)([#$]\w+)$")
_NO_WORD = re.compile(r"https?://\S+$|(?<!\w)@\w+$|\d/\d$|-- [\w ]{1,20}$|[<:;=][\w]$")
_WORD_END = re.compile(r"\w$")
WORD, FULL_STOP, DOTS, OTHER, TAG, BREAK = range(6)
#: Numbers and names inside a sentence stand for each other; <s> is the beginning of a sentence.
_NUMBER, _NAME, _PAD = "<d>", "<n>", "<s>"
_SEED, _FACTOR, _MASK = 1469598103934665603, 1099511628211, (1 << 64) - 1


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A key of two words, from their hashes."""
    return (before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ last


def prefix_hashes(word: str) -> list[int]:
    """A hash of each prefix, the word itself included, in steps as many as it has characters."""
    return [_signed(h) for h in accumulate(map(ord, word), lambda h, c: ((h ^ c) * _FACTOR) & _MASK, initial=_SEED)][1:]


def _kind(token: str) -> int:
    if token[0] in ".!?…\n":
        return DOTS if token[0] == "…" or token.startswith("..") else FULL_STOP
    if token[0] in "#$" and len(token) > 1:
        return TAG
    return WORD if token[0].isalnum() and not token.startswith(("http:", "https:")) else OTHER


def _class(token: str, first: bool) -> str:
    if token[0].isdigit():
        return _NUMBER
    return _NAME if token[0].isupper() and not first and token[1:].islower() else token.lower()


def _last_words(tokens: list[str]) -> tuple[str, str, str, bool]:
    """The last word, the classes of the last two of its sentence, and whether that sentence's beginning, or enough, was seen."""
    words, first, last, sure = [_PAD, _PAD], True, "", False
    for token in tokens:
        kind = _kind(token)
        if kind == WORD:
            words.append(_class(token, first))
            first, last = False, token.lower()
            sure = sure or len(words) > 5
        elif kind in (FULL_STOP, DOTS):
            words, first, sure = [_PAD, _PAD], True, True
        else:
            first = True
    return last, words[-2], words[-1], sure


def tail_of(text: str) -> tuple[str, str, str, str, str] | None:
    """(kind, style, last token, the last two words) of a text; None for a blank one.

    kind: mark, ended, word or tag. style: how the text ends beyond its words. The patterns look at the last CHUNKS chunks
    between spaces, however long these are; a word's sentence is followed back as far as needed.
    """
    end = text.rstrip()
    before = end.rsplit(None, CHUNKS)
    piece = end[len(before[0]) :] if len(before) > CHUNKS else end
    whole = (consistent(piece) or "").rstrip()
    if not whole:
        return None if piece is end else tail_of(end[: len(end) - len(piece)])
    if _MARK.search(whole):
        return ("mark", "", "", _PAD, _PAD)
    core, style = whole, ""
    link = _LINK.search(core)
    if link and core[: link.start()].endswith(("…", "...")):
        core, style = core[: link.start()], "link"
    dots = _DOTS.search(core)
    if dots and len(dots[1]) < 4:
        core, style = core[: dots.start()].rstrip(), dots[1] + style
    elif style:
        core, style = whole, ""
    tag = _TAG.search(core)
    if tag:
        return ("tag", style, tag[1].lower(), _PAD, _PAD)
    if not core or not _WORD_END.search(core) or _NO_WORD.search(core):
        return ("ended", style, "", _PAD, _PAD)
    last, w2, w1, sure = _last_words(_TOKEN.findall(core))
    if not sure and piece is not end:
        _, w2, w1, _ = _last_words(_TOKEN.findall((consistent(end[: len(end) - len(piece)]) or "") + core))
    return ("word", style, last, w2, w1)


class Tokens(dict):
    """Numbers of tokens, with what is known of each; a token is looked at when first met."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.hashes: list[int] = []
        self.inside: list[int] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self.names)
        kind = BREAK if token == "\0" else _kind(token)
        self.names.append(token.lower())
        self.kinds.append(kind)
        self.hashes.append(_hash(_class(token, True)) if kind == WORD else 0)
        self.inside.append(_hash(_class(token, False)) if kind == WORD else 0)
        return number


def _runs(ids: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, key, ended, went on) of the places after a word that end a sentence or go on, one row for each order."""
    kinds = np.array(tokens.kinds, np.int8)[ids]
    word = kinds == WORD
    first = np.concatenate(([True], ~word[:-1]))
    key = np.where(first, np.array(tokens.hashes, np.uint64)[ids], np.array(tokens.inside, np.uint64)[ids])
    after = np.concatenate((kinds[1:], [BREAK]))
    used = word & ((after == WORD) | (after == FULL_STOP))
    # The word before is that of the same sentence, whatever marks stand between.
    steps = np.flatnonzero(word | np.isin(kinds, (FULL_STOP, DOTS, BREAK)))
    before = np.full(len(ids), _hash(_PAD), np.uint64)
    before[steps[1:]] = np.where(word[steps[:-1]], key[steps[:-1]], np.uint64(_hash(_PAD)))
    ended = (after[used] == FULL_STOP).astype(np.int64)
    keys = np.concatenate((key[used], _pair(before[used], key[used])))
    order = np.repeat(np.array([1, 2], np.int8), len(ended))
    return order, keys, np.tile(ended, 2), np.tile(1 - ended, 2)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    order, keys, ended, on = (np.concatenate(x) for x in zip(*parts, strict=True))
    # An order-1 key cannot be taken for one of order 2: its lowest bit is set, and that of the others is not.
    mixed = np.where(order == 1, keys | np.uint64(1), keys & ~np.uint64(1))
    unique, place = np.unique(mixed, return_inverse=True)
    count = lambda x: np.bincount(place, x, len(unique)).astype(np.int64)
    return np.where(unique & np.uint64(1), 1, 2).astype(np.int8), unique, count(ended), count(on)


_KEPT = Tokens()
_COLUMNS = {
    "row": pa.string(), "doc_id": pa.int64(), "source": pa.string(), "n_chars": pa.int32(), "n_bytes": pa.int32(), "kind": pa.string(), "style": pa.string(),
    "last": pa.string(), "k2": pa.int64(), "k1": pa.int64(), "ended": pa.int64(), "went_on": pa.int64(),
}
_READ_DDL = (
    "row STRING, doc_id BIGINT, source STRING, n_chars INT, n_bytes INT, kind STRING, style STRING, last STRING, k2 BIGINT, k1 BIGINT, ended BIGINT, went_on BIGINT"
)


def _rows(n: int, row: str, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [pa.array([row] * n, pa.string()) if name == "row" else columns.get(name, pa.nulls(n, kind)) for name, kind in _COLUMNS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))


def _key(order: int, *words: str) -> int:
    """The key of a run of words, as _runs and _summed make it."""
    with np.errstate(over="ignore"):
        h = [np.array([_hash(w)], np.uint64) for w in words]
        key = int((h[0] if order == 1 else _pair(h[0], h[1]))[0])
    return _signed(key | 1 if order == 1 else key & ~1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows tail (of each text), token (counts of words and tags, all but the last of each text) and run (of one word or
    two, by key: how often it ends a sentence and goes on); kind is the order of a run."""
    tokens = _KEPT
    words: Counter[str] = Counter()
    runs: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if runs:
            order, keys, ended, on = _summed(runs)
            yield _rows(len(keys), "run", kind=pa.array(order.astype(str)), k1=pa.array(keys.view(np.int64)), ended=pa.array(ended), went_on=pa.array(on))
        if words:
            yield _rows(len(words), "token", last=pa.array(list(words), pa.string()), ended=pa.array(list(words.values()), pa.int64()))
        runs.clear()
        words.clear()
        held = 0

    for batch in batches:
        texts = batch.column(4).to_pylist()
        found = [tail_of(t) for t in texts]
        kept = [i for i, x in enumerate(found) if x]
        tails = batch.take(pa.array(kept, pa.int64()))
        own = [found[i] for i in kept]
        columns = {name: tails.column(i) for i, name in enumerate(("doc_id", "source", "n_chars", "n_bytes"))}
        columns |= {name: pa.array([x[i] for x in own], pa.string()) for i, name in enumerate(("kind", "style", "last"))}  # type: ignore[index]
        columns |= {"k2": pa.array([_key(2, x[3], x[4]) for x in own], pa.int64()), "k1": pa.array([_key(1, x[4]) for x in own], pa.int64())}  # type: ignore[index]
        yield _rows(len(own), "tail", **columns)
        if len(tokens) > MAX_TOKENS:
            tokens.__init__()  # type: ignore[misc]
        joined = " \0 ".join([t.rstrip().replace("\0", " ") for t in texts])
        ids = np.fromiter(map(tokens.__getitem__, _TOKEN.findall(joined)), np.int64)
        if not len(ids):
            continue
        with np.errstate(over="ignore"):
            runs.append(_runs(ids, tokens))
        kinds = np.array(tokens.kinds, np.int8)[ids]
        counted = np.isin(kinds, (WORD, TAG)) & (np.concatenate((kinds[1:], [BREAK])) != BREAK)
        numbers = np.bincount(ids[counted], minlength=0)
        for i in np.flatnonzero(numbers).tolist():
            words[tokens.names[i]] += int(numbers[i])
        held += len(runs[-1][0])
        if held > 4 * MAX_ENTRIES:
            runs[:] = [_summed(runs)]
            held = len(runs[0][0])
        if held > MAX_ENTRIES * 2 or len(words) > MAX_ENTRIES:
            yield from flush()
    yield from flush()


def read_texts(documents: DataFrame) -> DataFrame:
    """The rows of _read over all texts, written once: endings, and counts that each task has combined."""
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.char_length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), "text"
    )
    return cut(texts.mapInArrow(_read, _READ_DDL))


def vocabulary_trie(words: DataFrame) -> DataFrame:
    """(node, below) of words (last, known): how often words occur of which a prefix is a proper one, by its hash."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [prefix_hashes(w)[:-1] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int64()))], ["known", "nodes"])

    rows = words.select("last", "known").mapInArrow(nodes, "known BIGINT, nodes ARRAY<BIGINT>")
    return rows.select("known", F.explode("nodes").alias("node")).groupBy("node").agg(F.sum("known").alias("below"))


@F.pandas_udf(LongType())
def _node(words: pd.Series) -> pd.Series:
    return words.map(lambda w: prefix_hashes(w)[-1])


def _judged(combos: DataFrame, rows: DataFrame) -> DataFrame:
    """combos (kind, last, k2, k1), distinct, with why: trie or words if those decide, else null."""
    words = cut(rows.where("row = 'token'").groupBy("last").agg(F.sum("ended").alias("known")))
    runs = cut(rows.where("row = 'run'").groupBy("kind", "k1").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on")))
    every = runs.where("kind = '1'").agg((F.sum("ended") / F.sum(F.col("ended") + F.col("went_on"))).alias("every"))  # one row
    out = combos.join(words, "last", "left").withColumn("node", _node("last"))
    out = out.join(vocabulary_trie(words), "node", "left").crossJoin(F.broadcast(every))
    for k in (1, 2):
        own = runs.where(F.col("kind") == str(k)).select(F.col("k1").alias(f"k{k}"), F.col("ended").alias(f"ended{k}"), F.col("went_on").alias(f"went_on{k}"))
        out = out.join(own, f"k{k}", "left")
    out = out.fillna(0, ["known", "below", "ended1", "went_on1", "ended2", "went_on2", "every"])
    share = F.col("every")
    for k in (1, 2):
        share = (F.col(f"ended{k}") + BACKOFF * share) / (F.col(f"ended{k}") + F.col(f"went_on{k}") + BACKOFF)
    out = out.withColumn("share", share)
    held = F.col("below") >= LEAST_BELOW
    unknown = held & (F.col("known") < UNKNOWN * F.col("below"))
    suspect = held & (F.col("known") < SUSPECT * F.col("below")) & (F.col("share") < SELDOM)
    never = (F.col("share") < NEVER) & (F.col("known") > 0)
    rule = F.when(unknown, "trie").when((F.col("kind") == "word") & suspect, "trie").when((F.col("kind") == "word") & never, "words")
    return out.select("kind", "last", "k2", "k1", rule.alias("why"))


def judged_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, source, why) of every text that is not blank: mark, trie, words or length if it is cut, else null."""
    rows = read_texts(documents)
    ends = rows.where("row = 'tail'")
    keys = ["kind", "last", "k2", "k1"]
    words = ends.where("kind IN ('word', 'tag')").select("doc_id", "source", "style", "n_chars", "n_bytes", *keys)
    decided = _judged(words.select(*keys).distinct(), rows).where("why IS NOT NULL")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # the same few words end very many texts
    words = words.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    known = cut(words.join(decided.select(*keys, "why", salts), [*keys, "salt"], "left").drop("salt", "last", "k2", "k1"))
    opened = known.where("kind = 'word'")
    undecided = opened.where("why IS NULL")
    share = F.avg(F.col("why").isNotNull().cast("int"))
    for size in ("n_chars", "n_bytes"):
        own = opened.groupBy("source", "style", size).agg(F.count(F.lit(1)).alias("n"), share.alias("share"))
        every = opened.groupBy("style", size).agg(F.count(F.lit(1)).alias("n"), share.alias("share")).withColumn("source", F.lit(None).cast("string"))
        limits = own.where("source IS NOT NULL").unionByName(every).where((F.col("n") >= LIMIT_TEXTS) & (F.col("share") >= LIMIT_SHARE))
        limits = limits.select(F.col("source").alias("s"), F.col("style").alias("t"), F.col(size).alias("z"), F.lit("length").alias(f"at_{size}"))
        match = undecided.source.eqNullSafe(limits.s) & (undecided.style == limits.t) & (undecided[size] == limits.z)
        undecided = undecided.join(limits, match, "left").drop("s", "t", "z")
    others = ends.where("kind NOT IN ('word', 'tag')").select("doc_id", "source", F.when(F.col("kind") == "mark", "mark").alias("why"))
    surely = known.where("kind <> 'word' OR why IS NOT NULL").select("doc_id", "source", "why")
    return surely.unionByName(others).unionByName(undecided.select("doc_id", "source", F.coalesce("at_n_chars", "at_n_bytes").alias("why")))


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id), distinct."""
    return judged_tails(documents).where("why IS NOT NULL").select("doc_id").distinct()


def cut_sources(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, cut_share, n_mark, n_trie, n_words, n_length) over the texts that are not blank; null
    sources are one group. The last four say which rule decided."""
    n, n_cut = F.count(F.lit(1)), F.count("why")
    rules = [F.count_if(F.col("why") == w).alias(f"n_{w}") for w in ("mark", "trie", "words", "length")]
    return judged_tails(documents).groupBy("source").agg(n.alias("n_documents"), n_cut.alias("n_cut"), F.round(n_cut / n, 6).alias("cut_share"), *rules)

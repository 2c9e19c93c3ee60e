"""Byte-pair encoding of whole texts by a transducer that is determinised as texts are read.

The merges are compiled into what a left-to-right reader needs: a byte trie of the tokens, and the relation of tokens
that may follow each other, which holds if encoding the two together gives just the two. Every prefix of a piece then
has exactly one last token, so the encodings of all prefixes that can still matter form a tree. A state is that tree
without what all its branches share: for each place where an unfinished token may have begun, the trie node reached and
the tokens pending before it. Reading a byte leads to the next state and emits the tokens that all branches now share.
States and arcs are made when first needed and kept; the longest token bounds the lookahead.

Null, empty and blank texts: null and empty give an empty list, blank ones their ids. Strings that look like special
tokens are ordinary text. Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies if neither a path nor the session's spark.burstframe.vocabulary names it.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what one worker keeps; beyond them the automaton and the pieces are made anew, with the same results.
MAX_STATES = 200_000
MAX_PIECES = 200_000


class BpeTransducer:
    """Pieces of bytes to token ids, for the merges given by the ranks of the tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.follows: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.reset()

    def reset(self) -> None:
        #: A state: the last token emitted (-1 at the start) and its branches, (trie node, tokens pending).
        start = (-1, ((0, ()),))
        self.states: list[tuple] = [start]
        self.index = {start: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def by_merges(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent parts of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) + 1), i) for i in range(len(parts) - 1))
            if rank > len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """left is -1 at the start of a piece: then the question is whether right encodes as itself."""
        known = self.follows.get((left, right))
        if known is None:
            want = [right] if left < 0 else [left, right]
            known = self.follows[left, right] = self.by_merges(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens emitted on the way."""
        last, branches = self.states[state]
        alive: list[tuple[int, tuple[int, ...]]] = []
        ended: tuple[int, ...] | None = None
        for node, pending in branches:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and ended is None and self.may_follow(pending[-1] if pending else last, token) and self.may_follow(-1, token):
                ended = (*pending, token)
            if self.children[nxt]:
                alive.append((nxt, pending))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((0, ended))
        shared = 0
        shortest = min(len(p) for _, p in alive)
        while shared < shortest and all(p[shared] == ended[shared] for _, p in alive):
            shared += 1
        emitted = ended[:shared]
        new = (emitted[-1] if emitted else last, tuple((n, p[shared:]) for n, p in alive))
        where = self.index.get(new)
        if where is None:
            where = self.index[new] = len(self.states)
            self.states.append(new)
        return where, emitted

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self.reset()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in data:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = arcs[state << 8 | byte] = self.step(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        return (*out, *self.states[state][1][-1][1])


class Utf8Reader:
    """Token bytes to text as they come: a state machine that keeps an unfinished character between calls."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.point = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.point, self.low, self.high = self.point << 6 | byte & 0x3F, 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte < 0xF5:
                self.need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.point = byte & (0x3F >> self.need)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def parse_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}


class Encoder:
    def __init__(self, file: bytes) -> None:
        self.transducer = BpeTransducer(parse_ranks(file))
        self.find = regex.compile(PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode())
                if len(known) > MAX_PIECES:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        reader = Utf8Reader()
        return "".join(reader.feed(self.transducer.bytes_of[i]) for i in ids) + reader.end()


@lru_cache(2)
def encoder(file: bytes) -> Encoder:
    """One for each worker and vocabulary; workers are used again for later tasks."""
    return Encoder(file)


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The driver's copy is sent to the executors: under 1 MB, whatever the data."""
    with open(path, "rb") as f:
        return f.read()


def _rows(batches: Iterator[pa.RecordBatch], file: bytes, lists: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(file).encode
    for batch in batches:
        ids = [encode(t) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        if lists:
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = np.fromiter((i for row in ids for i in row), np.int32, int(sizes.sum()))
            column: pa.Array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        else:
            column = pa.array(sizes.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "ids" if lists else "n_tokens"])


def _encoded(df: DataFrame, key: str, text: str, path: str, lists: bool) -> DataFrame:
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    pairs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {pairs.schema['id'].dataType.simpleString()}, " + ("ids ARRAY<INT>" if lists else "n_tokens INT")
    return pairs.mapInArrow(lambda batches: _rows(batches, file.value, lists), schema).withColumnRenamed("id", key)


def token_ids(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row, without special tokens."""
    return _encoded(df, key, text, path, lists=True)


def token_counts(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""
    return _encoded(df, key, text, path, lists=False)


def decoded(df: DataFrame, key: str, ids: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) of rows with token ids; null and empty lists give an empty text."""
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    pairs = df.select(F.col(key).alias("id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(file.value).decode
        for batch in batches:
            texts = [decode(own) if own else "" for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return pairs.mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, text STRING").withColumnRenamed("id", key)

"""Personal data in free text: finding it, and replacing it by placeholders or by surrogates.

Kinds: email, phone, id_number, street (with its house number) and person (given name or initial, with the surname).
Texts are searched in the form a reader sees (width, accents, invisible and look-alike characters), and each find is the
exact piece of the stored text. Persons need a surname: surnames are learned from
the users' own names, and so is what stands before them; a known given name before another capitalised word will do too.

Every find gets a surrogate, made by a keyed hash and checked: digits stay digits and letters letters of the same case and
script; an email gets another local part at a reserved domain (its own if that is reserved). A person is replaced word by
word, so that the same surname or given name has the same surrogate wherever it stands: a listed given name becomes one
of the same language and gender, by a keyed permutation, any other word a drawn one. An initial becomes the initial of
the given name it stands for, if only one of that surname does, and else a letter that is free. Drawn surrogates that
collide, or equal a found entity, are drawn again for all but the first in order, and checked again until none do; late
draws are longer, so that a full space of short ones does not end this.

Null texts stay null, texts without finds are unchanged; a null src is a source like any other, rows without rec_id are left out. Repeated rows count once. An overlap goes to the earlier kind of
email, id_number, phone, street, person.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstframe.llm import confusables
from burstframe.llm.confusables import consistent, consistent_token
from burstframe.session import cut

KINDS = ("email", "id_number", "phone", "street", "person")
#: Surnames that are handed to every task at most; more are joined with the words of the texts, with the same result.
BROADCAST_SURNAMES = 100_000
#: Common given names that are borne by women, and by men; others have no known gender.
FEMININE = set(
    "amber anke anna anne arina barbara beatriz britta carmen catherine chiara chloé christine clara edith elena elisa elizabeth élodie emily emma eva faith "
    "femke francesca giulia grace greta hannah hazel heike helena ida inés inês irina isabel ivy jane joy julia juliette karin katarina laura lena linda lisa "
    "lucia lucía luísa luz manon mara maria maría marie martha mary natalia nieves nina nora olesya olga olivia paula pilar putri rafaela rocío rosa rose ruth "
    "sabine sanne sara sarah sari siti sofia solène sophie susan svetlana tatiana tessa ursula victoria wulan".split()
)
MASCULINE = set(
    "adrián alexander álvaro antoine antonio bagus benoît boris budi caio carlos charles colin daniel davi david davide dean dimas felipe felix francesco georg "
    "george gleb gonzalo hans henry hugo igor ivan iván jacques james jan javier jean jim joão johannes john joost jorge josé juan jürgen klaus lars loïc louis "
    "luca luis lukas marco mario mark martin mateo matteo max michael miguel miles moritz nicolas nicolò noé oleg oliver owen pablo paul pedro peter pierre "
    "pieter reed richard robert rubén rui sergei sören stefan thomas tiago tim timur tom vladimir willem will william wolfgang".split()
)

_ODD = re.compile("[ ­̀-֏  -‏ -  -⁯　ﬀ-ﬆ︀-️﻿！-～]")
_URL = re.compile(r"https?://\S+|(?<!\w)[@#]\w+", re.I)
_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w(?:@|\s?\(at\)\s?|\s?\[at\]\s?|\s(?:AT)\s)[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sDOT\s)[\w-]+)+"
)
#: What an identity number is called.
_ID_LABEL = (
    r"passport|pasaporte|passeport|reisepass(?:nummer)?|passaporte|passaporto|paspoort|paspor|ausweis|personalausweis|dni|nie|nif|ni|national insurance|"
    r"social security|ssn|tax|tin|id|id card|identity card|carte d['’]identité|sécu|sécurité sociale|steuer-?(?:id|nummer)|sozialversicherung(?:snummer)?|"
    r"versicherungsnummer|seguridad social|bsn|codice fiscale|cpf|ktp|nik|паспорт|инн|снилс"
)
_ID = re.compile(
    rf"(?<!\w)(?:{_ID_LABEL})(?:[ ,.:#-]+(?:id|number|no|nr|num|número|numéro|nummer|nº|n°|is|ist|est|es|es el))*[ ,.:#-]+"
    r"((?:[a-z]{1,3}[ -]?)?\d[\da-z]*(?:[ .‑-](?:[\da-z]*\d[\da-z]*|[a-z](?![^\W\d_])))*)",
    re.I,
)
_ID_PLAIN = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}-\d\d-\d{4})(?![\w-])")
_PHONE = re.compile(r"(?<![\w@+.,/-])(?:\+\d{1,3}[ .‑/-]?)?(?:\(\d{1,4}\)[ .‑/-]?)?\d+(?:[ .‑/-]\d+)*(?!\w)")
_US_PHONE = re.compile(r"(?:1[ .‑-])?[2-9]\d\d[ .‑-]?\d{3}[ .‑-]?\d{4}")
#: National numbers in three groups of three, as in Spain, Portugal and Poland.
_THREES = re.compile(r"[6-9]\d\d([ .])\d{3}\1\d{3}")
_DATE = re.compile(r"\d{4}[-./]\d\d[-./]\d\d|\d\d?[-./]\d\d?[-./]\d{4}")
_HOUSE = r"\d{1,4}(?: ?[a-d](?!\w))?(?:\s?[-–/]\s?\d{1,4}(?:[a-d](?!\w))?)?"
#: Words that are no part of a street's name, and units that make a number no house number.
_NO_NAME = (
    r"(?!(?:the|an?|and|but|so|because|since|while|then|for|of|in|on|at|with|from|to|by|is|was|are|my|our|your|this|that|o'clock|minutes?|hours?|times?|"
    r"las|los|al|às|as|à|ao|aos|um|om|ore|alle|verso|verte|pukul|около|gegen|nach|vor|seit|bei|und|aber|oder|para|porque|pero|mas|mais|et|y|e|u|o|"
    r"vers|heures?|horas?|minutos?|uhr|personas?)(?!\w))"
)
_UNIT = r"(?!\w|[.,:]\d| ?(?:uhr|o'clock|heures?|horas?|ore|uur|часов|minut|jam|%|€|\$))"
_NAME = rf"{_NO_NAME}[^\W\d_][\w'’-]*"
#: A further word of a name where nothing else ends it: capitalised, or the one that an adjective goes with.
_MORE = rf"(?:(?: (?-i:[A-ZÀ-ÝА-Я])[\w'’-]*)|(?:(?<=vieux)|(?<=vieil)|(?<=vieille)|(?<=grand)|(?<=grande)|(?<=petit)|(?<=petite)|(?<=saint)) {_NAME})"
_STREETS = [
    re.compile(p, re.I)
    for p in (
        # number before the name, type after it
        rf"(?<![\w.,/-]){_HOUSE},? (?:[NSEW]\.? )?(?:{_NAME} ){{1,2}}?(?:(?:lane|ln|road|rd|street|avenue|ave|drive|dr|close|court|ct|row|boulevard|blvd|terrace|way|crescent|square)\b|st\b\.?)",
        # number and type before the name
        rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter|[a-d])\b)?,? (?:rue|bd|boulevard|avenue|av\.?|chemin|impasse|place|quai|allée|cours|route|passage|square)\s(?:de la |de l['’]|des |du |de |d['’]|la |le |les )?{_NAME}{_MORE}?",
        # type, name, number
        rf"(?<!\w)(?:calle|c/|c\.|plaza|pza\.?|avenida|avda\.?|paseo|camino|ronda|travesía|rua|praça|via|viale|piazza|corso|jalan|jl\.?|улица|ул\.)\s?(?:de la |de los |de las |del |de |la |el |da |do |dos |das )?{_NAME}(?: {_NAME}){{0,2}}?,? ?(?:n[º°]\.?|n[úu]m\.?|no\.?|nr\.?)? ?{_HOUSE}{_UNIT}",
        rf"(?<![\w-])(?:(?:am|an der|an den|im|in der|auf der|auf dem|zum|zur|unter den) (?:(?:(?:alte|neue|obere|untere)[nrms]?|(?-i:[A-ZÄÖÜ][\w-]*)) )?{_NAME} |[^\W\d_][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|straat|gracht|plein),? (?:nr\.? )?){_HOUSE}{_UNIT}",
        # type with a genitive, name, number
        rf"(?<!\w)(?:straße|allee|platz|weg|ufer|promenade|brücke) (?:der|des|am|an der) {_NAME}(?: (?-i:[A-ZÄÖÜ])[\w-]*)?,? (?:nr\.? )?{_HOUSE}{_UNIT}",
    )
]
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
#: Titles before a name, which are no part of it.
_TITLES = set("dr mr mrs ms miss prof sir frau herr herrn señor señora sr sra don doña madame monsieur mme m dra".split())


@dataclass(frozen=True)
class Names:
    """given: lower-case given names with their language; surnames and common words, also in lower case. Without surnames
    of its own each text is searched with those that are handed to find_entities."""

    given: dict[str, str]
    surnames: frozenset[str]
    common: frozenset[str]


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text as it is seen, and for each of its characters the place in the stored text (None: the same)."""
    if not _ODD.search(text):
        return text, None
    table = confusables._tables()[0]
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if unicodedata.combining(c) and out:
            both = unicodedata.normalize("NFC", out[-1] + c)
            if len(both) == 1:
                out[-1] = both
                continue
        seen = table.get(ord(c), c)
        for x in seen or "":
            out.append(x)
            at.append(i)
    return re.sub(r"\w+", _same_length, "".join(out)), at


def _same_length(m: re.Match[str]) -> str:
    word = m[0]
    if word.isascii():
        return word
    other = consistent_token(word)
    return other if len(other) == len(word) else word


def _stored(text: str, at: list[int] | None, start: int, end: int) -> tuple[int, int]:
    """A place of the readable form in the stored text."""
    if at is None:
        return start, end
    last = at[end - 1] + 1
    while last < len(text) and unicodedata.combining(text[last]):
        last += 1
    return at[start], last


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return all(end <= a or start >= b for a, b in taken)


def _blank(text: str, start: int, end: int) -> str:
    return text[:start] + "\0" * (end - start) + text[end:]


def find(text: str, names: Names) -> list[tuple[str, int, int, str, str | None]]:
    """(kind, start, end, piece, surname) in the order of the text; start and end count characters of the stored text, and
    the surname of a person is given as it is read, in lower case."""
    seen, at = readable(text)
    found: list[tuple[str, int, int, str | None]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, start: int, end: int, surname: str | None = None) -> None:
        if _free(taken, start, end):
            found.append((kind, start, end, surname))
            taken.append((start, end))

    low = seen.lower()
    if "@" in seen or "at" in low:
        for m in _EMAIL.finditer(seen):
            add("email", *m.span())
    bare = _URL.sub(lambda m: "\0" * len(m[0]), seen) if "/" in seen or "@" in seen or "#" in seen else seen
    if any(c.isdigit() for c in bare):
        for m in _ID.finditer(bare):
            if _digits(m[1]) >= 5 and not _DATE.fullmatch(m[1]):
                add("id_number", *m.span(1))
        for m in _ID_PLAIN.finditer(bare):
            add("id_number", *m.span())
        for m in _PHONE.finditer(bare):
            n = _digits(m[0])
            if 9 <= n <= 15 and (m[0][0] in "+(0" or _US_PHONE.fullmatch(m[0]) or _THREES.fullmatch(m[0])):
                add("phone", *m.span())
        for pattern in _STREETS:
            for m in pattern.finditer(bare):
                add("street", *m.span())
    for start, end in taken:
        bare = _blank(bare, start, end)
    for start, end, surname in _persons(bare, names):
        add("person", start, end, surname)
    places = [(k, *_stored(text, at, a, b), name) for k, a, b, name in found]
    return sorted(((k, a, b, text[a:b], name) for k, a, b, name in places), key=lambda x: x[1])


def _case(word: str) -> str:
    return "lower" if not word[0].isupper() else "upper" if len(word) > 1 and word.isupper() else "title"


def name_words(text: str) -> list[str]:
    """The distinct words of a text that are looked up among the surnames."""
    return list(dict.fromkeys(m[0].rstrip(".").lower() for m in _TOKEN.finditer(readable(text)[0])))


def _persons(text: str, names: Names) -> Iterator[tuple[int, int, str]]:
    """(start, end, surname) of persons.

    A surname goes with what stands next to it: a known given name, an initial, or another word in the same letter case
    that is no common one; after it, with a comma between, likewise. Where both sides would do, a known given name wins,
    then the side without the comma unless it begins a sentence.
    """
    tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [t[0].rstrip(".").lower() for t in tokens]
    if names.surnames.isdisjoint(words) and not any(w in names.given for w in words):
        return
    n = len(tokens)

    def gap(i: int) -> str:
        return text[tokens[i][2] : tokens[i + 1][1]] if 0 <= i and i + 1 < n else "\0"

    def initial(i: int) -> bool:
        return len(tokens[i][0].rstrip(".")) == 1 and (tokens[i][0].endswith(".") or tokens[i][0].isupper())

    def known(i: int) -> bool:
        return words[i] in names.given and not tokens[i][0].endswith(".")

    def unknown(i: int, surname: int) -> bool:
        """Whether a word may be a given name that is not listed."""
        word = tokens[i][0]
        if word.endswith(".") or len(word) < 3 or words[i] in names.surnames or words[i] in names.common or words[i] in _TITLES:
            return False
        return _case(word) == _case(tokens[surname][0])

    def begins(i: int) -> bool:
        return not text[: tokens[i][1]].rstrip(" \"'([«“¡¿").strip("\0") or text[: tokens[i][1]].rstrip(" \"'([«“¡¿")[-1:] in ".!?…\n"

    def double(i: int) -> int:
        while gap(i) == "-" and (words[i + 1] in names.surnames or tokens[i + 1][0][0].isupper()):
            i += 1
        return i

    def surname(i: int, last: int) -> str:
        return " ".join(words[i : last + 1])

    i = 0
    while i < n:
        if words[i] not in names.surnames:
            # A known given name, perhaps with an initial, and a capitalised word that is no common one, although no surname that was learned.
            first = i - 2 if i > 1 and initial(i - 1) and gap(i - 2) == " " else i - 1
            before = i > 0 and gap(i - 1) == " " and words[first] in names.given and tokens[first][0][0].isupper()
            plain = tokens[i][0][0].isupper() and len(words[i]) > 3 and words[i] not in names.common and words[i] not in names.given and words[i] not in _TITLES
            if before and plain:
                last = double(i)
                yield tokens[first][1], tokens[last][2] - tokens[last][0].endswith("."), surname(i, last)
                i = last
            elif plain and gap(i) == ", " and known(i + 1) and tokens[i + 1][0][0].isupper() and text[: tokens[i][1]].rstrip(" ")[-1:] in ("", "\n") and (text[tokens[i + 1][2] :].lstrip(" ")[:1] or "\n") in "\n:;)":
                yield tokens[i][1], tokens[i + 1][2], surname(i, i)
                i += 1
            i += 1
            continue
        last = double(i)
        start, end = i, last
        full = tokens[last][0]
        stop = tokens[last][2] - (1 if full.endswith(".") else 0)
        before = i - 1
        comma = last + 1 < n and not full.endswith(".") and gap(last) in (", ", ",")
        after_known = last + 1 < n and not full.endswith(".") and gap(last) in (", ", " ", ",") and known(last + 1) and not (gap(last + 1) == " " and last + 2 < n and words[last + 2] in names.surnames)
        after = after_known or comma and (initial(last + 1) or unknown(last + 1, i))
        if before >= 0 and gap(before) == " " and known(before):
            start = before
        elif before >= 0 and gap(before) in (" ", "") and initial(before):
            start = before
            more = before - 1
            while more >= 0 and gap(more) in (" ", "") and initial(more):
                start, more = more, more - 1
            if more >= 0 and gap(more) == " " and (known(more) or unknown(more, i)):
                start = more
        elif before >= 0 and gap(before) == " " and unknown(before, i) and not after_known and not (after and begins(before)):
            start = before
        elif after:
            end = last + 1
            stop = tokens[end][2] - (1 if tokens[end][0].endswith(".") and not initial(end) else 0)
            while gap(end) in (" ", "") and end + 1 < n and initial(end + 1) and tokens[end + 1][0].endswith("."):
                end += 1
                stop = tokens[end][2]
        if start < i or end > last:
            yield tokens[start][1], stop, surname(i, last)
        i = max(last, end) + 1


def learn_names(users: DataFrame, given_names: DataFrame, corpus: DataFrame, most: int = BROADCAST_SURNAMES) -> tuple[Names, DataFrame | None]:
    """What is known of names, and the surnames as a table (surname) if they are more than `most`; they are none of Names
    then.

    Surnames are the second of two words of user names whose first is a known given name; not words of the labelled
    corpus. Given names and the words of that corpus do not grow with the data.
    """
    listed = given_names.where("given_name IS NOT NULL").select("given_name", "lang").distinct().orderBy("given_name", "lang").collect()
    given = dict.fromkeys(sorted(FEMININE | MASCULINE), "") | {(consistent(r.given_name) or "").lower(): r.lang or "" for r in listed}
    rows = corpus.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("length(w) > 0").distinct().collect()
    common = frozenset(r.w for r in rows) - given.keys()
    # A user name is looked at in Python once; most users have given names that are listed or no surname at all.
    parts = confusables.consistent_form(users.where("name IS NOT NULL").select("name").distinct(), "name", "seen").select(F.split(F.lower(F.trim("seen")), " +").alias("p"))
    two = parts.where(F.size("p") == 2).select(F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("surname"))
    fixed = users.sparkSession.createDataFrame([(w, True) for w in sorted(given)] + [(w, False) for w in sorted(common)], "w string, given boolean")
    kept = two.join(F.broadcast(fixed.where("given").select(F.col("w").alias("first"))), "first", "left_semi").where(F.col("surname").rlike(r"^[\p{L}]{4,}$"))
    table = kept.join(F.broadcast(fixed.select(F.col("w").alias("surname"))), "surname", "left_anti").select("surname").distinct()
    top = table.limit(most + 1).collect()
    if len(top) > most:
        return Names(given, frozenset(), common), cut(table)
    return Names(given, frozenset(r.surname for r in top), common), None


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("val", pa.string()), ("surname", pa.string())]))
_FOUND_DDL = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT, val: STRING, surname: STRING>>"


def _own_surnames(texts: DataFrame, surnames: DataFrame) -> DataFrame:
    """texts with own, the words of each that are surnames."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [name_words(t) if t else [] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], ["src", "rec_id", "place", "words"])

    keys = ["src", "rec_id", "place"]
    placed = texts.withColumn("place", F.xxhash64("text"))
    rows = placed.select(*keys, "text").mapInArrow(words, "src STRING, rec_id STRING, place BIGINT, words ARRAY<STRING>")
    own = rows.select(*keys, F.explode("words").alias("surname")).join(surnames, "surname", "left_semi").groupBy(*keys).agg(F.collect_set("surname").alias("own"))
    match = placed.src.eqNullSafe(own.src) & (placed.rec_id == own.rec_id) & (placed.place == own.place)
    return placed.join(own, match, "left").select(placed.src, placed.rec_id, placed.text, "own")


def find_entities(texts: DataFrame, names: Names, surnames: DataFrame | None = None, all_rows: bool = False) -> DataFrame:
    """(src, rec_id, text, found) of the rows of (src, rec_id, text) with finds; found has kind, start, end, val and surname
    in the order of the text, start and end counting characters of the stored text. With all_rows the others have an empty
    found. surnames is what learn_names gave: a table if they are too many to be handed to every task."""
    shared = texts.sparkSession.sparkContext.broadcast(names)  # bounded by BROADCAST_SURNAMES and tables that do not grow
    rows = texts.where("rec_id IS NOT NULL").select("src", "rec_id", "text")
    rows = rows.withColumn("own", F.lit(None).cast("array<string>")) if surnames is None else _own_surnames(rows, surnames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        for batch in batches:
            found, kept = [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                known = every if own is None else replace(every, surnames=frozenset(own))
                finds = find(text, known) if text else []
                if finds or all_rows:
                    found.append([{"kind": kind, "start": start, "end": end, "val": val, "surname": name} for kind, start, end, val, name in finds])
                    kept.append(i)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, _FOUND)], ["src", "rec_id", "text", "found"])

    return rows.select("src", "rec_id", "text", "own").mapInArrow(run, f"src STRING, rec_id STRING, text STRING, found {_FOUND_DDL}")


def canonical(kind: str, val: str) -> str:
    """What spellings of one entity share: names in any order and case, numbers without separators."""
    seen = (consistent(val) or "").lower()
    if kind == "person":
        return " ".join(sorted(re.findall(r"[^\W\d_]+", seen)))
    if kind == "name":
        return seen
    if kind == "email":
        return re.sub(r"\s?[(\[]dot[)\]]\s?|\sdot\s", ".", re.sub(r"\s?[(\[]at[)\]]\s?|\sat\s", "@", seen))
    return "".join(c for c in seen if c.isalnum()) if kind in ("phone", "id_number") else " ".join(re.findall(r"\w+", seen))


_CLASSES = ("aeiou", "bcdfghjklmnprstvz", "аеиоу", "бвгдзклмнпрст")


def _shaped(text: str, key: bytes, what: str, longer: int = 0) -> str:
    """Every digit by a digit, every letter by one of its kind, script and case; all else stays. The last digit or letter
    is followed by `longer` more of its kind."""
    if longer:
        last = max((i for i, c in enumerate(text) if c.isalnum()), default=-1)
        text = text[: last + 1] + (text[last] if last >= 0 else "x") * longer + text[last + 1 :]
    out, block, k = [], b"", 0
    for i, c in enumerate(text):
        if i % 32 == 0:
            block = hmac.new(key, f"{what}|{i}".encode(), hashlib.sha256).digest()
        k = block[i % 32]
        base = unicodedata.normalize("NFD", c.lower())[0]
        if c.isdigit():
            out.append(str(k % 10))
        elif c.isalpha():
            letters = _CLASSES[(2 if "CYRILLIC" in unicodedata.name(c, "") else 0) + (base not in "aeiouyаеиоуыэюя")]
            x = letters[k % len(letters)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


_RESERVED = re.compile(r"(?:.*\.)?(?:example|test|invalid|localhost|example\.(?:com|net|org))")
_DOT = re.compile(r"(\s?[\[(]dot[\])]\s?|\sDOT\s|[.．])")


def _domain(domain: str, shown: str, key: bytes) -> str:
    """A reserved domain for the canonical one, with the dots of the stored one; the same for all addresses at it."""
    if _RESERVED.fullmatch(domain):
        return shown
    labels = domain.split(".")
    new = [_shaped(x, key, f"domain|{k}|{domain}") for k, x in enumerate(labels[:-1])] + ["example"]
    parts = _DOT.split(shown)
    if len(parts) != 2 * len(labels) - 1:
        return ".".join(new)
    parts[::2] = new
    return "".join(parts)


def surrogate(kind: str, val: str, key: bytes, attempt: int, longer: int = 0) -> str:
    """The replacement of a spelling that is no person; spellings with one canonical form and attempt get the same, in their
    own format. It has `longer` more digits or letters than the spelling's shape. The kind name is a word of a person."""
    what = f"{kind}|{attempt}|{canonical(kind, val)}"
    if kind == "email":
        at = re.search(r"\s?(?:@|＠|[(\[]at[)\]]|\bAT\b)\s?", val)
        if not at:
            return _shaped(val, key, what, longer)
        return _shaped(val[: at.start()], key, what, longer) + at[0] + _domain(canonical(kind, val).partition("@")[2], val[at.end() :], key)
    if kind == "phone":
        keep = re.match(r"\+\d{1,2}|\(?0?", val)[0]  # type: ignore[index]
        return keep + _shaped(val[len(keep) :], key, what, longer)
    if kind == "street":
        kept = r"(?i:lane|ln|road|rd|street|st|avenue|ave|drive|close|court|row|boulevard|blvd|terrace|calle|c|plaza|avenida|paseo|rue|bd|chemin|impasse|place|quai|de|del|des|du|la|los|las|am|nº)"
        return re.sub(rf"\b(?!{kept}\b)\w+?(?=(?:straße|strasse|str|gasse|weg|allee)?\b)", lambda m: _shaped(m[0], key, f"{what}|{m[0].lower()}", longer), val)
    return _shaped(val, key, what, longer)


def _gender(given: str) -> str:
    return "f" if given in FEMININE else "m" if given in MASCULINE else ""


@lru_cache(4)
def _exchanged(listed: tuple[tuple[str, str], ...], key: bytes) -> dict[str, str]:
    """Each listed given name with the next of its language and gender in keyed order; names that are alone there make one
    more group. No two names become the same."""
    order = lambda g: hmac.new(key, f"given|{g}".encode(), hashlib.sha256).digest()
    groups: dict[tuple[str, str], list[str]] = {}
    for g, lang in listed:
        groups.setdefault((lang, _gender(g)), []).append(g)
    alone = sorted((g for own in groups.values() if len(own) == 1 for g in own), key=order)
    several = [sorted(own, key=order) for own in groups.values() if len(own) > 1]
    if len(alone) == 1 and several:
        several[0].extend(alone)
    elif alone:
        several.append(alone)
    return {g: own[(i + 1) % len(own)] for own in several for i, g in enumerate(own)}


_WORDS = re.compile(r"[^\W\d_]+")
#: The letters of the alphabets that initials are written in.
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя")


def person_words(val: str, surname: str, given: dict[str, str]) -> list[tuple[str, str]]:
    """(role, form) of the words of a person in order: surname, listed, given or initial. Words of a surname that stand as
    it does count as such, even if they are a given name too."""
    own, out = set(surname.split()), []
    for m in _WORDS.finditer(val):
        form = (consistent(m[0]) or "").lower()
        role = "surname" if form in own else "initial" if len(form) == 1 else "listed" if form in given else "given"
        out.append((role, form))
    return out


def parts_of(kind: str, val: str, surname: str | None, given: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, form) of what is drawn for a find: the find itself, or the words of a person that are not listed."""
    if kind != "person":
        return [(kind, canonical(kind, val))]
    return sorted({("name", form) for role, form in person_words(val, surname or "", given) if role in ("surname", "given")})


def initial_of(val: str, surname: str | None, given: dict[str, str]) -> str | None:
    """The initial that stands for the given name of a person; null if there is a given name, or none."""
    roles = person_words(val, surname or "", given)
    return None if any(r in ("listed", "given") for r, _ in roles) else next((f for r, f in roles if r == "initial"), None)


def given_of(val: str, surname: str | None, given: dict[str, str]) -> str | None:
    return next((f for r, f in person_words(val, surname or "", given) if r in ("listed", "given")), None)


def _new_given(form: str, key: bytes, draw: tuple[int, int] | None, given: dict[str, str]) -> str:
    if form in given and len(given) > 1:
        return _exchanged(tuple(given.items()), key)[form]
    return _shaped(form, key, f"name|{draw[0] if draw else 0}|{form}", draw[1] if draw else 0)


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new[:1].upper() + new[1:] if like[0].isupper() else new


def person_surrogate(val: str, surname: str | None, key: bytes, draws: dict[str, tuple[int, int]], initial: str | None, given: dict[str, str]) -> str:
    """A person word by word: draws are those of its words, initial is what its leading initial becomes."""
    roles = iter(person_words(val, surname or "", given))
    leading = initial

    def word(m: re.Match[str]) -> str:
        nonlocal leading
        role, form = next(roles)
        if role == "initial":
            new, leading = (leading, None) if leading else (_next_letter(form, key), None)
            return new[:1].upper() + new[1:] if m[0].isupper() else new
        if role == "listed":
            return _cased(_new_given(form, key, None, given), m[0])
        return _cased(_shaped(form, key, f"name|{draws[form][0]}|{form}", draws[form][1]), m[0])

    return _WORDS.sub(word, val)


def _next_letter(letter: str, key: bytes) -> str:
    """Another letter of its alphabet; no two letters become the same."""
    letters = next((a for a in _ALPHABETS if unicodedata.normalize("NFD", letter)[0] in a), None)
    if letters is None:
        return letter
    step = 1 + hmac.new(key, b"initial", hashlib.sha256).digest()[0] % (len(letters) - 1)
    return letters[(letters.index(unicodedata.normalize("NFD", letter)[0]) + step) % len(letters)]


def initials(entries: list[tuple[str, str | None]], key: bytes) -> dict[str, str]:
    """What the initials of one surname become. entries are (initial, what the one given name it stands for became): the
    shortest beginning of that name that no other has; initials of several names, or of none, get what letter is free."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for letter, name in sorted((e for e in entries if e[1]), key=lambda e: e[0]):
        own = next((name[:k] for k in range(1, len(name) + 1) if name[:k] not in used), name)  # type: ignore[index]
        out[letter] = own
        used.add(own)
    for letter, _ in sorted((e for e in entries if not e[1]), key=lambda e: e[0]):
        own = _next_letter(letter, key)
        letters = next((a for a in _ALPHABETS if own in a), own)
        options = [letters[(letters.index(own) + k) % len(letters)] for k in range(len(letters))]
        free = next((x for x in options if x not in used and x != letter), None)
        out[letter] = free if free else next(own + x + y for x in letters for y in letters if own + x + y not in used)
        used.add(out[letter])
    return out


def surrogates(entities: DataFrame, key: bytes, taken: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """(kind, form, attempt, longer) for (kind, form, val): the draw whose surrogates no other entity has and no entity is,
    for every spelling. taken has more (kind, drawn) that no surrogate may be.

    The entities that share a surrogate, all but the first by form, and those whose surrogate is itself an entity or was
    given away before, draw again until there are none. After `rounds` draws in its own shape an entity's next ones are
    longer, by one more each, so that the draws come to an end. Only what collides is drawn again; each draw is written
    once.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True)
            drawn = [canonical(k, surrogate(k, v, key, a, more)) for k, v, a, more in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], ["kind", "form", "val", "attempt", "longer", "drawn"])

    entities = cut(entities.select("kind", "form", "val").distinct())
    left = entities.select("*", F.lit(0).alias("attempt"), F.lit(0).alias("longer"))
    own = entities.select("kind", F.col("form").alias("drawn"))
    used = (own if taken is None else own.unionByName(taken.select("kind", "drawn"))).distinct()
    done: DataFrame | None = None
    attempt = 0
    while True:
        drawn = cut(left.mapInArrow(draw, "kind STRING, form STRING, val STRING, attempt INT, longer INT, drawn STRING"))
        pairs = drawn.select("kind", "form", "drawn").distinct()
        firsts = pairs.groupBy("kind", "drawn").agg(F.min("form").alias("first"))
        again = pairs.join(firsts, ["kind", "drawn"]).join(used.withColumn("used", F.lit(True)), ["kind", "drawn"], "left")
        again = again.where("form <> first OR used").select("kind", "form").distinct()
        marked = cut(drawn.join(again.withColumn("again", F.lit(True)), ["kind", "form"], "left"))
        settled = marked.where("again IS NULL")
        kept = settled.select("kind", "form", "attempt", "longer").distinct()
        done = kept if done is None else done.unionByName(kept)
        left = marked.where("again")
        if left.isEmpty():
            return done
        used = used.unionByName(settled.select("kind", "drawn").distinct())
        attempt += 1
        left = left.select("kind", "form", "val", F.lit(attempt).alias("attempt"), F.lit(max(0, attempt - rounds + 1)).alias("longer"))


def replacements(found: DataFrame, names: Names, key: bytes) -> DataFrame:
    """(src, rec_id, start, end, kind, val, new), distinct: every find with its surrogate.

    found is what find_entities gave. Finds are taken apart into what is drawn, drawn once for the whole data, and put
    together again; initials are settled for each surname, which has at most as many as there are letters.
    """
    given = names.given
    shared = found.sparkSession.sparkContext.broadcast(given)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True))
            parts = [[{"kind": k, "form": f} for k, f in parts_of(*r, listed)] for r in rows]
            person = [r[0] == "person" for r in rows]
            first = [initial_of(v, s, listed) if p else None for p, (_, v, s) in zip(person, rows, strict=True)]
            full = [given_of(v, s, listed) if p else None for p, (_, v, s) in zip(person, rows, strict=True)]
            arrays = [pa.array(parts, pa.list_(pa.struct([("kind", pa.string()), ("form", pa.string())]))), pa.array(first, pa.string()), pa.array(full, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["src", "rec_id", "start", "end", "kind", "val", "surname", "parts", "initial", "given"])

    fields = "src STRING, rec_id STRING, start INT, end INT, kind STRING, val STRING, surname STRING"
    rows = found.select("src", "rec_id", F.explode("found").alias("x")).select("src", "rec_id", "x.start", "x.end", "x.kind", "x.val", "x.surname").distinct()
    rows = cut(rows.mapInArrow(apart, f"{fields}, parts ARRAY<STRUCT<kind: STRING, form: STRING>>, initial STRING, given STRING"))
    drawn_for = rows.select(F.explode("parts").alias("p"), "val", "kind")
    entities = drawn_for.select("p.kind", "p.form", F.when(F.col("kind") == "person", F.col("p.form")).otherwise(F.col("val")).alias("val"))
    listed = found.sparkSession.createDataFrame([("name", g) for g in sorted(given)], "kind string, drawn string")
    draws = cut(surrogates(entities, key, listed))

    # What the initials of each surname become.
    persons = rows.where("kind = 'person'")
    asked = persons.where("initial IS NOT NULL").select("surname", "initial").distinct()
    fulls = persons.where("given IS NOT NULL").select("surname", "given", F.substring("given", 1, 1).alias("initial")).distinct()
    ones = fulls.groupBy("surname", "initial").agg(F.count(F.lit(1)).alias("n"), F.min("given").alias("given")).where("n = 1").drop("n")
    stand = asked.join(ones, ["surname", "initial"], "left")
    stand = stand.join(draws.where("kind = 'name'").select(F.col("form").alias("given"), "attempt", "longer"), "given", "left")
    grouped = stand.groupBy("surname").agg(F.collect_list(F.struct("initial", "given", "attempt", "longer")).alias("entries"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for surname, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                became = [(e["initial"], e["given"] and _new_given(e["given"], key, None if e["attempt"] is None else (e["attempt"], e["longer"]), own)) for e in entries]
                out += [(surname, letter, new) for letter, new in initials(became, key).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["surname", "initial", "new_initial"])

    letters = grouped.mapInArrow(settle, "surname STRING, initial STRING, new_initial STRING")

    @F.pandas_udf("string")
    def replaced(kind: pd.Series, val: pd.Series, surname: pd.Series, forms: pd.Series, new_initial: pd.Series) -> pd.Series:
        out = []
        for k, v, s, own, letter in zip(kind, val, surname, forms, new_initial, strict=True):
            if k == "person":
                draw = {f["form"]: (f["attempt"], f["longer"]) for f in own if f["form"] is not None}
                out.append(person_surrogate(v, s, key, draw, letter, shared.value))
            else:
                out.append(surrogate(k, v, key, own[0]["attempt"], own[0]["longer"]))
        return pd.Series(out, dtype=object)

    whole = ["src", "rec_id", "start", "end", "kind", "val", "surname", "initial"]
    each = rows.select(*whole, F.explode_outer("parts").alias("p")).select(*whole, F.col("p.kind").alias("part_kind"), F.col("p.form").alias("form"))
    each = each.join(draws.withColumnRenamed("kind", "part_kind"), ["part_kind", "form"], "left")
    each = each.groupBy(*whole).agg(F.collect_list(F.struct("form", "attempt", "longer")).alias("forms")).join(letters, ["surname", "initial"], "left")
    return each.select("src", "rec_id", "start", "end", "kind", "val", replaced("kind", "val", "surname", "forms", "new_initial").alias("new"))


def entity_rows(replaced: DataFrame) -> DataFrame:
    """(src, rec_id, kind, val), distinct, of the finds that replacements gave a surrogate."""
    return replaced.where("new IS NOT NULL").select("src", "rec_id", "kind", "val").distinct()


def redact(texts: DataFrame, names: Names, key: bytes, surnames: DataFrame | None = None) -> DataFrame:
    """(src, rec_id, placeholder_text, surrogate_text) of all distinct records: texts without finds are unchanged, and null
    ones null. Of different texts of one record the greatest counts.

    In placeholder_text each find is [KIND]; in surrogate_text it is its surrogate. Whoever knows the key can try out which
    entity has which surrogate, so it has no default.
    """
    records = texts.where("rec_id IS NOT NULL").groupBy("src", "rec_id").agg(F.max("text").alias("text"))
    searched = cut(find_entities(records, names, surnames, all_rows=True))  # texts are searched once
    found = searched.where(F.size("found") > 0)
    each = replacements(found, names, key).groupBy("src", "rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("parts"))

    def build(piece: Callable[[Column], Column]) -> Column:
        done = F.aggregate(
            "parts",
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda acc, p: F.struct(F.concat(acc.out, F.substring("text", acc.at + 1, p.start - acc.at), piece(p)).alias("out"), p.end.alias("at")),
        )
        return F.concat(done.out, F.substring("text", done.at + 1, F.length("text")))

    each = each.select(F.col("src").alias("s"), F.col("rec_id").alias("r"), "parts")
    whole = found.select("src", "rec_id", "text").join(each, F.col("src").eqNullSafe(F.col("s")) & (F.col("rec_id") == F.col("r")))
    done = whole.select(
        "src", "rec_id", build(lambda p: F.concat(F.lit("["), F.upper(p.kind), F.lit("]"))).alias("placeholder_text"), build(lambda p: p.new).alias("surrogate_text")
    )
    as_is = searched.where(F.size("found") == 0).select("src", "rec_id", F.col("text").alias("placeholder_text"), F.col("text").alias("surrogate_text"))
    return done.unionByName(as_is)


def tweet_and_profile_texts(raw: DataFrame, users: DataFrame) -> DataFrame:
    tweets = raw.select(F.lit("raw_tweet").alias("src"), F.col("id_str").alias("rec_id"), "text")
    return tweets.unionByName(users.select(F.lit("user_profile").alias("src"), F.col("id_str").alias("rec_id"), F.col("description").alias("text")))

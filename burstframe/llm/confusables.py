"""One consistent form of texts that look alike, and the pairs and classes of values that do.

Width, font, circled and small-capital forms, joined letters, composed and decomposed accents, invisible characters and
kinds of space are normalized; a joiner between two emoji makes one picture of them and stays.
Then each token's letters vote with the scripts they can be read in: the sets are intersected, and the token is spelled
in the script that remains. A token that can be read in several (whole-script confusables) is spelled in that of the
nearest token with only one, the one before if two are as near, if everyday letters of that script do for it; in links,
mentions and addresses, and without such a token, in the first of SCRIPTS. So are the look-alike letters of a token that
no single script can spell (mixed scripts). What decides are letters without look-alikes and the places of tokens, which
texts that look alike share, so they get the same form. ASCII texts are left alone.

Null stays null, an empty text stays empty, a text of only invisible characters becomes empty. Letter case, accents,
punctuation and the number of spaces are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from burstframe.session import cut

#: Scripts by preference.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
#: First and last everyday letter of the scripts that a token may be spelled in for its neighbours' sake.
EVERYDAY = {"CYRILLIC": "аё", "GREEK": "αώ", "ARMENIAN": "աև"}
#: Letters of other alphabets with the shape of a Latin one.
LOOKALIKES = {
    "a": "а", "c": "сⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "і", "j": "јյ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ",
    "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "у",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "НΗᎻⲎꓧ", "I": "ІΙⲒꓲ", "J": "ЈᎫꓙ", "K": "КΚᏦⲔꓗ",
    "L": "Ꮮꓡ", "M": "МΜᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢⲦꓔ", "U": "Սꓴ", "V": "Ꮩꓦ",
    "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ", "Y": "УҮΥᎩⲨꓬ", "Z": "ΖᏃꓜ",
}
#: Latin letters with the shape of another.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ı": "i"}
_WIDTH = [*range(0xFF01, 0xFFEF)]
_JOINED = [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]
_WORD = re.compile("[\\w\u0300-\u036f]+")
_OTHER = re.compile("[Ͱ-ԯ԰-֏Ꭰ-᏿ᲀ-᲏ἀ-῿Ⲁ-⳿ⷠ-ⷿꓐ-꓿Ꙁ-ꚟꭰ-ꮿ]")
_PICTURE = "[\u2190-\u2bff\U0001f000-\U0001faff]"
_JOINED_PICTURES = re.compile(f"(?<={_PICTURE[:-1]}\ufe0f])\u200d(?={_PICTURE})")
_PLACE = "\ue000"
_FIXED = re.compile(r"https?:\S+|www\.\S+|(?<!\S)\S*@\S+")


def _simple() -> dict[int, str | None]:
    """Width and joined forms to what they stand for, spaces to the space, invisible characters to nothing."""
    out: dict[int, str | None] = {c: unicodedata.normalize("NFKC", chr(c)) for c in (*_WIDTH, *_JOINED)}
    for c in range(0x80, 0x30000):
        kind = unicodedata.category(chr(c))
        form = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if form == "<font>" or form == "<circle>" and kind == "So" and unicodedata.normalize("NFKC", chr(c)).isalpha():
            out[c] = unicodedata.normalize("NFKC", chr(c))
        elif unicodedata.name(chr(c), "").startswith("LATIN LETTER SMALL CAPITAL ") and len(unicodedata.name(chr(c))) == 28:
            out[c] = unicodedata.name(chr(c))[-1]
        if kind == "Zs":
            out[c] = " "
        elif kind == "Cf":
            out[c] = None
    out |= dict.fromkeys((0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0), None)
    out |= dict.fromkeys(range(0xFE00, 0xFE10), None)
    out |= dict.fromkeys(range(0xE0000, 0xE0200), None)
    return out | {ord(c): to for c, to in LATIN_TWINS.items()}


@lru_cache(1)
def _tables() -> tuple[dict[int, str | None], dict[str, dict[str, str]]]:
    """The simple table, and for each letter with look-alikes the letter to write in each script."""
    reads: dict[str, dict[str, str]] = {}
    for latin, others in LOOKALIKES.items():
        row: dict[str, str] = {"LATIN": latin}
        for c in others:
            row.setdefault(unicodedata.name(c).split()[0], c)
        for c in (latin, *others):
            reads[c] = row
    return _simple(), reads


@lru_cache(1 << 16)
def _script(letter: str) -> str | None:
    return next((s for s in SCRIPTS if unicodedata.name(letter, "").startswith(s)), None)


@lru_cache(1 << 18)
def _scripts(token: str) -> frozenset[str] | None:
    """The scripts that all letters of a token can be read in; null without letters."""
    reads = _tables()[1]
    letters = unicodedata.normalize("NFD", token)
    sets = [frozenset(reads[c]) if c in reads else frozenset((_script(c),)) for c in letters if c in reads or _script(c)]
    return frozenset.intersection(*sets) if sets else None


@lru_cache(1 << 18)
def _spelled(token: str, script: str) -> str:
    reads = _tables()[1]
    letters = unicodedata.normalize("NFD", token)
    return unicodedata.normalize("NFC", "".join(reads[c].get(script, c) if c in reads else c for c in letters))


@lru_cache(1 << 18)
def _everyday(token: str, script: str) -> bool:
    first, last = EVERYDAY.get(script, "~ ")
    return all(first <= c <= last or not c.isalpha() for c in unicodedata.normalize("NFD", _spelled(token, script).lower()) if not unicodedata.combining(c))


def consistent_token(token: str) -> str:
    """The token (in NFC) in the script that all its letters can be read in, else with look-alikes in the first script."""
    common = _scripts(token)
    return token if common is None else _spelled(token, next((s for s in SCRIPTS if s in common), SCRIPTS[0]))


def _consistent_tokens(text: str) -> str:
    tokens = [m.span() for m in _WORD.finditer(text)]
    common = [_scripts(text[a:b]) for a, b in tokens]
    single = [next(iter(c)) if c is not None and len(c) == 1 else None for c in common]
    fixed = [m.span() for m in _FIXED.finditer(text)]
    after: list[int] = [len(tokens)] * len(tokens)
    for i in range(len(tokens) - 2, -1, -1):
        after[i] = i + 1 if single[i + 1] else after[i + 1]
    out, end, before = [], 0, -1
    for i, (a, b) in enumerate(tokens):
        token = text[a:b]
        out.append(text[end:a])
        end = b
        if common[i] is not None and len(common[i]) > 1 and not any(x <= a < y for x, y in fixed):
            near = before if before >= 0 and i - before <= after[i] - i else after[i] if after[i] < len(tokens) else before
            script = single[near] if near >= 0 else None
            out.append(_spelled(token, script) if script in common[i] and _everyday(token, script) else consistent_token(token))
        else:
            out.append(token if token.isascii() else consistent_token(token))
        if single[i]:
            before = i
    return "".join([*out, text[end:]])


def consistent(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    if "\u200d" in text:
        text = _JOINED_PICTURES.sub(_PLACE, text)
        text = text.translate(_tables()[0]).replace(_PLACE, "\u200d")
    else:
        text = text.translate(_tables()[0])
    text = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", _consistent_tokens(text)) if _OTHER.search(text) else text


@F.pandas_udf(StringType())
def _consistent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([consistent(t) for t in batch], dtype=object)


def consistent_form(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the column `to`. Only texts with a character beyond ASCII are sent to Python."""
    value = F.col(column)
    odd = F.when(F.octet_length(value) > F.char_length(value), value)
    return df.withColumn(to, F.coalesce(_consistent(odd), value))


def lookalike_pairs(values: DataFrame, salts: int = 8) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b, of ids whose values in a field look alike and differ.

    values has field, id, value; repeated rows count once, nulls are left out. Spellings are compared before ids: a
    class with one spelling, however many ids have it, is dropped by a hash aggregate, and only then are pairs of
    spellings given their ids. The work beyond that aggregate is in proportion to the pairs that are asked for.
    """
    rows = consistent_form(values.where("value IS NOT NULL AND id IS NOT NULL").select("field", "id", "value"), "value", "form")
    rows = rows.withColumns({"form_key": F.xxhash64("field", "form"), "value_key": F.xxhash64("value")})
    several = (
        rows.groupBy("form_key")
        .agg(F.min("value_key").alias("least"), F.max("value_key").alias("most"))
        .where("least <> most")
        .select("form_key")
    )
    members = cut(rows.join(several, "form_key", "left_semi").select("field", "form", "value", "id").distinct())
    # A class with very many spellings, and a spelling with very many ids, are spread over `salts` parts on one side; the
    # other side is repeated for each.
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    spellings = members.select("field", "form", "value").distinct()
    ones = spellings.select("field", "form", F.col("value").alias("one"), F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt"))
    pairs = ones.join(spellings.select("field", "form", F.col("value").alias("other"), each.alias("salt")), ["field", "form", "salt"]).where("one < other")
    pairs = pairs.select("field", "one", "other")
    salted = members.select("field", "value", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    one = salted.select("field", F.col("value").alias("one"), F.col("id").alias("one_id"), "salt")
    other = salted.select("field", F.col("value").alias("other"), F.col("id").alias("other_id"), "salt")
    left = pairs.withColumn("salt", each).join(one, ["field", "one", "salt"]).select("field", "one_id", "other", each.alias("salt"))
    both = left.join(other, ["field", "other", "salt"]).where("one_id <> other_id")
    return both.select("field", F.least("one_id", "other_id").alias("id_a"), F.greatest("one_id", "other_id").alias("id_b")).distinct()


def lookalike_classes(values: DataFrame) -> DataFrame:
    """(field, form, n_spellings, n_ids) of the classes with several spellings: one row a class, however many pairs it has.
    An id with several spellings counts with each."""
    rows = consistent_form(values.where("value IS NOT NULL AND id IS NOT NULL").select("field", "id", "value").distinct(), "value", "form")
    spellings = rows.groupBy("field", "form", "value").agg(F.count(F.lit(1)).alias("n"))
    classes = spellings.groupBy("field", "form").agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_ids"))
    return classes.where("n_spellings > 1")


def tweet_values(raw: DataFrame, users: DataFrame) -> DataFrame:
    text = raw.select(F.lit("text").alias("field"), F.col("id_str").alias("id"), F.col("text").alias("value"))
    return text.unionByName(users.select(F.lit("name").alias("field"), F.col("id_str").alias("id"), F.col("name").alias("value")))

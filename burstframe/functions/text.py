"""Scalar functions on tweet text, as Column expressions; nothing leaves the JVM.

All return null for null, and the empty string or array for empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links are kept up to so many characters, and dropped if they are no longer than that.
URL_LENGTH = 20
#: Verbs that take a clause, their endings and irregular forms.
CLAUSE_VERBS = "say suggest insist announce argue show claim maintain think hope wonder tell expect observe".split()
CLAUSE_ENDINGS = ["", "s", "es", "ed", "d", "ing"]
CLAUSE_FORMS = "said thought told".split()
#: Forms of to be.
COPULAS = "is are was were am".split()
#: Typographic characters and what replaces them, "" for removal.
TYPOGRAPHIC = {
    "…": "...", "[‘’“”]": "'", " ": " ", "[–—]": "-", "•": ".",
    "[�►¢\U0001f449\U0001f49f\U0001f4af\U0001f608\U0001f44c]": "",
}
TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def tweet_time(created_at: Column) -> Column:
    """Tue Jan 01 12:33:10 +0000 2013 as a timestamp; null for any other format or offset."""
    shaped = F.when(created_at.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \+0000 \d{4}$"), F.substring(created_at, 5, 30))
    return F.try_to_timestamp(shaped, F.lit(TIME_FORMAT))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode_entities(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def is_printable_ascii(word: Column) -> Column:
    return ~word.rlike("[^ -~]")


def valid_url(word: Column) -> Column:
    """The first URL_LENGTH characters of a longer printable word that begins with http, else null."""
    kept = word.startswith("http") & (F.length(word) > URL_LENGTH) & is_printable_ascii(word)
    return F.when(kept, F.substring(word, 1, URL_LENGTH))


def mention(word: Column) -> Column:
    """From the first @ on, with a space for every character that a user name cannot hold."""
    return F.regexp_replace(F.regexp_extract(word, "(?s)@.*", 0), "[^@a-zA-Z0-9_]", " ")


def strip_edges(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "^[^a-zA-Z0-9$]+", ""), "[^a-zA-Z0-9$]+$", "")


def _token_parts(word: Column) -> Column:
    """(word, body): the body is the word without the # of a tag."""
    body = F.when(word.startswith("#"), F.substring(word, 2, 1 << 30)).otherwise(word)
    return F.struct(word.alias("word"), body.alias("body"))


def _plain_part(x: Column) -> Column:
    return F.struct(x.word.alias("word"), x.body.alias("body"), strip_edges(decode_entities(x.body)).alias("plain"))


def _cleaned(x: Column) -> Column:
    word, body, plain = x.word, x.body, x.plain
    punctuation = (F.length(body) > 1) & ~body.rlike("[a-zA-Z0-9]")
    kept = ~punctuation & (F.length(plain) >= 1) & is_printable_ascii(plain)
    text = F.when(kept, F.when(word.startswith("#"), F.concat(F.lit("#"), plain)).otherwise(plain))
    return F.when(F.contains(word, F.lit("http")), valid_url(word)).when(F.contains(word, F.lit("@")), mention(word)).otherwise(text)


def _clean_each(words: Column) -> Column:
    """Tokens cleaned, null for those of which nothing is left. Parts are worked out once for each token."""
    return F.transform(F.transform(F.transform(words, _token_parts), _plain_part), _cleaned)


def clean_token(word: Column) -> Column:
    """A token without what is no text, or null if nothing is left of it."""
    return F.get(_clean_each(F.array(word)), F.lit(0))


def space_punctuation(word: Column) -> Column:
    """Spaces around ! , . ; and ? except before the first and after the last character; links are left alone."""
    tail = F.regexp_replace(F.substring(word, 2, 1 << 30), "([!,.;?])", " $1 ")
    padded = F.regexp_replace(F.concat(F.substring(word, 1, 1), tail), r"\s+", " ")
    trimmed = F.when(F.right(word, F.lit(1)).rlike("[!,.;?]"), F.rtrim(padded)).otherwise(padded)
    alone = word.startswith("http") | (F.length(word) <= 1) | ~word.rlike("[!,.;?]")
    return F.when(alone, word).otherwise(trimmed)


def clean_tokens(text: Column) -> Column:
    return F.transform(F.filter(_clean_each(F.split(text, " ")), lambda w: w.isNotNull()), space_punctuation)


def clean_text(text: Column) -> Column:
    return F.array_join(clean_tokens(text), " ")


def is_content_free(tokens: Column) -> Column:
    """True without a word beside mentions, links and rt, or with one hashtag alone."""
    words = replace_flagged(replace_flagged(tokens, "@"), "http")
    words = F.filter(words, lambda w: F.lower(w) != "rt")
    return (F.size(words) == 0) | ((F.size(tokens) == 1) & F.get(tokens, F.lit(0)).startswith("#"))


def replace_flagged(tokens: Column, flag: str, by: str = "") -> Column:
    """Tokens that begin with the flag are replaced; empty tokens are dropped."""
    return F.filter(F.transform(tokens, lambda w: F.when(w.startswith(flag), by).otherwise(w)), lambda w: F.length(w) > 0)


def drop_retweet(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: F.lower(w) != "rt")


def drop_special(tokens: Column) -> Column:
    return drop_retweet(replace_flagged(replace_flagged(tokens, "@"), "http"))


def normalize_repeats(word: Column) -> Column:
    """Four or more repeats of a unit become three of its last character."""
    return F.regexp_replace(word, r"((\w)+)\1{3,}", "$2$2$2")


def plain_words(text: Column) -> Column:
    return F.lower(F.translate(text, "|_", "  "))


def copula_to_be(word: Column) -> Column:
    return F.when(word.isin(COPULAS), "be").otherwise(word)


def round2(number: Column) -> Column:
    return F.round(number, 2)


def replace_typographic(text: Column) -> Column:
    for pattern, by in TYPOGRAPHIC.items():
        text = F.regexp_replace(text, pattern, by)
    return text


def has_clause_verb(relation: Column) -> Column:
    words = F.split(F.replace(relation, F.lit("_"), F.lit(" ")), " ")
    pattern = f"^(?:(?:{'|'.join(CLAUSE_VERBS)})(?:{'|'.join(CLAUSE_ENDINGS)})|{'|'.join(CLAUSE_FORMS)})$"
    return F.exists(words, lambda w: w.rlike(pattern))


def anonymize_mentions(words: Column) -> Column:
    kept = F.filter(words, lambda w: F.length(w) > 0)
    return F.transform(kept, lambda w: F.replace(F.when(w.startswith("@") & (F.length(w) > 1), "@usr").otherwise(w), F.lit("|"), F.lit("")))


def stem_tokens(tokens: Column, stemmer: Callable[[Column], Column]) -> Column:
    """Each token by a stemmer of the caller's, a function of a Column."""
    return F.transform(tokens, lambda t: stemmer(t))


def drop_words(tokens: Column, words: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.array_contains(words, w))


def drop_links(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.contains(w, F.lit("http")))


def split_tagged(line: Column, separator: str = "/") -> Column:
    """word/TAG pieces as an array of (word, tag), split at the last separator."""
    pattern = f"^(.*){separator}([^{separator}]*)$"
    return F.transform(F.split(line, " "), lambda t: F.struct(F.regexp_extract(t, pattern, 1).alias("word"), F.regexp_extract(t, pattern, 2).alias("tag")))


def prepare_tagged(line: Column) -> Column:
    """word_TAG text for the parser: / for _, mentions as nouns, without retweet marks and links; ---/P if nothing is left."""
    flat = F.replace(F.replace(one_line(line), F.lit("_"), F.lit("/")), F.lit("/USR"), F.lit("/NN"))
    kept = F.filter(F.split(flat, " "), lambda w: ~F.substring_index(w, "/", -1).isin("RT", "URL"))
    alone = (F.size(kept) == 1) & F.get(kept, F.lit(0)).startswith("@")
    return F.when((F.size(kept) == 0) | alone, "---/P").otherwise(F.array_join(kept, " "))


def prepare_untagged(text: Column, lexicon: Column) -> Column:
    """Text for the tagger: leading hashtags and bare trailing # go, retweet marks and links go, # signs go, words are
    replaced by the lexicon (a map); null for a text of at most one word, or of two with a mention."""
    words = F.split(F.regexp_replace(F.regexp_replace(text, "^(?:#[^ ]* ?)+", ""), "(?: #)+$", ""), " ")
    pair = (F.size(words) == 2) & F.exists(words, lambda w: w.startswith("@"))
    kept = F.filter(words, lambda w: (w != "RT") & ~F.contains(w, F.lit("://")))
    mapped = F.transform(F.transform(kept, lambda w: F.replace(w, F.lit("#"), F.lit(""))), lambda w: F.coalesce(F.try_element_at(lexicon, w), w))
    enough = (F.size(F.split(text, " ")) > 1) & (F.size(words) > 1) & ~pair & (F.size(mapped) > 1)
    return F.when(enough, F.array_join(mapped, " "))


def frame_context(words: Column, slots: Column) -> Column:
    """The words, lower-cased and without punctuation marks, with each slot of the frames as one token; longest first."""
    marks = [",", ".", ";", "?", "!", "#", "&", "<", ">"]
    flat = F.concat(F.lit("_"), F.lower(F.array_join(F.filter(words, lambda w: ~w.isin(marks)), "_")), F.lit("_"))
    order = F.array_sort(F.transform(slots, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    marked = F.aggregate(order, flat, lambda acc, s: F.replace(acc, F.concat(F.lit("_"), s.s, F.lit("_")), F.concat(F.lit("_\u0001"), s.i.cast("string"), F.lit("_"))))
    pieces = F.split(marked, "_")
    read = F.transform(pieces, lambda p: F.when(p.startswith("\u0001"), F.get(slots, F.try_to_number(F.substring(p, 2, 10), F.lit("999999999")).cast("int"))).otherwise(p))
    return F.array_join(anonymize_mentions(read), " ")


def ending_in(text: Column, suffix: str = "ed") -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: w.endswith(suffix)), " ")


def sub_phrases(unit: Column, separator: str = "_") -> Column:
    """All contiguous runs of the unit's words."""
    words = F.split(unit, separator)
    runs = F.transform(words, lambda _w, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), separator)))
    return F.flatten(runs)


def in_any(tokens: Column, flags: Sequence[str]) -> Column:
    return F.exists(tokens, lambda w: w.isin(list(flags)))

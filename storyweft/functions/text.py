"""Cleaning and tokenising of short texts as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that become several letters or marks, and letters of other scripts.
SEVERAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...", "—": "--", "«": "<<", "»": ">>", "€": "EUR", "™": "tm", "ĳ": "ij", "Ĳ": "IJ"}
SEVERAL |= {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ё": "io", "ю": "iu", "я": "ia", "є": "ie", "ї": "yi"}
SEVERAL |= {"Ж": "Zh", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ё": "Io", "Ю": "Iu", "Я": "Ia", "Є": "Ie", "Ї": "Yi"}
SEVERAL |= {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "Θ": "Th", "Φ": "Ph", "Χ": "Kh", "Ψ": "Ps"}
SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "‐": "-", "‑": "-", "•": "*", "¡": "!", "¿": "?", "²": "2", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
CYRILLIC = dict(zip("абвгдезийклмнопрстуфъыьэіґ", "abvgdeziiklmnoprstuf'y'eig"))
GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυω", "abgdezeiklmnxoprsstuo"))


@cache
def single_letters() -> dict[str, str]:
    """Every character that becomes one: accented letters by their base letter, and the fixed ones."""
    out = CYRILLIC | GREEK
    out |= {k.upper(): v.upper() for k, v in out.items() if len(k.upper()) == 1}
    for code in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        base = out.get(base, base)
        if base != chr(code) and base.isascii():
            out.setdefault(chr(code), base)
    return out | SINGLE


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def remove_urls(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, r"(?U)http\S+", "")).otherwise(text)


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)@\S+", "")


def to_ascii(text: Column) -> Column:
    """Latin, Greek and Cyrillic letters, quotes and dashes as ASCII; characters of other scripts go."""
    single = single_letters()
    out = F.translate(text, "".join(single), "".join(single.values()))
    for one, many in SEVERAL.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"[^\x00-\x7F]", "")).otherwise(text)


def split_words(text: Column) -> Column:
    """Parts between apostrophes and spaces, empty ones too."""
    return F.split(text, "[' ]", -1)


def drop_long_numbers(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"\A\p{Nd}{5,}\z"))


def split_hashtag(word: Column) -> Column:
    """A word that begins with #, without it, cut where case changes: behind a small letter, and
    before the last of several capitals that a small letter follows. Other words stay."""
    name = F.substring(word, F.lit(2), F.length(word))
    parts = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.when(F.startswith(word, F.lit("#")), parts).otherwise(word)


def squeeze_repeats(text: Column) -> Column:
    """Line ends go; more than three equal characters in a row become three."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("")), r"(?s)(.)\1{3,}", "$1$1$1")


def format_text(text: Column, remove_mention: bool = False, ascii_only: bool = True, lower: bool = True, hashtag_split: bool = True) -> Column:
    """The cleaning chain: urls, mentions, ASCII, word split, long numbers, hashtags, repeats, case."""
    out = remove_urls(null_to_empty(text))
    out = remove_mentions(out) if remove_mention else out
    out = to_ascii(out) if ascii_only else out

    def worded(text: Column) -> Column:
        words = drop_long_numbers(split_words(text))
        words = F.transform(words, split_hashtag) if hashtag_split else words
        # without long numbers and hashtags, the words come back as they were
        some = text.rlike(r"\p{Nd}{5}|#") if hashtag_split else text.rlike(r"\p{Nd}{5}")
        return F.when(some, F.array_join(words, " ")).otherwise(F.replace(text, F.lit("'"), F.lit(" ")))

    out = squeeze_repeats(bound(out, worded))
    return F.lower(out) if lower else out


def tokens(text: Column) -> Column:
    """Words of two word characters and more."""
    plain, any_script = (F.regexp_extract_all(text, F.lit(word), F.lit(0)) for word in (r"[A-Za-z0-9_]{2,}", r"(?U)\b\w\w+\b"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), any_script).otherwise(plain)


def lower_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def white_split(text: Column) -> Column:
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"(?U)\s+"))


#: Entities of posts, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def social_tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case ASCII words and mentions of a post: entities decoded, hashtags split, repeats
    squeezed, stop words (also with an apostrophe behind) left out."""
    plain = text
    for entity, mark in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(mark))
    spaced = F.array_join(F.transform(F.split(remove_urls(plain), r"(?U)\s+"), split_hashtag), " ")
    found = F.regexp_extract_all(F.lower(squeeze_repeats(to_ascii(spaced))), F.lit(r"@?[a-z0-9_]+'?[a-z0-9_]*"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def parse_created_at(text: Column) -> Column:
    """``Mon Jul 16 05:00:56 +0000 2018`` or ``2018-07-16 05:00:56``; null for anything else."""
    long = F.try_to_timestamp(F.substring(text, F.lit(5), F.length(text)), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.when(F.contains(text, F.lit("+0000")), long).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def date_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def time_of(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def one_line(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def media_url(media: Column) -> Column:
    """media_url of the first of an array of structs, null without any."""
    return F.get(media, F.lit(0))["media_url"]

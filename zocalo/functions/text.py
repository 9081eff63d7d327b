"""Text normal forms as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Where a character can stand for several others, as ranges that are looked for before their table is used. A range's table
# is worked out from the character database; the first holds what is common, the others what a text has only in special scripts.
EXPANDED_RANGES = (((0x80, 0x250), (0x2026, 0x2027), (0x2122, 0x2123), (0xFB00, 0xFB07)),
                   ((0x250, 0x2026), (0x2027, 0x2122), (0x2123, 0x2E80)),
                   ((0x2E80, 0x3400),), ((0x3400, 0xAC00), (0xD7A4, 0xFB00), (0xFB07, 0xFE00)), ((0xFE00, 0x10000),), ((0x10000, 0x20000),))
#: No other character decomposes, but for Hangul syllables.
DECOMPOSING = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20))
# A Hangul syllable is composed of one of 19 leading, 21 vowel and 27 trailing letters (or none) by its number.
HANGUL, LEADS, VOWELS, TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A8
LETTERS = "".join(chr(c) for c in (*range(LEADS, LEADS + 19), *range(VOWELS, VOWELS + 21), *range(TRAILS, TRAILS + 27)))


def strip_marks(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, list[dict[str, str]]]:
    """Characters to map one-to-one, their bases, and for each list of ranges those that expand to several."""
    source, base, dropped = [], [], []
    expanded: list[dict[str, str]] = [{} for _ in EXPANDED_RANGES]
    for low, high in DECOMPOSING:
        for char in map(chr, range(low, high)):
            if not unicodedata.decomposition(char) and not unicodedata.combining(char):
                continue
            plain = strip_marks(char)
            if plain == "":
                dropped.append(char)
            elif len(plain) == 1 and plain != char:
                source.append(char)
                base.append(plain)
            elif len(plain) > 1:
                own = next(i for i, ranges in enumerate(EXPANDED_RANGES) if any(a <= ord(char) < b for a, b in ranges))
                expanded[own][char] = plain
    return "".join(source + dropped), "".join(base), expanded


def _with_letters(x: Column) -> Column:
    """Hangul syllables as their letters, by the number of the syllable."""
    def letters(char: Column) -> Column:
        number = F.ascii(char) - HANGUL
        trail = number % 28
        pick = lambda place: F.substring(F.lit(LETTERS), place.cast("int"), F.lit(1))
        spelled = F.concat(pick(F.floor(number / 588) + 1), pick(F.floor((number % 588) / 28) + 20), F.when(trail > 0, pick(trail + 40)).otherwise(""))
        return F.when((number >= 0) & (number < 19 * 588), spelled).otherwise(char)

    return F.array_join(F.transform(F.split(x, ""), letters), "")


def without_accents(x: Column) -> Column:
    """Compatibility-decompose and drop combining marks in any script, without leaving the JVM.

    Each text only goes through the tables that its own characters ask for.
    """
    source, base, tables = _fold_table()
    # One text a table, cut at a mark that no text keeps: the character, then what it stands for.
    entries = lambda table: F.split(F.lit("\0".join(char + text for char, text in table.items())), "\0")
    expand = lambda value, table: F.aggregate(table, value, lambda done, e: F.replace(done, F.substring(e, 1, 1), F.substring(e, 2, 99)))
    any_of = lambda ranges: "[" + "".join(rf"\x{{{a:x}}}-\x{{{b - 1:x}}}" for a, b in ranges) + "]"
    plain = F.translate(x, source, base)
    common = F.when(x.rlike("[" + "".join(tables[0]) + "]"), expand(plain, entries(tables[0]))).otherwise(plain)
    asked = [F.when(x.rlike(any_of(ranges)), entries(table)).otherwise(F.expr("cast(array() AS array<string>)")) for ranges, table in zip(EXPANDED_RANGES, tables)]
    spelled = F.when(x.rlike(any_of([(HANGUL, HANGUL + 19 * 588)])), _with_letters(x)).otherwise(x)
    rare = expand(F.translate(spelled, source, base), F.concat(*asked))
    beyond = any_of([(0x250, 0x2010), (0x2027, 0x20A0), (0x2100, 0x2122), (0x2123, 0xFB00), (0xFB07, 0x110000)])
    return F.when(~x.rlike(r"[^\x00-\x7F]"), x).when(x.rlike(beyond), rare).otherwise(common)


def fold(x: Column) -> Column:
    """Accent-free lower case, the form keywords are looked up in."""
    return F.lower(without_accents(x))


@F.pandas_udf(StringType())
def fold_any_script(x: pd.Series) -> pd.Series:
    """Same as ``fold``, character by character in Python; tests hold the native form against it."""
    return x.map(lambda v: None if v is None else strip_marks(v).lower())


def clean_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fingerprint_form(x: Column) -> Column:
    """Folded, punctuation other than hyphens to spaces, single spaces."""
    return clean_spaces(F.regexp_replace(fold(x), r"(?U)[^\w\s-]", " "))


def token(x: Column) -> Column:
    plain = x.rlike("^[a-z0-9_-]*$")  # most values are tokens already
    return F.when(plain, x).otherwise(F.replace(fingerprint_form(x), F.lit(" "), F.lit("_")))


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def compare_form(x: Column) -> Column:
    """Form in which two texts count as equal: case, accents and separators ignored."""
    return F.trim(F.regexp_replace(without_accents(casefold(x)), r"(?U)[_\s]+", " "))


def sql_form(x: Column) -> Column:
    """Form in which two logged queries count as the same text."""
    return casefold(F.trim(F.rtrim(clean_spaces(x), F.lit(";"))))


def tag_form(x: Column) -> Column:
    return F.btrim(F.regexp_replace(casefold(F.trim(x)), r"[^a-z0-9_.:/-]+", "-"), F.lit("-"))


def contains_any(column: str, words: list[str]) -> Column:
    """Substring test for any of the words; byte matching, no regex."""
    return F.expr(" OR ".join(f"contains({column}, '{word}')" for word in words))

"""Column expressions on text: keys, normalisers and rule lists.

A rule list is data: (name, pattern). Patterns keep to what Java and RE2 read alike.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_key(url: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def content_hash(url: str, title: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(url)), F.lower(F.trim(title))), 256)


def headline_key(text: str) -> Column:
    """Upper case; runs of dots become an ellipsis; other punctuation but - goes; spaces collapse."""
    dots = F.regexp_replace(F.upper(text), r"\.\.+|…", "...")
    return F.trim(F.regexp_replace(F.regexp_replace(dots, r"[^\p{L}\p{N}_\s.\-]", ""), r"\s+", " "))


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def count_matches(text: str, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(F.lower(text), F.lit(p)) for _, p in rules])


def any_part(low: Column, parts: tuple[str, ...], held: Column | None = None) -> Column:
    """Whether the text has one of the parts; looked for before a pattern that needs one, as that costs a fraction of it.

    ``held``: the text's different words in a row. A part of letters lies within one of them, so it is looked for there, once however often the word stands.
    """
    return reduce(lambda a, b: a | b, [F.contains(low if held is None or not re.fullmatch("[a-z0-9_]+", p) else held, F.lit(p)) for p in parts])


def first_rule(text: str, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule that the text matches; null if none."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(name)) for name, p in rules])


def hits(text: str, rules: list[tuple[str, str]]) -> Column:
    """Number of rules that the text matches."""
    return reduce(lambda a, b: a + b, [F.lower(text).rlike(p).cast("int") for _, p in rules])


def matches_any(low: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches, in one pass over the text."""
    return low.rlike("|".join(f"(?:{p})" for p in patterns))


def once(c: Column) -> Column:
    """The column under a condition that the optimiser keeps in its place, so that it is worked out once however often it is used."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def worded(df: DataFrame, text: str) -> DataFrame:
    """Adds _low, the text in lower case, and _words, its different words."""
    return df.withColumn("_low", once(F.lower(text))).withColumn("_words", once(words_of(F.col("_low"))))


def words_of(low: Column) -> Column:
    """The different words of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)))


def any_word(found: list[str], words: Column | str = "_words") -> Column:
    return F.exists(words, lambda w: w.isin(list(found)))


def any_phrase(phrases: list[str], words: Column | str = "_words") -> Column:
    """Whether a text has a word with which one of the phrases begins."""
    return any_word(sorted({re.match("[a-z]+", p)[0] for p in phrases} | {x + "s" for p in phrases for x in re.findall(r"^([a-z]+)s\?", p)}), words)


def jaccard(a: str, b: str) -> Column:
    """Of two arrays of tokens; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

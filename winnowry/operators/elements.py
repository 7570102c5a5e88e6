"""Elements, scores and normalisers of texts: columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnowry.functions import rules, text


def first_match(text: Column, patterns: list[str], group: int = 0) -> Column:
    """What the first pattern that matches finds; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def spoken(words: Column, spelt: dict[str, str]) -> Column:
    """What a pattern captures of the words that it matches."""
    held = F.filter(words, lambda w: w.isin(list(spelt)))
    if all(w == told for w, told in spelt.items()):
        return held
    table = F.create_map(*[F.lit(x) for pair in spelt.items() for x in pair])
    return F.transform(held, lambda w: table[w])


def extracted(whole: str, low: Column | None = None, words: Column | None = None) -> dict[str, Column]:
    """The sixteen arrays of a text by name, multipliers as one; ``low`` and ``words`` are those of ``text.worded``, where it was applied.

    Word lists are looked up among the text's words, unless it has the first word of a phrase of the list; patterns run where the text has what they need.
    """
    low = F.lower(whole) if low is None else low
    words = text.words_of(low) if words is None else words
    every, none = (lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))), F.array().cast("array<string>")
    found = {}
    for name, patterns in rules.ELEMENTS.items():
        if name not in rules.DISTINCT:
            found[name] = F.concat(*[F.when(text.any_part(low, rules.PARTS[p]), every(p)).otherwise(none) for p in patterns])
            continue
        phrases, held = rules.LEXICONS[rules.LISTS[name]][1], spoken(words, rules.spelt(name))
        if phrases:
            held = F.when(text.any_phrase(phrases, words), every(patterns[0])).otherwise(held)
        found[name] = F.array_sort(F.array_distinct(held))
    found["times"] = F.concat(found["times"], F.transform(found.pop("folds"), lambda x: F.concat(x, F.lit("-fold"))))
    return found


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def likeness(similarity: Column, newswords: Column) -> Column:
    """Score from 0 to 100: similarity from 0.6 on, less ten for each news word, thirty at most; 50 without a corpus."""
    raw = F.least(F.greatest((similarity - 0.6) * 250, F.lit(0.0)), F.lit(100.0)) - F.least(10 * newswords, F.lit(30))
    return F.when(similarity.isNull(), 50).otherwise(F.least(F.greatest(raw.cast("int"), F.lit(0)), F.lit(100)))


def final_score(like: Column, category: Column, clarity: Column) -> Column:
    return 0.45 * like + 0.35 * category + 0.20 * clarity * 10


def archetype(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.ARCHETYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit("STUDY_STAT"))


def one_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def type_by_source(source: str = "source_name", given: str = "content_type") -> Column:
    """The type that the source's name tells, for items that are news so far."""
    low, out = F.lower(source), F.when(F.col(given) != "news", F.col(given))
    for name, found in rules.TYPES_BY_SOURCE:
        out = out.when(one_of(low, found), name)
    return out.otherwise("news")


def type_by_address(source: str = "source_name", url: str = "url") -> Column:
    out = F
    for name, found in rules.TYPES_BY_ADDRESS:
        out = out.when(one_of(F.lower(source), found) | one_of(F.lower(url), found), name)
    return out.otherwise("news")


def route(source: str = "source_name", url: str = "url") -> Column:
    """paper, preprint, skip (domains that are not fetched) or news."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.when(F.contains(F.lower(url), F.lit("pubmed")) | (F.lower(source) == "pubmed") | F.contains(url, F.lit("ncbi.nlm.nih.gov")), "paper").when(one_of(F.lower(url), rules.PREPRINTS), "preprint").when(one_of(F.lower(host), rules.SKIPPED_DOMAINS), "skip").otherwise("news")


def numeric_id(url: str = "url") -> Column:
    return first_match(F.col(url), [r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", r"\?term=(\d+)\[uid\]"], 1)


def study_type(abstract: str) -> Column:
    out = F
    for name, found in rules.STUDY_TYPES:
        out = out.when(one_of(F.lower(abstract), found), name)
    return out


def sample_size(abstract: str) -> Column:
    return first_match(F.lower(abstract), [rules.SAMPLE_SIZE], 1)


def without_tags(text: Column) -> Column:
    """Tags made spaces, common entities read, spaces collapsed."""
    plain = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def without_boilerplate(text: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), rules.BOILERPLATE, text))


def clean_headline(headline: str) -> Column:
    """Prefixes of sources stripped, the first letter a capital, no exclamation, single dots."""
    t = reduce(lambda c, p: F.regexp_replace(c, p, ""), rules.HEADLINE_PREFIXES, F.trim(headline))
    t = F.trim(t)
    t = F.when(t.rlike("^[a-z]"), F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))).otherwise(t)
    return F.regexp_replace(F.replace(t, F.lit("!"), F.lit(".")), r"\.{2,}", ".")


def clean_slide(headline: str) -> Column:
    t = reduce(lambda c, p: F.regexp_replace(c, p, ""), rules.SLIDE_PREFIXES, F.upper(headline))
    t = F.regexp_replace(F.replace(t, F.lit("!"), F.lit("")), r"\.{2,}|…", ",")
    t = F.regexp_replace(F.regexp_replace(t, r",\s*,", ","), r"\s+,", ",")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_caption(caption: Column, source: str = "source_name", url: str = "url") -> Column:
    """No hashtags, a line that names the source, at most two line ends together."""
    t = F.regexp_replace(caption, r"#\w+\s*", "")
    named = F.when(F.contains(F.lower(t), F.lit("source:")), t).otherwise(F.concat(F.rtrim(t), F.lit("\n\nSource: "), F.col(source), F.lit(" - "), F.col(url)))
    return F.trim(F.regexp_replace(named, r"\n{3,}", "\n\n"))


def repaired(response: str) -> Column:
    """The JSON of a response: a fenced block, else from the first brace to the last, else all of it."""
    return F.coalesce(first_match(F.col(response), [r"(?s)```(?:json)?\s*(.*?)\s*```"], 1), first_match(F.col(response), [r"(?s)\{.*\}"]), F.col(response))

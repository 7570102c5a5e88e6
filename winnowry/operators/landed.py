"""Parsers of landed payloads: columns and DataFrames in, item rows out. Pages are read by ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions.text import once
from winnowry.operators.elements import without_tags


ITEM = "title: string, link: string, summary: string, description: string, published: string, pubDate: string, updated: string, created: string, author: array<string>, category: array<string>"
ENTRY = "title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string, created: string, author: array<struct<name: string>>, category: array<struct<_term: string>>"
#: A feed's root is rss (items in its channel), RDF (items beside it) or feed (entries); a single landed item is a feed of one.
FEED = f"channel struct<item: array<struct<{ITEM}>>>, item array<struct<{ITEM}>>, entry array<struct<{ENTRY}>>, {ITEM.replace(': ', ' ')}"
#: Formats of dates in order; a weekday before the date is cut off.
DATES = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z", "yyyy-MM-dd")
#: What a date has wherever its format reads it; looked for first, as a failed attempt to read costs far more.
SHAPES = (r"\d[Tt]\d", r"\d[Tt]\d", r"\d \p{L}", r"\d \p{L}", r"\d-\d")


def instant(text: Column) -> Column:
    """The first format that reads the date; without a zone it is UTC; else null."""
    plain = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", ""))
    return F.coalesce(*[F.when(plain.rlike(s), F.try_to_timestamp(plain, F.lit(f))) for f, s in zip(DATES, SHAPES, strict=True)])


def feed_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Item rows of landed feeds - RSS, RDF or Atom, or one item each - with pos, the place in the feed. Other columns stay.

    Entries without link or title go. The summary, else the description, loses its tags and is cut at 2000 characters. The date is the first of
    published, updated and created that can be read. Atom links: the alternate one, else the first.
    """
    own = [c for c in payloads.columns if c != payload]
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    fields = lambda link, summary, dates, authors, tags, title: F.struct(link.alias("url"), F.trim(title).alias("title"), summary.alias("summary"), F.coalesce(*[instant(d) for d in dates]).alias("published_at"), texts(authors).alias("authors"), texts(tags).alias("categories"))
    first_told = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])

    def item(x: Column) -> Column:
        return fields(x["link"], first_told(x["summary"], x["description"]), (x["published"], x["pubDate"], x["updated"], x["created"]), x["author"], x["category"], x["title"])

    def entry(x: Column) -> Column:
        alternate = F.get(F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))
        return fields(F.coalesce(alternate, F.get(x["link"], F.lit(0)))["_href"], first_told(x["summary"], x["content"]), (x["published"], x["updated"], x["created"]), F.transform(x["author"], lambda a: a["name"]), F.transform(x["category"], lambda c: c["_term"]), x["title"])

    e = payloads.select(*own, F.from_xml(payload, FEED).alias("e"))
    several = lambda c, make: F.coalesce(F.transform(c, make), F.array())
    alone = F.when(F.col("e.title").isNotNull() & F.col("e.entry").isNull(), F.array(item(F.col("e"))))
    found = e.select(*own, F.posexplode(F.concat(several(F.col("e.channel.item"), item), several(F.col("e.item"), item), several(F.col("e.entry"), entry), F.coalesce(alone, F.array()))).alias("pos", "i"))
    rows = found.select(*own, "pos", "i.url", "i.title", F.left(without_tags(F.col("i.summary")), F.lit(2000)).alias("summary"), "i.published_at", "i.authors", "i.categories")
    return rows.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def summaries(payloads: DataFrame, base: str, payload: str = "payload") -> DataFrame:
    """Rows of landed article summaries, keyed by id: title without its last dot, address from the id, parts joined."""
    read = F.from_json(payload, "result map<string, struct<title: string, pubdate: string, source: string>>")
    each = payloads.select(F.explode(read["result"]).alias("id", "r"))
    return each.select("id", F.concat(F.lit(base), F.col("id"), F.lit("/")).alias("url"), F.regexp_replace("r.title", r"\.$", "").alias("title"), F.concat_ws(" | ", "r.source", "r.pubdate").alias("summary"))


ARTICLE = "Journal struct<Title: string>, Abstract struct<AbstractText: string>, AuthorList struct<Author: array<struct<LastName: string, ForeName: string>>>, ArticleIdList struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>"


def articles(payloads: DataFrame, xml: str = "payload") -> DataFrame:
    """Abstract, journal, the first five authors, the first DOI of articles' XML, which is read once; other columns stay."""
    own, a = [c for c in payloads.columns if c != xml], F.col("_article")
    named = F.filter(F.slice(a["AuthorList"]["Author"], 1, 5), lambda x: x["LastName"].isNotNull())
    doi = F.get(F.filter(a["ArticleIdList"]["ArticleId"], lambda x: x["_IdType"] == "doi"), F.lit(0))
    read = payloads.select(*own, once(F.from_xml(xml, ARTICLE)).alias("_article"))
    return read.select(*own, a["Abstract"]["AbstractText"].alias("abstract"), a["Journal"]["Title"].alias("journal"), F.array_join(F.transform(named, lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])), "; ").alias("authors"), doi["_VALUE"].alias("doi"))

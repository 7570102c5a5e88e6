"""Elements of landed pages by selectors: texts of articles, links of listings, abstracts. Pages are parsed in Arrow batches; all rules are columns.

A selector is one element's: ``tag``, ``.word`` of the class, ``#id``, ``[attribute]``, ``[attribute='value']`` or ``[attribute*='part']``, in any combination.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnowry.functions import markup, rules
from winnowry.operators.elements import without_boilerplate

#: Bytes of pages that a task parses at once; a longer page is alone.
BYTES = 1 << 20
PARTS = re.compile(r"""(?P<tag>^[a-z][a-z0-9]*)|\.(?P<word>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<how>\*?=)['"](?P<value>[^'"]*)['"])?\]""")


def matching(selector: str) -> Callable[[Column], Column]:
    """Whether a node is what the selector names."""
    found, end = [], 0
    for m in PARTS.finditer(selector):
        if m.start() != end:
            break
        end = m.end()
        found.append({k: v for k, v in m.groupdict().items() if v is not None})
    if not found or end != len(selector):
        raise ValueError(f"not a selector of one element: {selector}")

    def test(node: Column) -> Column:
        out = F.lit(True)
        for part in found:
            name = part.get("name") or ("class" if "word" in part else "id")
            held = node["attrs"][name]
            if "tag" in part:
                out = out & (node["tag"] == part["tag"])
            elif "word" in part:
                out = out & F.array_contains(F.split(held, r"\s+"), part["word"])
            elif "id" in part:
                out = out & (held == part["id"])
            elif part.get("how") == "*=":
                out = out & F.contains(held, F.lit(part["value"]))
            elif part.get("how") == "=":
                out = out & (held == part["value"])
            else:
                out = out & held.isNotNull()
        return F.coalesce(out, F.lit(False))

    return test


def stretches_of(sizes: pa.Array) -> list[tuple[int, int]]:
    """(first, number) of stretches of pages that begin within the same ``BYTES``, so that many short pages go together and few long ones."""
    import numpy as np

    n = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // BYTES)) + 1
    edges = [0, *cuts.tolist(), len(n)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo]


def with_nodes(pages: DataFrame, html: str = "html", without: tuple[str, ...] = (), into: str = "nodes") -> DataFrame:
    """``pages`` with the nodes of their markup, less the elements named in ``without``."""
    gone = frozenset(without)

    def run(batches):
        for whole in batches:
            for lo, n in stretches_of(pc.binary_length(whole.column(html))):
                batch = whole.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, markup.parsed(batch.column(html), gone)], [*batch.schema.names, into])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, T.DataType.fromDDL(markup.SCHEMA))]))


def first(nodes: Column, selector: str, inside: bool = False) -> Column:
    """(at, node) of the first node that the selector names, from 1 on; ``inside``: below the first node. Null if there is none."""
    test = matching(selector)
    at = F.array_position(F.transform(nodes, lambda n, i: test(n) & (i > 0) if inside else test(n)), True).cast("int")
    return F.when(at > 0, F.struct(at.alias("at"), F.get(nodes, at - 1).alias("node")))


def text_of(nodes: Column, at: Column, last: Column, glue: str = " ") -> Column:
    """Texts below the node at a place, from 1 on."""
    below = F.slice(nodes, at + 1, last + 1 - at)
    return F.array_join(F.transform(F.filter(below, lambda n: n["text"].isNotNull()), lambda n: n["text"]), glue)


def found_text(nodes: Column, selector: str, glue: str = " ", inside: bool = False) -> Column:
    """Text of the first such element, of a meta element its content; null if there is none."""
    one = first(nodes, selector, inside)
    return F.when(one["node"]["tag"] == "meta", F.coalesce(one["node"]["attrs"]["content"], F.lit(""))).when(one.isNotNull(), text_of(nodes, one["at"], one["node"]["last"], glue))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def page_text(pages: DataFrame, html: str = "html", least: int = 500, most: int = 5000, places: tuple[str, ...] = rules.TEXT_PLACES) -> DataFrame:
    """Adds body: the first place's text of ``least`` characters, else all paragraphs of fifty, else the meta description, else "". A null page has none."""
    nodes = F.col("nodes")
    tried = [without_boilerplate(collapsed(found_text(nodes, place))) for place in places]
    long = [F.when(F.length(t) >= least, F.left(t, F.lit(most))) for t in tried]
    paragraphs = F.transform(nodes, lambda n, i: F.when(n["tag"] == "p", text_of(nodes, i + 1, n["last"], "")))
    joined = F.left(F.array_join(F.filter(paragraphs, lambda p: F.length(p) >= 50), " "), F.lit(most))
    body = F.coalesce(*long, F.nullif(joined, F.lit("")), found_text(nodes, "meta[name='description']"), F.lit(""))
    return with_nodes(pages, html, rules.NOT_CONTENT).select(*pages.columns, F.when(F.col(html).isNotNull(), body).alias("body"))


def preprint_text(pages: DataFrame, html: str = "html", summary: str = "summary", places: tuple[str, ...] = rules.ABSTRACT_PLACES) -> DataFrame:
    """Adds body: the summary from 400 characters on; else the first place that has 200, else the last that there is; the summary where that is empty."""
    found = F.array_compact(F.array(*[found_text(F.col("nodes"), place) for place in places]))
    long = F.get(F.filter(found, lambda t: F.length(t) >= 200), F.lit(0))
    last = F.get(found, F.size(found) - 1)
    given = F.coalesce(summary, F.lit(""))
    body = F.when(F.length(given) >= 400, given).otherwise(F.coalesce(F.nullif(F.coalesce(long, last), F.lit("")), given))
    return with_nodes(pages, html).select(*pages.columns, body.alias("body"))


@dataclass(frozen=True)
class Listing:
    """How a site lists its articles. Selectors but the first count from the article down; without one for the title it is the article's own text."""

    articles: str = "a"
    address: str = "href"
    prefix: str = ""
    title: str | None = None
    date: str | None = None
    date_format: str | None = None
    summary: str | None = None
    wanted: Callable[[Column], Column] | None = None


def listed(pages: DataFrame, rules_: Listing, instant: Callable[[Column], Column], html: str = "html") -> DataFrame:
    """Item rows of listing pages: the pages' other columns, pos, url, title, published_at and summary, of articles that have an address and a title.

    ``instant`` reads a date that no format is given for. Relative addresses go below the prefix; ``wanted`` takes the address.
    """
    own = [c for c in pages.columns if c != html]
    test = matching(rules_.articles)
    nodes = F.col("nodes")
    stretches = F.transform(nodes, lambda n, i: F.when(test(n), F.transform(F.slice(nodes, i + 1, n["last"] - i + 1), lambda m: F.struct(m["tag"].alias("tag"), (m["last"] - i).alias("last"), m["attrs"].alias("attrs"), m["text"].alias("text")))))
    each = with_nodes(pages, html).select(*own, F.posexplode(F.filter(stretches, lambda s: s.isNotNull())).alias("pos", "article"))
    article = F.col("article")
    top = F.get(article, F.lit(0))
    link = F.when(top["tag"] == "a", top).otherwise(first(article, "a", inside=True)["node"])
    url = F.coalesce(link["attrs"][rules_.address], F.lit(""))
    url = F.when(url.startswith("/"), F.concat(F.lit(rules_.prefix), url)).otherwise(url)
    title = found_text(article, rules_.title, "", inside=True) if rules_.title else text_of(article, F.lit(1), top["last"], "")
    date = summary = F.lit(None)
    if rules_.date:
        one = first(article, rules_.date, inside=True)
        told = F.coalesce(F.nullif(one["node"]["attrs"]["datetime"], F.lit("")), found_text(article, rules_.date, "", inside=True))
        date = F.try_to_timestamp(told, F.lit(rules_.date_format)) if rules_.date_format else instant(told)
    if rules_.summary:
        summary = F.left(found_text(article, rules_.summary, "", inside=True), F.lit(500))
    found = each.select(*own, "pos", url.alias("url"), title.alias("title"), date.cast("timestamp").alias("published_at"), summary.cast("string").alias("summary")).where("url <> '' and title <> ''")
    return found if rules_.wanted is None else found.where(rules_.wanted(F.col("url")))


def body_or_summary(items: DataFrame, pages: DataFrame, key: str = "url_key", paper: int = 600, other: int = 1200) -> DataFrame:
    """Items with the text of their landed page, or their summary where none came; outcome tells success, insufficient (under the least length of the type) or failed.

    items: (key, summary, content_type, ...), pages: (key, body), one row a key; a null body is a failed fetch.
    """
    held = pages.select(F.col(key).alias("_key"), F.col("body").alias("_body"))
    joined = items.join(held, F.col(key) == F.col("_key"), "left")
    body = F.coalesce("_body", "summary", F.lit(""))
    enough = F.length("body") >= F.when(F.col("content_type") == "paper", paper).otherwise(other)
    out = joined.withColumn("body", body)
    return out.withColumn("outcome", F.when(F.col("_body").isNull(), "failed").when(enough, "success").otherwise("insufficient")).withColumn("enough", enough).drop("_key", "_body")

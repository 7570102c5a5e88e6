"""Queries of parsers, page text, exports and ledgers, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from winnowry.functions import rules
from winnowry.functions.text import url_key
from winnowry.operators import corpus, landed, origins, pages, triage
from winnowry.operators.elements import without_boilerplate, without_tags
from winnowry.plans.columns import quoted
from winnowry.plans.queries import query
from winnowry.sources import tables

RSS_ITEM = "concat('<item><title> ', title, ' </title>', case when item_id % 7 = 0 then '' else concat('<link>', url, '</link>') end, '<pubDate>Mon, ', date_format(coalesce(published_at, timestamp '2020-01-01'), 'dd MMM yyyy HH:mm:ss'), ' +0000</pubDate><description>&lt;p&gt;', body_text, '&lt;/p&gt;</description><category>', content_type, '</category><category>', source_name, '</category></item>')"
ATOM_ENTRY = "concat('<entry><title> ', title, ' </title>', case when item_id % 7 = 0 then '' else concat('<link rel=\"self\" href=\"https://self.example\"/><link href=\"', url, '\"/>') end, '<updated>', date_format(coalesce(published_at, timestamp '2020-01-01'), 'yyyy-MM-dd\\'T\\'HH:mm:ss'), 'Z</updated><summary>', body_text, '</summary><category term=\"', content_type, '\"/><category term=\"', source_name, '\"/></entry>')"


@query("s01_feed_items", "select item_id // 40 as feed, url, trim(title) as title, left(trim(body_text), 2000) as summary, coalesce(published_at, timestamp '2020-01-01') as published_at, content_type || ',' || source_name as categories from fx_items where item_id % 7 <> 0", ("fx_items",))
def _(spark, d, items):
    """Feeds of up to forty entries, RSS and Atom in turn."""
    feed = F.floor(F.col("item_id") / 40)
    each = items.select(feed.alias("feed"), "item_id", F.when(feed % 2 == 0, F.expr(RSS_ITEM)).otherwise(F.expr(ATOM_ENTRY)).alias("entry"))
    feeds = each.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "entry"))), lambda x: x["entry"]), "").alias("entries"))
    rss, atom = F.concat(F.lit("<rss version=\"2.0\"><channel><title>All</title><link>https://x.example</link>"), "entries", F.lit("</channel></rss>")), F.concat(F.lit("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>All</title>"), "entries", F.lit("</feed>"))
    found = landed.feed_items(feeds.select("feed", F.when(F.col("feed") % 2 == 0, rss).otherwise(atom).alias("payload")))
    return found.select("feed", "url", "title", "summary", "published_at", F.array_join("categories", ",").alias("categories"))


@query("s02_dates", "select item_id, case item_id % 4 when 3 then null when 2 then date_trunc('day', published_at) else published_at end as published_at from fx_items", ("fx_items",))
def _(spark, d, items):
    sent = F.expr("case item_id % 4 when 0 then date_format(published_at, \"yyyy-MM-dd'T'HH:mm:ss\") when 1 then concat('Tuesday, ', date_format(published_at, 'dd MMM yyyy HH:mm:ss'), ' +0000') when 2 then date_format(published_at, 'yyyy-MM-dd') else 'some day' end")
    return items.select("item_id", sent.alias("sent")).select("item_id", landed.instant(F.col("sent")).alias("published_at"))


def sql_plain(col: str) -> str:
    out = f"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {quoted(entity)}, {quoted(character)})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


ANCHOR = r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'
SITE = pages.Listing(articles="a", prefix="https://site.org", date="time")
LINKS = f"""with a as (select page_id, unnest(regexp_extract_all(html, {quoted(ANCHOR)})) as a, generate_subscripts(regexp_extract_all(html, {quoted(ANCHOR)}), 1) - 1 as pos from pages),
l as (select page_id, pos, regexp_extract(a, '(?is)href="([^"]*)"', 1) as href, {sql_plain('a')} as title from a)
select page_id, pos::int as pos, case when starts_with(href, '/') then 'https://site.org' || href else href end as url, title from l where title <> '' and href <> ''"""


@query("s03_listed_links", LINKS)
def _(spark, d):
    return pages.listed(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), SITE, landed.instant).select("page_id", "pos", "url", "title")


@query("s04_listing_dates", "select item_id, case when item_id % 3 = 0 then null else date_trunc('day', published_at) end as published_at from fx_items", ("fx_items",))
def _(spark, d, items):
    html = items.select(F.col("item_id").alias("page_id"), F.expr("concat('<a href=\"/x\"><time datetime=\"', case when item_id % 3 = 0 then 'soon' else coalesce(date_format(published_at, 'yyyy-MM-dd'), '') end, '\">t</time> read</a>')").alias("html"))
    return pages.listed(html, SITE, landed.instant).select(F.col("page_id").alias("item_id"), "published_at")


@query("s05_summaries", "select cast(item_id as varchar) as id, 'https://papers.org/' || item_id || '/' as url, title, source_name || case when published_at is null then '' else ' | ' || strftime(published_at, '%Y-%m-%d') end as summary from fx_items", ("fx_items",))
def _(spark, d, items):
    one = F.struct(F.concat("title", F.lit(".")).alias("title"), F.date_format("published_at", "yyyy-MM-dd").alias("pubdate"), F.col("source_name").alias("source"))
    payload = F.to_json(F.struct(F.create_map(F.col("item_id").cast("string"), one).alias("result")))
    return landed.summaries(items.select(payload.alias("payload")), "https://papers.org/")


@query("s06_search_ids", "select event_id, case when event_id % 3 = 0 then '' else 'id' || event_id end as first_id, (event_id % 3)::int as n from events")
def _(spark, d):
    ids = F.transform(F.sequence(F.lit(0), F.col("event_id") % 3), lambda i: F.when(i == 0, F.concat(F.lit("id"), F.col("event_id"))).otherwise(F.concat(F.lit("other"), i)))
    kept = F.slice(ids, F.lit(1), (F.col("event_id") % 3).cast("int"))
    sent = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct(F.struct(kept.alias("idlist")).alias("esearchresult"))).alias("payload"))
    read = sent.select("event_id", F.from_json("payload", "esearchresult struct<idlist: array<string>>").alias("r"))
    return read.select("event_id", F.coalesce(F.get("r.esearchresult.idlist", F.lit(0)), F.lit("")).alias("first_id"), F.size("r.esearchresult.idlist").alias("n"))


ARTICLE = "concat('<Article><Journal><Title>', source_name, '</Title></Journal><Abstract><AbstractText>', title, '</AbstractText></Abstract><AuthorList>', repeat('<Author><LastName>Roe</LastName><ForeName>Jo</ForeName></Author>', cast(item_id % 8 as int)), '<Author><LastName>Poe</LastName></Author></AuthorList><ArticleIdList><ArticleId IdType=\"pmid\">1</ArticleId><ArticleId IdType=\"doi\">10.1/', cast(item_id as string), '</ArticleId></ArticleIdList></Article>')"


@query("s07_articles", "select item_id, title as abstract, source_name as journal, array_to_string(list_concat(list_transform(range(least(item_id % 8, 5)), lambda i: 'Jo Roe'), case when item_id % 8 < 5 then ['Poe'] else [] end), '; ') as authors, '10.1/' || item_id as doi from fx_items", ("fx_items",))
def _(spark, d, items):
    return landed.articles(items.select("item_id", F.expr(ARTICLE).alias("payload")))


CORPUS = "select title || case when item_id % 5 = 0 then ', \"quoted\"' else '' end as headline from fx_items where item_id % 50 <> 0 union all select 'Title'"


@query("s08_corpus", f", c as ({CORPUS}) select trim(headline) as headline, count(*) as n from c where trim(headline) <> '' group by 1", ("fx_items",))
def _(spark, d, items):
    """A corpus as CSV of two columns, in as many files as there are ranges, with headers, blanks, quotes and a later cell that reads like a header."""
    told = F.when(F.col("item_id") % 50 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "title", F.when(F.col("item_id") % 5 == 0, F.lit(', "quoted"')).otherwise("")))
    rows = items.select("item_id", told.alias("Headline"), "source_name").unionByName(items.limit(1).select(F.lit(2**40).alias("item_id"), F.lit("Title").alias("Headline"), F.lit("x").alias("source_name")))
    path = tables.scratch(spark, "winners")
    rows.orderBy("item_id").select("Headline", "source_name").write.option("header", True).option("escape", '"').csv(path)
    return corpus.from_csv(spark, path).groupBy("headline").agg(F.count(F.lit(1)).alias("n"))


@query("s09_corpus_origin", "from (values ('first', 'sheet'), ('young', 'cache'), ('old', 'sheet'), ('forced', 'file'), ('nothing', 'none')) t(step, origin), (select count(distinct title) as all_, count(distinct title) filter (item_id % 2 = 0) as half from fx_items), lateral (select case step when 'nothing' then 0 when 'forced' then half else all_ end as n) select step, origin, n", ("fx_items",))
def _(spark, d, items):
    """The corpus asked for in turn: without a cache, with a young one, with an old one, past it while the first origin fails, and without any origin."""
    told = items.select(F.col("title").alias("headline"))
    sheet, file = ("sheet", lambda: told, True), ("file", lambda: items.where("item_id % 2 = 0").select(F.col("title").alias("headline")), False)
    broken = ("sheet", lambda: told.select(F.raise_error(F.lit("no answer")).alias("headline")), True)
    path, out = tables.scratch(spark, "cache"), []
    for step, as_of, origins, force in (("first", "2024-01-01", [sheet, file], False), ("young", "2024-01-01 12:00:00", [sheet, file], False), ("old", "2024-01-03", [sheet, file], False), ("forced", "2024-01-03", [broken, file], True), ("nothing", "2024-02-01", [], False)):
        found, origin = corpus.loaded(spark, path, origins, as_of, force=force)
        out.append(found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), F.lit(origin).alias("origin"), "n"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("s09_snapshot_is_fresh", "select source_name, max(published_at) as cached_at, coalesce(max(published_at) >= timestamp '1998-08-01' - interval 24 hour, false) as fresh from fx_items group by 1", ("fx_items",))
def _(spark, d, items):
    at = F.max("published_at")
    return items.groupBy("source_name").agg(at.alias("cached_at"), F.coalesce(at >= F.expr("timestamp '1998-08-01' - interval 24 hours"), F.lit(False)).alias("fresh"))


@query("s11_recent_for_dedupe", "select distinct regexp_replace(lower(trim(i.url)), '/+$', '') as url_key from fx_items i join fx_outputs o using (item_id) where o.created_at >= timestamp '1998-09-01' - interval 30 day", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    recent = outputs.where(F.col("created_at") >= F.expr("timestamp '1998-09-01' - interval 30 days"))
    return items.join(recent, "item_id", "left_semi").select(F.regexp_replace(F.lower(F.trim("url")), "/+$", "").alias("url_key")).distinct()


@query("s12_recent_findings", "select o.output_id, i.title as finding from fx_outputs o left join fx_items i using (item_id) where o.created_at >= timestamp '1998-09-01' - interval 60 day and coalesce(i.title, '') <> ''", ("fx_items", "fx_outputs"))
def _(spark, d, items, outputs):
    recent = outputs.where(F.col("created_at") >= F.expr("timestamp '1998-09-01' - interval 60 days"))
    return recent.join(items, "item_id", "left").where(F.coalesce("title", F.lit("")) != "").select("output_id", F.col("title").alias("finding"))


@query("s22_round_trip", "select item_id, url, title, published_at, case when item_id % 4 = 0 then 'news' else content_type end as content_type, 'B' as tier from fx_items", ("fx_items",))
def _(spark, d, items):
    sent = items.select("item_id", F.to_json(F.struct("url", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.when(F.col("item_id") % 4 != 0, F.col("content_type")).otherwise("unheard of").alias("content_type"))).alias("j"))
    r = sent.select("item_id", F.from_json("j", "url string, title string, published_at string, content_type string, tier string").alias("r"))
    kind = F.when(F.col("r.content_type").isin("paper", "press_release", "science_news", "policy", "news"), F.col("r.content_type")).otherwise("news")
    return r.select("item_id", "r.url", "r.title", landed.instant(F.col("r.published_at")).alias("published_at"), kind.alias("content_type"), F.coalesce("r.tier", F.lit("B")).alias("tier"))


SOURCES = "sources as (select source_name, case when n <= 3 then 'A' when n <= 6 then 'B' else 'C' end as tier, (n % 4)::int as priority, n % 5 <> 0 as enabled, case when n <= 3 then 3.0 when n <= 6 then 2.0 else 1.0 end::double as weight from (select source_name, row_number() over (order by source_name) as n from (select distinct source_name from fx_items)))"


def sources(items):
    """A source dimension of the items: tier, priority, whether enabled, weight."""
    named = triage.ranked(items.select("source_name").distinct(), [F.lit(0)], ["source_name"], "n")
    tier = F.when(F.col("n") <= 3, "A").when(F.col("n") <= 6, "B").otherwise("C")
    return named.select("source_name", tier.alias("tier"), (F.col("n") % 4).cast("int").alias("priority"), (F.col("n") % 5 != 0).alias("enabled"), F.when(F.col("n") <= 3, 3.0).when(F.col("n") <= 6, 2.0).otherwise(1.0).alias("weight"))


@query("s23_source_dimension", f", {SOURCES} select tier, string_agg(source_name, ',' order by source_name) as names from sources group by 1", ("fx_items",))
def _(spark, d, items):
    return sources(items).groupBy("tier").agg(F.array_join(F.array_sort(F.collect_list("source_name")), ",").alias("names"))


@query("s23_registry", f""", {SOURCES}, s as (select source_name, enabled, case when priority = 1 then 'study' when priority = 2 then 'sleep' end as word from sources where source_name <> 'Source 3'), n as (select 'Source 3' as source_name, true as enabled, 'fda' as word), k as (select * from s union all select * from n)
select item_id from fx_items join k using (source_name) where enabled and (word is null or contains(lower(title), word))""", ("fx_items",))
def _(spark, d, items):
    """Items that the sources' keywords let in, after one source was removed and added anew with a keyword of its own."""
    word = F.when(F.col("priority") == 1, "Study").when(F.col("priority") == 2, "sleep")
    known = sources(items).select(F.col("source_name"), F.lit(0).alias("pos"), "tier", "weight", "enabled", F.array_compact(F.array(word)).alias("keywords"))
    new = items.where("source_name = 'Source 3'").select("source_name").distinct().select("source_name", F.lit(1).alias("pos"), F.array(F.lit("FDA")).alias("keywords"))
    return origins.wanted(items, origins.added(origins.removed(known, ["Source 3"]), new)).select("item_id")


@query("g04_enabled_sources", f", {SOURCES} select item_id from fx_items join sources using (source_name) where enabled and tier in ('A', 'B')", ("fx_items",))
def _(spark, d, items):
    return items.join(sources(items).where("enabled and tier in ('A', 'B')"), "source_name", "left_semi").select("item_id")


@query("a05_registry_stats", f", {SOURCES} select tier, count(*) as n, count_if(enabled)::bigint as enabled from sources group by 1", ("fx_items",))
def _(spark, d, items):
    return sources(items).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("enabled"))


@query("w04_source_order", f", {SOURCES} select item_id, row_number() over (order by priority desc, source_name, pos)::int as place from fx_items join sources using (source_name)", ("fx_items",))
def _(spark, d, items):
    """Places in the order of (priority, source, pos): counts of sources before, and ranks within a source."""
    known = sources(items)
    sizes = items.groupBy("source_name").agg(F.count(F.lit(1)).alias("n")).join(known, "source_name")
    before = F.coalesce(F.sum("n").over(triage.Window.orderBy(F.desc("priority"), "source_name").rowsBetween(triage.Window.unboundedPreceding, -1)), F.lit(0))
    ranked = triage.ranked(items, ["source_name"], ["pos"])
    return ranked.join(F.broadcast(sizes.withColumn("before", before)), "source_name").select("item_id", (F.col("before") + F.col("rank")).cast("int").alias("place"))


@query("w09_weighted_sample", f""", {SOURCES}, u as (select item_id, tier, -ln((('0x' || substr(md5('7|' || item_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / weight as k from fx_items join sources using (source_name)),
r as (select *, row_number() over (partition by tier order by k, item_id) as i from u), q as (select *, i <= case tier when 'A' then 65 when 'B' then 25 else 10 end as inside from r),
f as (select *, row_number() over (order by k, item_id) as j from q where not inside) select item_id, tier from q where inside union all select item_id, tier from f where j <= 100 - (select count(*) from q where inside)""", ("fx_items",))
def _(spark, d, items):
    return triage.tier_sample(items.join(F.broadcast(sources(items).select("source_name", "tier", "weight")), "source_name"), 100, {"A": 0.65, "B": 0.25, "C": 0.10}).select("item_id", "tier")


#: The places of the text as patterns; they read pages whose containers hold no others of their kind, as those of the test tables.
CONTAINERS = [rf'<div[^>]*class="[^"]*{c}[^"]*"[^>]*>(.*?)</div>' for c in ("article-body", "article-content", "story-body", "post-content", "entry-content")] + [r'<div[^>]*itemprop="articleBody"[^>]*>(.*?)</div>', r'<div[^>]*class="(?:[^"]* )?content(?: [^"]*)?"[^>]*>(.*?)</div>', r"<main\b[^>]*>(.*?)</main>"]
DROPPED = reduce(lambda c, tag: f"regexp_replace({c}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')", rules.NOT_CONTENT, "html")


def sql_text(pattern: str) -> str:
    out = sql_plain(f"regexp_extract(h, {quoted('(?is)' + pattern)}, 1)")
    for p in rules.BOILERPLATE:
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    return f"trim({out})"


#: A paragraph ends where it is closed, or its article is, or the page.
PARAGRAPH = "regexp_extract(x, '(?is)^(.*?)(?:</p>|</article>|</main>|</div>|</body>|$)', 1)"
PAGE_TEXT = f"""with s as (select page_id, html, {DROPPED} as h from pages), t as (select page_id, html, h, [{', '.join(sql_text(p) for p in (r'<article\b[^>]*>(.*?)</article>', *CONTAINERS))}] as found from s),
p as (select page_id, html, list_filter(found, lambda x: length(x) >= 500)[1] as long, array_to_string(list_filter(list_transform(string_split_regex(h, '(?i)<p\\b[^>]*>')[2:], lambda x: {sql_plain(PARAGRAPH)}), lambda x: length(x) >= 50), ' ') as paragraphs from t),
texts as (select page_id, left(coalesce(long, nullif(paragraphs, ''), regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)), 5000) as body from p)"""


@query("p10_page_text", PAGE_TEXT + " select page_id, body from texts")
def _(spark, d):
    return pages.page_text(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select("page_id", "body")


NOISY = "title || '. Share this article with friends. Read more: here. ' || body_text || ' Advertisement. Sign up for news'"


def sql_clean(col: str) -> str:
    out = sql_plain(col)
    for p in rules.BOILERPLATE:
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    return f"trim({out})"


@query("p11_clean_text", f"select item_id, {sql_clean(NOISY)} as body from fx_items", ("fx_items",))
def _(spark, d, items):
    return items.select("item_id", without_boilerplate(without_tags(F.expr(NOISY))).alias("body"))


PLACES = {"article": r"(?is)<article\b[^>]*>(.*?)</article>", "p": r"(?is)<p\b[^>]*>(.*?)</p>", "title": r"(?is)<title\b[^>]*>(.*?)</title>"}
SUMMARY = "case when page_id % 3 = 0 then repeat('summary ', 60) else 'short summary' end"


@query("p12_preprint_text", f"""with f as (select page_id, {SUMMARY} as summary, list_filter([{', '.join(sql_plain(f'regexp_extract(html, {quoted(p)}, 1)') for p in PLACES.values())}], lambda x: x <> '') as found from pages)
select page_id, case when length(summary) >= 400 then summary else coalesce(list_filter(found, lambda x: length(x) >= 200)[1], found[-1], summary) end as body from f""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html", F.expr(SUMMARY).alias("summary"))
    return pages.preprint_text(rows, places=tuple(PLACES)).select("page_id", pages.collapsed(F.col("body")).alias("body"))


@query("p13_without_tags", f"select page_id, {sql_plain('html')} as plain from pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", without_tags(F.col("html")).alias("plain"))


P14 = PAGE_TEXT + """, i as (select doc_id, regexp_replace(lower(trim(coalesce(url, 'https://none.example/' || doc_id))), '/+$', '') as url_key, left(text, 300) as summary, case doc_id % 4 when 0 then 'paper' else 'news' end as content_type from documents left join pages on page_id = doc_id),
arrived as (select regexp_replace(lower(trim(url)), '/+$', '') as url_key, arg_min(case when page_id % 7 <> 0 then body end, page_id) filter (page_id % 7 <> 0) as body from texts join pages using (page_id) group by 1), j as (select doc_id, content_type, arrived.body is null as failed, coalesce(arrived.body, summary, '') as body from i left join arrived using (url_key)),
k as (select *, length(body) >= case content_type when 'paper' then 600 else 1200 end as enough from j)"""
OUTCOME = "case when failed then 'failed' when enough then 'success' else 'insufficient' end"


def fetched(spark, d):
    """Documents as items at the addresses of the pages of their ids, with the texts of the pages that came: all but a seventh."""
    landed_pages = spark.read.parquet(f"{d}/pages.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.left("text", F.lit(300)).alias("summary"), F.when(F.col("doc_id") % 4 == 0, "paper").otherwise("news").alias("content_type"))
    url = F.coalesce("url", F.concat(F.lit("https://none.example/"), "doc_id"))
    items = docs.join(landed_pages.select("page_id", "url"), F.col("doc_id") == F.col("page_id"), "left").withColumn("url", url).withColumn("url_key", url_key("url"))
    bodies = pages.page_text(landed_pages.where("page_id % 7 <> 0")).withColumn("url_key", url_key("url")).groupBy("url_key").agg(F.min_by("body", "page_id").alias("body"))
    return pages.body_or_summary(items, bodies)


@query("p14_body_fallback", P14 + f" select doc_id, body, {OUTCOME} as outcome from k")
def _(spark, d):
    return fetched(spark, d).select("doc_id", "body", "outcome")


@query("a11_outcomes", P14 + " select count_if(enough)::bigint as success, count_if(not enough)::bigint as insufficient, count_if(failed)::bigint as failed from k")
def _(spark, d):
    """Failed fetches count beside what their summaries come to."""
    f = fetched(spark, d)
    return f.agg(F.count_if("enough").alias("success"), F.count_if(~F.col("enough")).alias("insufficient"), F.count_if(F.col("outcome") == "failed").alias("failed"))

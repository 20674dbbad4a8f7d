"""Records from HTML: by patterns where a record is flat, by what encloses tags where it nests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.html import attribute, elements, has_class, inside, joined_text, links, tags


def absolute(link: Column, base: str | Column) -> Column:
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(base) if isinstance(base, str) else base, link))


def split_author(quote: Column) -> tuple[Column, Column]:
    """(quote, author) at the last ` - `."""
    return F.regexp_extract(quote, "(?s)^(.*) - (.*)$", 1), F.regexp_extract(quote, "(?s)^(.*) - (.*)$", 2)


def anchors(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, pos, href, label) of all anchors, tags inside labels left out."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    each = pages.select(*keys, F.posexplode(found).alias("pos", "a"))
    label = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", " "), r"\s+", " "))
    return each.select(*keys, "pos", F.regexp_extract("a", r"""(?i)href\s*=\s*["']([^"']*)["']""", 1).alias("href"), F.regexp_extract("a", r"""(?i)class\s*=\s*["']([^"']*)["']""", 1).alias("css"), label.alias("label"))


def find_links(links: DataFrame, pattern: str, amount: int = 5) -> DataFrame:
    """The first links by href whose href matches: amount is a report's length."""
    return links.where(F.col("href").rlike(pattern)).orderBy("href").limit(amount)


def quotes_by_author(links: DataFrame, *keys: str) -> DataFrame:
    """(keys, author, quote): quotes and authors joined on the number in their classes (qt_N, qa_N); of an author's
    quotes the last one stays."""
    quote = links.where(F.col("css").rlike(r"\bqt_[0-9]+")).select(*keys, F.regexp_extract("css", r"\bqt_([0-9]+)", 1).alias("n"), F.col("label").alias("quote"), "pos")
    author = links.where(F.col("css").rlike(r"\bqa_[0-9]+")).select(*keys, F.regexp_extract("css", r"\bqa_([0-9]+)", 1).alias("n"), F.col("label").alias("author"))
    return quote.join(author, [*keys, "n"]).groupBy(*keys, "author").agg(F.max_by("quote", "pos").alias("quote"))


def quotes_of_class(links: DataFrame, pattern: str) -> DataFrame:
    return links.where(F.col("css").rlike(pattern)).select("label")


def paragraphs(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, n, text, links) of the paragraphs of each page."""
    return elements(tags(pages, html, *keys), "p", *keys).drop("at")


def definitions(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, n, term, text, link): the descriptions of definition lists with the term before them and their first link."""
    rows = inside(inside(inside(tags(pages, html, *keys), "dl", *keys), "dt", *keys), "dd", *keys).where("in_dl is not null")
    before = Window.partitionBy(*keys, "in_dl").orderBy("pos")
    rows = rows.withColumn("term_at", F.last("in_dt", ignorenulls=True).over(before))
    terms = rows.where("in_dt is not null").groupBy(*keys, F.col("in_dt").alias("term_at")).agg(joined_text().alias("term"))
    texts = rows.where("in_dd is not null").groupBy(*keys, "term_at", F.col("in_dd").alias("at")).agg(joined_text().alias("text"), F.get(links(), 0).alias("link"))
    joined = texts.join(terms, [*keys, "term_at"], "left")
    return joined.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("n"), F.coalesce("term", F.lit("")).alias("term"), "text", "link")


def articles(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, n, title, year, topic, link, heading, paragraphs, text) of the article nodes of each page. Of anchors and spans by
    class: the year, the topic (or category), and the first other anchor's text and target; besides the first heading
    and the number of paragraphs."""
    rows = inside(inside(inside(tags(pages, html, *keys), "article", *keys), "a", *keys), "h1", *keys).where("in_article is not null")
    # an element with a class names what is within it
    opens = (~F.col("ends")) & F.col("tag").isin("a", "span", "p", "div", "time")
    kind = F.when(opens & has_class("year"), "year").when(opens & (F.col("tag") == "a") & (has_class("topic") | has_class("category")), "topic").when(opens & (F.col("tag") == "a"), "title").when(F.col("ends") & F.col("tag").isin("a", "span", "p", "div", "time"), "")
    within = Window.partitionBy(*keys, "in_article").orderBy("pos")
    rows = rows.withColumn("field", F.last(kind, ignorenulls=True).over(within)).withColumn("heading_at", F.min("in_h1").over(Window.partitionBy(*keys, "in_article")))
    opening = opens & (F.col("tag") == "a") & (F.col("field") == "title")
    link = F.min(F.when(opening, F.struct("pos", attribute("href").alias("href"))))["href"]
    grouped = rows.groupBy(*keys, F.col("in_article").alias("at")).agg(
        *[joined_text(F.col("field") == f).alias(f) for f in ("title", "year", "topic")],
        link.alias("link"),
        joined_text(F.col("in_h1") == F.col("heading_at")).alias("heading"),
        F.count_if((F.col("tag") == "p") & ~F.col("ends")).alias("paragraphs"),
        joined_text().alias("text"),
    )
    return grouped.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("n"), "title", "year", "topic", "link", "heading", "paragraphs", "text")


def features(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, title, citation, body) of each page with a tag: first heading, a map of terms to text and link, and the paragraphs with
    their links. Of equal terms the last one stays."""
    tagged = tags(pages, html, *keys)
    headings = elements(tagged, "h1", *keys).where("n = 1").select(*keys, F.col("text").alias("title"))
    last = Window.partitionBy(*keys, "term").orderBy(F.col("n").desc())
    cited = definitions(pages, html, *keys).withColumn("nth", F.row_number().over(last)).where("nth = 1")
    citation = cited.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", F.struct("text", "link"))))).alias("citation"))
    body = elements(tagged, "p", *keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text", "links"))), lambda p: F.struct(p["text"].alias("text"), p["links"].alias("links"))).alias("body"))
    return tagged.select(*keys).distinct().join(headings, list(keys), "left").join(citation, list(keys), "left").join(body, list(keys), "left")


def features_of_first_articles(pages: DataFrame, url: str = "url", html: str = "html", base: str = "") -> DataFrame:
    """(url, link, title, citation, body): each page's first article, its link followed to another page of the table."""
    first = articles(pages, html, url).where("n = 1 and link is not null").select(url, absolute(F.col("link"), base).alias("link"))
    return first.join(features(pages, html, url).withColumnRenamed(url, "link"), "link").select(url, "link", "title", "citation", "body")

"""HTML as a stream of tags: what encloses a tag, and the text of elements, by running sums and windows within a page.

`tags` cuts pages into rows, a tag and the text behind it each. `inside` tells for each row in which element of a name it
lies: elements that may nest by their depth, those whose end tag may be missing (paragraphs, list items, terms) by the tags
that end them. `texts` puts the text of elements together. Windows and groups never reach beyond a page; keys must tell
pages apart.

Defined cases: a page that is null has no rows; comments, scripts and styles are left out, also where a page ends within one;
end tags without a start are ignored, elements without an end go to the end of the page; what looks like a tag but doesn't
start with a letter is text; quotes in attributes may hold `>`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = r"""</?[A-Za-z][A-Za-z0-9]*(?:[^>"']|"[^"]*"|'[^']*')*+>"""
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
# What ends a paragraph, a list item, a term or a description besides its own tag; and named characters.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "main", "nav", "ol", "pre", "section", "table", "ul")
ENDED_BY = {"p": ("p", *BLOCKS), "dt": ("dt", "dd", "dl"), "dd": ("dt", "dd", "dl"), "li": ("li", "ol", "ul"), "option": ("option", "select")}
CHARACTERS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    """Named characters replaced, the ampersand last."""
    for name, character in CHARACTERS.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def tags(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, pos, tag, ends, attributes, text): the tags of each page in order, lower-cased, whether they are end tags, and the
    text behind each one."""
    seen = F.regexp_replace(F.col(html), UNSEEN, "")
    found = F.arrays_zip(F.regexp_extract_all(seen, F.lit(TAG), F.lit(0)).alias("raw"), F.slice(F.split(seen, TAG, -1), 2, 1 << 30).alias("text"))
    each = pages.where(F.col(html).isNotNull()).select(*keys, F.posexplode(found).alias("pos", "t"))
    part = lambda i: F.regexp_extract("t.raw", r"(?s)^<(/?)([A-Za-z][A-Za-z0-9]*)(.*)>$", i)
    return each.select(*keys, "pos", F.lower(part(2)).alias("tag"), (part(1) == "/").alias("ends"), part(3).alias("attributes"), F.coalesce(unescaped(F.col("t.text")), F.lit("")).alias("text"))


def attribute(name: str, of: str = "attributes") -> Column:
    """The value of an attribute, null if it isn't there."""
    value = lambda i: F.regexp_extract(of, rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i)
    there = F.col(of).rlike(rf"(?i)(?:^|\s){name}\s*=")
    return F.when(there, unescaped(F.concat(value(1), value(2), value(3))))


def has_class(part: str) -> Column:
    """Whether a class of the tag has the text in it."""
    return F.coalesce(attribute("class").contains(part), F.lit(False))


def inside(tagged: DataFrame, name: str, *keys: str) -> DataFrame:
    """tagged with a column `in_<name>`: the pos of the innermost element of that name a row lies in, null outside."""
    page = Window.partitionBy(*keys).orderBy("pos")
    mine = F.col("tag") == name
    if name in ENDED_BY:
        event = F.when(mine & ~F.col("ends"), F.col("pos")).when(F.col("tag").isin(*ENDED_BY[name]), -1)
        last = F.last(event, ignorenulls=True).over(page)
        return tagged.withColumn(f"in_{name}", F.when(last >= 0, last))
    step = F.when(mine, F.when(F.col("ends"), -1).otherwise(1)).otherwise(0)
    # end tags without a start would lead below 0: the depth is that above the least depth so far
    rows = tagged.withColumn("tsl_depth", F.sum(step).over(page))
    rows = rows.withColumn("tsl_depth", F.col("tsl_depth") - F.least(F.lit(0), F.min("tsl_depth").over(page)))
    # of the starts at a depth the last one is that of what lies at this depth now
    start = F.last(F.when(mine & ~F.col("ends"), F.col("pos")), ignorenulls=True).over(Window.partitionBy(*keys, "tsl_depth").orderBy("pos"))
    return rows.withColumn(f"in_{name}", F.when(F.col("tsl_depth") > 0, start)).drop("tsl_depth")


def joined_text(when: Column | None = None) -> Column:
    """An aggregate: the texts of rows in order, put together and trimmed."""
    part = F.struct("pos", "text")
    return F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(part if when is None else F.when(when, part))), lambda x: x["text"]), ""))


def links(when: Column | None = None) -> Column:
    """An aggregate: the targets of anchors in order."""
    href = attribute("href")
    anchor = (F.col("tag") == "a") & ~F.col("ends") & href.isNotNull()
    return F.transform(F.sort_array(F.collect_list(F.when(anchor if when is None else anchor & when, F.struct("pos", href.alias("href"))))), lambda x: x["href"])


def elements(tagged: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, n, at, text, links) of the elements of a name, numbered in a page; of nested ones a text is the innermost's."""
    rows = inside(tagged, name, *keys).where(F.col(f"in_{name}").isNotNull())
    grouped = rows.groupBy(*keys, F.col(f"in_{name}").alias("at")).agg(joined_text().alias("text"), links().alias("links"))
    return grouped.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("n"), "at", "text", "links")

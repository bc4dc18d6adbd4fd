"""See-also links of wiki pages (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import extract_links, has_see_also, page_tag, see_also_section, tail_mentions_see_also, tail_of


def page_links(wiki: DataFrame, mode: str = "section", normalise_links: bool = False,
               tail_chars: int | None = None) -> DataFrame:
    """Per page: (tag, links) or nothing.

    Pages without a tag/title or body are skipped. When the see-also marker is present the links
    of its section are taken (mode 'parity' = the original pattern's match, 'section' = the lines
    after the marker); otherwise, when the tail (the last tail_chars characters, or the whole body)
    mentions "see" or "also", all links of that tail. A page whose section has no link yields an empty list (an entry without links).
    """
    tag = page_tag("tag", "title")
    body = F.col("body")
    links = (F.when(has_see_also(body), extract_links(see_also_section(body, mode)))
              .when(tail_mentions_see_also(body, tail_chars), extract_links(tail_of(body, tail_chars))))
    if normalise_links:
        links = F.transform(links, lambda s: F.lower(F.replace(F.split_part(s, F.lit("|"), F.lit(1)),
                                                               F.lit("_"), F.lit(" "))))
    return (wiki.filter(body.isNotNull())
                .select(tag.alias("tag"), links.alias("links"))
                .filter(F.col("tag").isNotNull() & F.col("links").isNotNull()))


def see_also_links(wiki: DataFrame, mode: str = "section", normalise_links: bool = False,
                   tail_chars: int | None = None) -> DataFrame:
    """(tag, link) -- the set of links per tag (several pages of one tag are united);
    a tag with an entry but no link at all gets one row with link = null. One pass over the pages."""
    rows = page_links(wiki, mode, normalise_links, tail_chars).select("tag", F.explode_outer("links").alias("link")).distinct()
    linked = F.count("link").over(Window.partitionBy("tag"))
    return rows.withColumn("_n", linked).where(F.col("link").isNotNull() | (F.col("_n") == 0)).drop("_n")

"""Adapters that derive the reference's data model from the given test tables.

Every adapter is a pure DataFrame plan over the parquet tables, so its work grows with them:
no global ordering, no driver round trip, joins on uniform keys only.

posts            one row per order that has lines (orders x lineitem x part x supplier)
wiki             one page per distinct part name, linking to neighbouring part keys
hierarchy_items  a tag hierarchy derived from part (type / brand / name)
pages            the raw `pages` table (html per url)
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Posts columns kept by the samplers (F2); the rest of the model is derived per query.
POST_COLUMNS = ["id", "created_at", "score", "rating", "is_deleted", "is_banned",
                "general", "character", "copyright", "artist", "meta"]
TAG_TYPES = ["general", "character", "copyright", "artist", "meta"]


def posts(spark: SparkSession, sf_dir: str, tag_columns: Iterable[str] = TAG_TYPES) -> DataFrame:
    """Posts with comma-joined tag lists.

    id = o_orderkey; created_at = o_orderdate + (id % 24) h as ISO-8601 with ms and offset;
    score = floor(o_totalprice / 1000) - 10; rating from the first digit of o_orderpriority
    (1 g, 2 s, 3 q, else e); is_deleted = id % 10 = 0; is_banned = id % 83 = 0;
    tag lists ordered by (l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus);
    meta is null when id % 70 = 0.

    Plan: lineitem joins part and supplier on their keys (sizes left to AQE's checked
    broadcast threshold), one aggregation on l_orderkey collects the <= 7 lines of an order,
    and the join with orders reuses that hash partitioning.

    tag_columns: the tag lists to build. Only what they need is read, joined and shuffled; without any
    an order needs a line, no more (a semi join).
    """
    wanted = [t for t in TAG_TYPES if t in set(tag_columns)]
    field = {"general": "p_name", "character": "p_brand", "copyright": "p_type", "artist": "s_name"}
    of_part = [field[t] for t in wanted if t in field and t != "artist"]
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    if wanted:
        lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", *order])
        if of_part:
            part = read_table(spark, sf_dir, "part", ["p_partkey", *of_part])
            lines = lines.join(part, lines.l_partkey == part.p_partkey)
        if "artist" in wanted:
            supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
            lines = lines.join(supp, lines.l_suppkey == supp.s_suppkey)
        lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
            *order, *of_part, *(["s_name"] if "artist" in wanted else [])))).alias("ls"))
        j = orders.join(lists, orders.o_orderkey == lists.l_orderkey)
    else:
        lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey"])
        j = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi")

    def tags(name: str) -> Column:
        if name == "meta":
            pairs = F.transform("ls", lambda x: F.concat(x["l_returnflag"], F.lit(" "), x["l_linestatus"]))
            return F.when((F.col("o_orderkey") % 70) == 0, F.lit(None).cast("string")).otherwise(F.array_join(pairs, ","))
        return F.array_join(F.transform("ls", lambda x: x[field[name]]), ",")

    created = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    prio = F.substring("o_orderpriority", 1, 1)
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")).alias("created_at"),
        (F.floor(F.col("o_totalprice") / 1000) - 10).cast("bigint").alias("score"),
        F.when(prio == "1", "g").when(prio == "2", "s").when(prio == "3", "q").otherwise("e").alias("rating"),
        ((F.col("o_orderkey") % 10) == 0).alias("is_deleted"),
        ((F.col("o_orderkey") % 83) == 0).alias("is_banned"),
        *[tags(t).alias(t) for t in wanted])


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages, one per distinct part name (id = smallest part key of that name).

    next / prev = the name of part key id + 1 / id - 1 (the page's own name if absent).
    Body by id % 5:
      0, 1: "Intro [[prev]].\\nh4. See also\\n* [[next]]\\nh4. Notes\\n[[prev]]"
      2:    "Related to [[next]], see also [[prev]]"
      3:    "Nothing here. [[next]]"
      4:    "Intro [[prev]]\\nSee Also\\n[[next|alias]]"
    tag is null when id % 9 = 0 (the title then names the page).
    """
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    nxt = part.select(F.col("p_partkey").alias("nk"), F.col("p_name").alias("next_name"))
    prv = part.select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("prev_name"))
    w = (names.join(nxt, names.id + 1 == nxt.nk, "left")
              .join(prv, names.id - 1 == prv.pk, "left"))
    nx = F.coalesce("next_name", "p_name")
    pv = F.coalesce("prev_name", "p_name")
    k = F.col("id") % 5
    body = (F.when(k <= 1, F.concat(F.lit("Intro [["), pv, F.lit("]].\nh4. See also\n* [["), nx,
                                    F.lit("]]\nh4. Notes\n[["), pv, F.lit("]]")))
             .when(k == 2, F.concat(F.lit("Related to [["), nx, F.lit("]], see also [["), pv, F.lit("]]")))
             .when(k == 3, F.concat(F.lit("Nothing here. [["), nx, F.lit("]]")))
             .otherwise(F.concat(F.lit("Intro [["), pv, F.lit("]]\nSee Also\n[["), nx, F.lit("|alias]]"))))
    return w.select(
        F.col("id"),
        F.col("p_name").alias("title"),
        F.when((F.col("id") % 9) == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("tag"),
        body.alias("body"),
    )


def hierarchy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hierarchy items (name, href, path, has_link, has_nested, seq) derived from part.

    Rows (distinct):
      per p_type in ECONOMY/SMALL/LARGE: "Tag group:<type> tags", path [Catalogue, Groups, name]
      per other p_type:                  "Tag group:<type>", path [name]
      per p_type:                        "<type>", path [<type>], no link
      per (type, brand):                 "<brand>", group path + [brand]
      per (type, brand, name):           p_name (first letter upper-cased for even brand numbers),
                                         group path + [brand, name], leaf
      per p_type:                        "See also <type>", group path + [name], leaf
      per p_brand:                       "<brand>", path [Index, brand], leaf
    seq = path joined by "/" + "#" + row kind: unique and sortable, no global numbering.
    """
    part = read_table(spark, sf_dir, "part", ["p_type", "p_brand", "p_name"])
    types = part.select("p_type").distinct()
    big = F.col("p_type").isin("ECONOMY", "SMALL", "LARGE")
    gname = F.when(big, F.concat(F.lit("Tag group:"), "p_type", F.lit(" tags"))).otherwise(
        F.concat(F.lit("Tag group:"), "p_type"))
    gpath = F.when(big, F.array(F.lit("Catalogue"), F.lit("Groups"), gname)).otherwise(F.array(gname))
    tg = types.select("p_type", gname.alias("gname"), gpath.alias("gpath"))

    def row(kind: int, name: Column, path: Column, link: bool, nested: bool) -> list[Column]:
        return [name.alias("name"),
                (F.concat(F.lit("/wiki_pages/"), name) if link else F.lit(None).cast("string")).alias("href"),
                path.alias("path"), F.lit(link).alias("has_link"), F.lit(nested).alias("has_nested"),
                F.lit(kind).alias("kind")]

    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    leaf_name = F.when(brand_no % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))) \
                 .otherwise(F.col("p_name"))
    tb = part.select("p_type", "p_brand").distinct().join(tg, "p_type")
    tbn = part.select("p_type", "p_brand", "p_name").distinct().join(tg, "p_type")
    parts = [
        tg.select(*row(1, F.col("gname"), F.col("gpath"), True, True)),
        types.select(*row(2, F.col("p_type"), F.array("p_type"), False, True)),
        tb.select(*row(3, F.col("p_brand"), F.concat("gpath", F.array("p_brand")), True, True)),
        tbn.select(*row(4, leaf_name, F.concat("gpath", F.array("p_brand", leaf_name)), True, False)),
        tg.select(*row(5, F.concat(F.lit("See also "), "p_type"),
                       F.concat("gpath", F.array(F.concat(F.lit("See also "), "p_type"))), True, False)),
        part.select("p_brand").distinct().select(*row(6, F.col("p_brand"), F.array(F.lit("Index"), "p_brand"), True, False)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("seq", F.concat(F.array_join("path", "/"), F.lit("#"), F.col("kind").cast("string"))).drop("kind")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])


PARTS_PER_PAGE = 100


def catalogue_pages(spark: SparkSession, sf_dir: str, per_page: int = PARTS_PER_PAGE) -> DataFrame:
    """A page for each run of per_page part keys, so that pages grow in number with part and none in size.

    page_id = p_partkey div per_page; h2 "Parts <page_id>" and a list of the parts by key: "<name> #<key>", linked, each with
    a list of its brand and its type inside; last a link to the next page, "List of parts <page_id + 1>"."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    page = F.floor(F.col("p_partkey") / per_page).cast("long")
    entry = F.concat(F.lit('<li><a href="/parts/'), F.col("p_partkey").cast("string"), F.lit('">'), F.col("p_name"), F.lit(" #"),
                     F.col("p_partkey").cast("string"), F.lit("</a><ul><li>"), F.col("p_brand"), F.lit("</li><li>"), F.col("p_type"),
                     F.lit("</li></ul></li>"))
    lists = part.groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("es"))
    after = (F.col("page_id") + 1).cast("string")
    return lists.select("page_id", F.concat(F.lit("parts/"), F.col("page_id").cast("string")).alias("url"), F.concat(
        F.lit("<h2>Parts "), F.col("page_id").cast("string"), F.lit("</h2><ul>"), F.array_join(F.transform("es", lambda x: x["e"]), ""),
        F.lit('<li><a href="/wiki_pages/parts'), after, F.lit('">List of parts '), after, F.lit("</a></li></ul>")).alias("html"))


def linked_pages(spark: SparkSession, sf_dir: str, host: str = "https://wiki.example.org") -> DataFrame:
    """A small site derived from part: an index page that links to one page for each type.

    index (page_id 0, url "index"): h2 Types and a list of links "Tag group:<type>", each followed by
    a list that names the type's first brand; h3 See also and a list (an excluded section).
    type pages (page_id 1.., url <host>/posts?tags=<type>): a nav list (noise), h2 <type>, h4 Brands and
    a list of linked brands, each with the list of its part names inside; the last item of the page is a
    link to the next type's page, "List of <next type>".
    """
    part = read_table(spark, sf_dir, "part", ["p_type", "p_brand", "p_name"]).distinct()

    def link(href: Column, text: Column) -> Column:
        return F.concat(F.lit('<li><a href="'), href, F.lit('">'), text, F.lit("</a>"))

    names = part.groupBy("p_type", "p_brand").agg(F.array_join(F.transform(
        F.array_sort(F.collect_set("p_name")), lambda x: F.concat(link(F.concat(F.lit("/parts/"), x), x), F.lit("</li>"))), "").alias("names"))
    brands = names.groupBy("p_type").agg(
        F.array_sort(F.collect_list(F.struct("p_brand", "names"))).alias("brands"), F.min("p_brand").alias("first_brand"))
    types = brands.agg(F.array_sort(F.collect_list("p_type")).alias("types"))  # a row for each type of the catalogue
    body = F.array_join(F.transform("brands", lambda b: F.concat(
        link(F.concat(F.lit("/brands/"), b["p_brand"]), b["p_brand"]), F.lit("<ul>"), b["names"], F.lit("</ul></li>"))), "")
    at = F.array_position("types", F.col("p_type"))
    following = F.get(F.col("types"), F.when(at == F.size("types"), F.lit(0)).otherwise(at).cast("int"))
    pages_of = brands.withColumn("types", types.scalar()).select(
        at.cast("long").alias("page_id"), F.concat(F.lit(host + "/posts?tags="), "p_type").alias("url"),
        F.concat(F.lit('<nav><ul><li><a href="/home">Home</a></li></ul></nav><h2>'), "p_type", F.lit("</h2><h4>Brands</h4><ul>"), body,
                 link(F.concat(F.lit("/wiki_pages/"), following), F.concat(F.lit("List of "), following)), F.lit("</li></ul>")).alias("html"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "first_brand"))), lambda t: F.concat(
        link(F.concat(F.lit("/wiki_pages/"), t["p_type"]), F.concat(F.lit("Tag group:"), t["p_type"])), F.lit("</li><ul><li>first "),
        t["first_brand"], F.lit("</li></ul>"))), "")
    index = brands.agg(F.concat(F.lit("<h2>Types</h2><ul>"), entries, F.lit(
        '</ul><h3>See also</h3><ul><li><a href="/wiki_pages/nowhere">List of nothing</a></li></ul>')).alias("html")).select(
        F.lit(0).cast("long").alias("page_id"), F.lit("index").alias("url"), "html")
    return index.unionByName(pages_of)

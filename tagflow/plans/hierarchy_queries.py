"""Registered hierarchy queries: the part-derived hierarchy (tabular H7-H16, D1-D3, D11) and
the raw pages table (H1-H6 walk, cross-page H8/H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hierarchy as HX
from ..operators import hierarchy as H
from ..session import materialize
from ..sources import adapters

PATH_TERM = "economy"
SELECT_CFG = H.default_config(skip_first_n=1, group_name_patterns=["tag group:*"])
PAGES_CFG = H.default_config(noise=())   # the given pages hold their only list in a nav
SITE_CFG = H.default_config(skip_first_n=1, max_groups=3)


def classified(spark, d):
    return H.classify_items(adapters.hierarchy_items(spark, d))


def resolved(spark, d):
    return H.resolve_duplicates(classified(spark, d))


def normalised(spark, d):
    return H.normalise(resolved(spark, d))


def consolidated(spark, d):
    """Consolidation joins the normalised table with itself several times; the table (one row per
    distinct name) is written once to the shared checkpoint folder instead of being recomputed,
    and so is the result that the path queries read twice."""
    return materialize(H.consolidate(materialize(normalised(spark, d), "hier-norm")), "hier-cons")


def pj(c="path", sep="/"):
    return F.array_join(c, sep)


def q_hierarchy_classify(spark, d):
    c = classified(spark, d)
    return c.select("name", "seq", "classification", "priority", "parent", "depth", "should_follow", "url",
                    HX.rewrite_url("url").alias("full_url"))


def q_hierarchy_resolved(spark, d):
    return resolved(spark, d).select("name", "seq", "first_seq", "classification", pj().alias("path"), "raw_rows")


def q_hierarchy_normalised(spark, d):
    return normalised(spark, d).select("name", pj().alias("path"), "parent", "depth", "classification",
                                       "should_follow", "url", "first_seq", "first_raw_name", "members")


def q_hierarchy_removed_duplicates(spark, d):
    r = resolved(spark, d)
    return H.removed_duplicates(r, H.normalise(r))


def q_hierarchy_normalisation_log(spark, d):
    return H.normalisation_log(normalised(spark, d))


def q_hierarchy_consolidated(spark, d):
    return consolidated(spark, d).select("name", pj().alias("path"), "classification", "consolidated")


def q_hierarchy_consolidation_log(spark, d):
    return H.consolidation_log(normalised(spark, d))


def q_hierarchy_flat(spark, d):
    return H.flatten(consolidated(spark, d))


def q_group_members(spark, d):
    return H.group_members(consolidated(spark, d))


def q_ancestors(spark, d):
    return H.ancestors(consolidated(spark, d))


def q_items_under_path_count(spark, d):
    return H.items_under_path(consolidated(spark, d), PATH_TERM)[0]


def q_items_under_path_list(spark, d):
    return H.items_under_path(consolidated(spark, d), PATH_TERM)[1]


def q_select_groups(spark, d):
    return H.select_groups(resolved(spark, d), SELECT_CFG).select("idx", "name", "full_url", "skip_reason")


def q_depth_histogram(spark, d):
    """D1."""
    return consolidated(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("items"))


def q_hierarchy_audit(spark, d):
    """Items without parent, and parents that are not items themselves."""
    c = consolidated(spark, d)
    orphans = (c.filter(F.col("parent").isNotNull()).select("parent").distinct()
                .join(c.select(F.col("name").alias("parent")), "parent", "left_anti"))
    return c.agg(F.sum(F.col("parent").isNull().cast("int")).cast("bigint").alias("root_items")) \
            .withColumn("dangling_parents", orphans.select(F.count(F.lit(1))).scalar())


def q_children_by_depth(spark, d):
    """D3: number of children of each parent, by depth."""
    return H.group_members(consolidated(spark, d)).groupBy("depth", "parent").agg(F.count(F.lit(1)).alias("children"))


def q_class_shares(spark, d):
    """Items per classification and their share."""
    c = consolidated(spark, d)
    total = c.select(F.count(F.lit(1))).scalar()
    return c.groupBy("classification").agg(F.count(F.lit(1)).alias("items")) \
            .withColumn("share", F.round(F.col("items") / total, 9))


# ------------------------------------------------------------------ raw pages
def page_nodes(spark, d):
    return H.page_nodes(adapters.pages(spark, d), PAGES_CFG)


def q_page_items(spark, d):
    items = H.classify_items(H.page_items(page_nodes(spark, d)))
    return items.select("page_id", F.col("seq.pos").alias("pos"), "name", "href", "depth", "classification")


def q_page_hierarchy(spark, d):
    r = H.resolve_duplicates(H.classify_items(H.page_items(page_nodes(spark, d))))
    return r.select("name", F.col("first_seq.page").alias("first_page"), F.col("first_seq.pos").alias("first_pos"),
                    "classification", "raw_rows")


def q_page_normalised(spark, d):
    n = H.normalise(H.resolve_duplicates(H.classify_items(H.page_items(page_nodes(spark, d)))))
    return n.select("name", "first_raw_name", "members", F.col("first_seq.page").alias("first_page"))


# ------------------------------------------------------------------ pages with nested lists, links between pages
def site(spark, d):
    return materialize(adapters.linked_pages(spark, d), "site")


def q_nested_items(spark, d):
    """H2-H6: items of the nested pages, noise removed."""
    items = H.classify_items(H.page_items(H.page_nodes(site(spark, d))))
    return items.select("page_id", F.col("seq.pos").alias("pos"), "name", pj().alias("path"), "has_nested", "depth", "classification")


def q_catalogue_items(spark, d):
    """Items of pages whose number grows with part."""
    items = H.page_items(H.page_nodes(materialize(adapters.catalogue_pages(spark, d), "catalogue")))
    return items.select("page_id", F.col("seq.pos").cast("bigint").alias("pos"), "name", pj().alias("path"), "has_link", "has_nested")


def q_nested_items_with_noise(spark, d):
    """H1: the same with the nav lists kept."""
    items = H.page_items(H.page_nodes(site(spark, d), H.default_config(noise=())))
    return items.select("page_id", F.col("seq.pos").alias("pos"), "name", pj().alias("path"))


def q_page_headings(spark, d):
    """H3: headings, and those that an excluded section drops."""
    nodes = H.page_nodes(site(spark, d))
    return nodes.filter(F.col("kind").isin("heading", "excluded")).select("page_id", "kind", "pos", "name", "level")


def expansion(spark, d, cfg=SITE_CFG, hops=1):
    pages = site(spark, d)
    start = H.page_nodes(pages.filter(F.col("url") == "index"), cfg)
    return start, *H.expand_links(start, pages, cfg, hops, "index")


def q_followed_pages(spark, d):
    """The pages of one hop: the first is skipped, then three."""
    _, _, followed = expansion(spark, d)
    return followed.select("hop", "full_url", "group", pj("base_path").alias("base_path"))


def q_followed_pages_two_hops(spark, d):
    """In two hops every page once."""
    _, _, followed = expansion(spark, d, H.default_config(), 2)
    return followed.select("hop", "full_url", "group")


def q_expanded_items(spark, d):
    """The items of the start page and the pages followed, one for each name."""
    _, items, _ = expansion(spark, d)
    return H.resolve_duplicates(items).select("name", pj().alias("path"), "classification", F.col("seq.hop").alias("hop"), "raw_rows")


def q_run_statistics(spark, d):
    """A16 over the start page and the pages followed."""
    start, items, _ = expansion(spark, d)
    raw = materialize(H.resolve_duplicates(items), "resolved")
    norm = H.normalise(raw)
    log = H.normalisation_log(norm)
    return H.run_statistics(items, raw, start, log, H.removed_duplicates(raw, norm)).select(
        "total_items", "total_followable_items", "excluded_sections", "ignored_elements", "raw_rows")


def q_text_logs(spark, d):
    """Headings and elements of the site whose text lower-casing changes."""
    nodes = H.page_nodes(site(spark, d))
    return H.text_log(nodes.filter(F.col("kind") == "heading"), "heading").groupBy("source", "original", "normalized").agg(
        F.count(F.lit(1)).alias("rows"))


def q_glob_match(spark, d):
    """patterns match whole names (an inner "tag group:" is no match)."""
    x = classified(spark, d).select("name").unionByName(
        classified(spark, d).select(F.concat(F.lit("my "), "name").alias("name")))
    return x.filter(HX.glob_match_any("name", ["tag group:*s", "brand#?[13]"])).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

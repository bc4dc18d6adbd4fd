"""Tag hierarchy as DataFrame work.

Items are rows (run_id, name, href, path, has_link, has_nested, seq); `seq` is any orderable
value giving arrival order (page order, then position). Conflict rules are aggregations of
min(struct(...)) per name -- partial aggregation combines a hot name map-side, so a name that
holds a third of all rows never reaches one task as raw rows, and no global numbering is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hierarchy as HX
from ..session import materialize
from .common import numbered
from .page_walk import text_item_allowed, walk


def default_config(**overrides) -> dict:
    """max_depth None: lists of any depth; noise None: the fixed selectors, (): none."""
    cfg = dict(exclude_sections=list(HX.DEFAULT_EXCLUDE_SECTIONS), ignore_elements=list(HX.DEFAULT_IGNORE_ELEMENTS),
               target_groups=None, group_name_patterns=None, skip_first_n=0, max_groups=None, max_depth=None,
               sibling="any", exclude="items", noise=None)
    cfg.update(overrides)
    return cfg


# ------------------------------------------------------------------ H1-H6: page walk
def page_nodes(pages: DataFrame, cfg: dict | None = None, base_path_col: str | None = None) -> DataFrame:
    """One row per heading, ignored element and item of every page (see page_walk.walk).

    Input columns: page_id (any type), html (+ base_path array when base_path_col is given).
    """
    base = F.col(base_path_col) if base_path_col else F.array()
    return walk(pages.select("page_id", base.cast("array<string>").alias("base_path"), "html"), cfg or default_config())


def page_items(nodes: DataFrame) -> DataFrame:
    """Item rows of the walk with seq = (page order, position)."""
    return (nodes.filter(F.col("kind") == "item")
                 .select("page_id", "name", "href", "path", "has_link", "has_nested",
                         F.struct(F.col("page_id").alias("page"), F.col("pos")).alias("seq")))


# ------------------------------------------------------------------ H7, X13-X16
def classify_items(items: DataFrame) -> DataFrame:
    """Add classification, priority, parent, depth, should_follow and url (href of followable
    links only; the raw href stays in `href`)."""
    follow = F.col("has_link") & HX.should_follow("name")
    return (items.withColumn("classification", HX.classify("name", "has_link", "has_nested"))
                 .withColumn("priority", HX.priority("classification"))
                 .withColumn("parent", HX.parent_of("path"))
                 .withColumn("depth", HX.depth_of("path"))
                 .withColumn("should_follow", follow)
                 .withColumn("url", F.when(follow, F.col("href"))))


ITEM_FIELDS = ("name", "url", "href", "path", "parent", "depth", "has_nested", "classification",
               "priority", "should_follow")


def _best(order_first: list, fields=ITEM_FIELDS):
    return F.min(F.struct(*order_first, *[F.col(f) for f in fields]))


# ------------------------------------------------------------------ H8: raw-name conflicts
def resolve_duplicates(classified: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One item per raw name. Higher priority wins; equal priority -> strictly shorter
    path; otherwise the earlier arrival. first_seq = earliest arrival of the name (its dict slot)."""
    agg = classified.groupBy(*keys, "name").agg(
        _best([(-F.col("priority")).alias("np"), F.col("depth").alias("d"), F.col("seq").alias("s")]).alias("b"),
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("raw_rows"))
    return agg.select(*keys, *[F.col("b." + f).alias(f) for f in ITEM_FIELDS], F.col("b.s").alias("seq"),
                      "first_seq", "raw_rows")


# ------------------------------------------------------------------ H9/H10: case folding
def normalise(resolved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """H9: lower-case names, paths and parents; one item per lower-cased name by the same rule,
    arrival order = first_seq of the raw names."""
    low = resolved.withColumn("lname", F.lower("name"))
    agg = low.groupBy(*keys, "lname").agg(
        _best([(-F.col("priority")).alias("np"), F.col("depth").alias("d"), F.col("first_seq").alias("fs")]).alias("b"),
        F.min(F.struct(F.col("first_seq").alias("fs"), F.col("name").alias("n"))).alias("first"),
        F.count(F.lit(1)).alias("members"))
    return agg.select(
        *keys, F.col("lname").alias("name"), F.col("b.url").alias("url"), F.col("b.href").alias("href"),
        HX.lower_path("b.path").alias("path"), F.lower("b.parent").alias("parent"), F.col("b.depth").alias("depth"),
        F.col("b.has_nested").alias("has_nested"), F.col("b.classification").alias("classification"),
        F.col("b.priority").alias("priority"), F.col("b.should_follow").alias("should_follow"),
        F.col("first.fs").alias("first_seq"), F.col("first.n").alias("first_raw_name"),
        F.col("b.name").alias("kept_raw_name"), "members")


def removed_duplicates(resolved: DataFrame, normalised: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per folded-away raw item (kept = the final winner, discarded = the true loser)."""
    low = resolved.withColumn("lname", F.lower("name"))
    kept = normalised.select(*keys, F.col("name").alias("lname"), "kept_raw_name",
                             F.col("classification").alias("kept_classification"),
                             HX.join_path("path").alias("kept_path"))
    j = low.join(kept, [*keys, "lname"])
    return j.filter(F.col("name") != F.col("kept_raw_name")).select(
        *keys, F.col("lname").alias("duplicate"), "kept_classification", "kept_path",
        F.col("classification").alias("discarded_classification"),
        HX.join_path(HX.lower_path("path")).alias("discarded_path"))


def normalisation_log(normalised: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Item names changed by lower-casing (logged for the first arrival of each folded name)."""
    return normalised.filter(F.col("first_raw_name") != F.col("name")).select(
        *keys, F.lit("lowercase").alias("action"), F.col("first_raw_name").alias("original"),
        F.col("name").alias("normalized"))


def text_log(texts: DataFrame, source: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Headings / ignored elements whose text changes when lower-cased (one row per occurrence)."""
    return texts.filter(F.lower("name") != F.col("name")).select(
        *keys, F.lit("lowercase").alias("action"), F.col("name").alias("original"),
        F.lower("name").alias("normalized"), F.lit(source).alias("source"))


# ------------------------------------------------------------------ H11: consolidation
def consolidate(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """H11/J15: "tag group:X" against an existing X (or X minus " tags", tried in that order).
    base path >= group path -> drop the group; else the group's row replaces the base under the
    base name (both originals removed). Several groups on one base: the last (by arrival) wins."""
    g = items.filter(F.col("name").startswith(HX.GROUP_PREFIX))
    opt1, opt2 = HX.group_base_names("name")
    g = g.select(*keys, F.col("name").alias("gname"), opt1.alias("opt1"), opt2.alias("opt2"),
                 F.col("depth").alias("gdepth"), F.col("first_seq").alias("gseq"),
                 *[F.col(c).alias("g_" + c) for c in ("url", "href", "path", "parent", "depth", "has_nested",
                                                     "classification", "priority", "should_follow")])
    names = items.select(*keys, F.col("name").alias("bname"), F.col("depth").alias("bdepth"))
    b1 = names.select(*keys, F.col("bname").alias("opt1"), F.col("bdepth").alias("d1"))
    b2 = names.select(*keys, F.col("bname").alias("opt2"), F.col("bdepth").alias("d2"))
    m = g.join(b1, [*keys, "opt1"], "left").join(b2, [*keys, "opt2"], "left")
    m = (m.withColumn("base", F.when(F.col("d1").isNotNull(), F.col("opt1")).when(F.col("d2").isNotNull(), F.col("opt2")))
          .withColumn("bdepth", F.coalesce("d1", "d2"))
          .filter(F.col("base").isNotNull())
          .withColumn("branch", F.when(F.col("bdepth") >= F.col("gdepth"), F.lit("base_item_preferred"))
                                 .otherwise(F.lit("tag_group_more_detailed"))))
    removed = (m.select(*keys, F.col("gname").alias("name"))
                .unionByName(m.filter(F.col("branch") == "tag_group_more_detailed").select(*keys, F.col("base").alias("name")))
                .distinct())
    detailed = m.filter(F.col("branch") == "tag_group_more_detailed")
    winner = detailed.groupBy(*keys, "base").agg(F.max(F.struct(
        F.col("gseq").alias("s"), *[F.col("g_" + c).alias(c) for c in ("url", "href", "path", "parent", "depth",
                                                                       "has_nested", "classification", "priority",
                                                                       "should_follow")])).alias("w"))
    replaced = winner.select(*keys, F.col("base").alias("name"),
                             *[F.col("w." + c).alias(c) for c in ("url", "href", "path", "parent", "depth", "has_nested",
                                                                  "classification", "priority", "should_follow")],
                             F.col("w.s").alias("first_seq"), F.lit(True).alias("consolidated"))
    kept = items.join(removed, [*keys, "name"], "left_anti").withColumn("consolidated", F.lit(False))
    cols = [*keys, "name", "url", "href", "path", "parent", "depth", "has_nested", "classification", "priority",
            "should_follow", "first_seq", "consolidated"]
    return kept.select(*cols).unionByName(replaced.select(*cols))


def consolidation_log(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(kept, removed, reason) for each matched group."""
    g = items.filter(F.col("name").startswith(HX.GROUP_PREFIX))
    opt1, opt2 = HX.group_base_names("name")
    g = g.select(*keys, F.col("name").alias("removed"), opt1.alias("opt1"), opt2.alias("opt2"), F.col("depth").alias("gdepth"))
    names = items.select(*keys, F.col("name").alias("bname"), F.col("depth").alias("bdepth"))
    m = (g.join(names.select(*keys, F.col("bname").alias("opt1"), F.col("bdepth").alias("d1")), [*keys, "opt1"], "left")
          .join(names.select(*keys, F.col("bname").alias("opt2"), F.col("bdepth").alias("d2")), [*keys, "opt2"], "left"))
    base = F.when(F.col("d1").isNotNull(), F.col("opt1")).when(F.col("d2").isNotNull(), F.col("opt2"))
    return m.filter(base.isNotNull()).select(
        *keys, base.alias("kept"), "removed",
        F.when(F.coalesce("d1", "d2") >= F.col("gdepth"), "base_item_preferred").otherwise("tag_group_more_detailed").alias("reason"))


# ------------------------------------------------------------------ H13/H12: follow links
def select_groups(resolved: DataFrame, cfg: dict) -> DataFrame:
    """Followable start-page items in arrival order with the decision of each check
    (excluded path segment, excluded name, skip_first_n, target groups, name patterns, url).
    The max_groups limit counts fetched pages and is applied in expand_links."""
    f = numbered(resolved.filter(F.col("should_follow")).select("name", "path", "url", "first_seq"), ["first_seq"], "idx")
    ex = cfg.get("exclude_sections") or []
    reason = F.when(F.exists("path", lambda s: HX.contains_any_term(s, ex)) if ex else F.lit(False), F.lit("excluded_path"))
    reason = reason.when(HX.contains_any_term("name", ex) if ex else F.lit(False), F.lit("excluded_name"))
    reason = reason.when(F.col("idx") < int(cfg.get("skip_first_n") or 0), F.lit("skipped"))
    targets, patterns = cfg.get("target_groups"), cfg.get("group_name_patterns")
    only_targets = dict(cfg, exclude_sections=[], group_name_patterns=None)
    reason = reason.when(~text_item_allowed(F.col("name"), F.col("path"), only_targets) if targets is not None else F.lit(False),
                         F.lit("not_target"))
    direct = F.col("name").isin(list(targets)) if targets is not None else F.lit(False)
    if patterns is not None:
        reason = reason.when(~direct & ~HX.glob_match_any("name", patterns), F.lit("pattern_mismatch"))
    reason = reason.when(F.col("url").isNull(), F.lit("no_url"))
    host = cfg.get("site_host") or HX.SITE_HOST
    return f.select("idx", "name", "path", "url", HX.rewrite_url("url", host).alias("full_url"), reason.alias("skip_reason"), "first_seq")


def expand_links(start_nodes: DataFrame, pages: DataFrame, cfg: dict, hops: int = 1,
                 start_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Follow the selected groups of the start page (hops=1 is the studied behaviour): rewrite
    urls, visit each url once in all hops (first arrival), join the pages table (the fetch), keep the
    first max_groups fetched pages of a hop, walk them with base path = item path.

    seq = (hop, order, pos): order is the way of link positions that leads to the page, so arrival
    order needs no numbering of pages. Html meets its url in a join after the selection, never before.
    Returns (all raw item rows, the followed pages: hop, order, full_url, group, base_path)."""
    def placed(nodes: DataFrame, hop: int, order) -> DataFrame:
        return classify_items(page_items(nodes).withColumn("seq", F.struct(
            F.lit(hop).alias("hop"), order.cast("array<int>").alias("order"), F.col("seq.pos").alias("pos"))))

    items = frontier_items = placed(start_nodes, 0, F.array())
    followed_all = None
    visited = None
    for hop in range(1, hops + 1):
        chosen = select_groups(resolve_duplicates(frontier_items), cfg).filter(F.col("skip_reason").isNull())
        first = chosen.groupBy("full_url").agg(F.min(F.struct("first_seq", "path", "name")).alias("f"))
        if start_url is not None:
            first = first.filter(F.col("full_url") != start_url)
        if visited is not None:
            first = first.join(visited, "full_url", "left_anti")
        first = first.join(pages.select(F.col("url").alias("full_url")).distinct(), "full_url", "left_semi")
        if cfg.get("max_groups") is not None:
            first = first.orderBy("f.first_seq").limit(int(cfg["max_groups"]))
        followed = materialize(first.select(
            F.lit(hop).alias("hop"), F.concat("f.first_seq.order", F.array("f.first_seq.pos")).alias("order"), "full_url",
            F.col("f.name").alias("group"), F.col("f.path").alias("base_path")), "followed")
        html = pages.groupBy(F.col("url").alias("full_url")).agg(F.min_by("html", "page_id").alias("html"))
        nodes = page_nodes(followed.join(html, "full_url").withColumn("page_id", F.col("full_url")), cfg, "base_path")
        ordered = nodes.join(followed.select(F.col("full_url").alias("page_id"), "order"), "page_id")
        new = classify_items(ordered.filter(F.col("kind") == "item").select(
            "page_id", "name", "href", "path", "has_link", "has_nested",
            F.struct(F.lit(hop).alias("hop"), F.col("order"), F.col("pos")).alias("seq")))
        frontier_items = new
        items = items.drop("page_id").unionByName(new.drop("page_id"))
        followed_all = followed if followed_all is None else followed_all.unionByName(followed)
        visited = followed_all.select("full_url")
    return items, followed_all


# ------------------------------------------------------------------ H14-H16
def flatten(items: DataFrame) -> DataFrame:
    """The 8-column flat table (path joined by " → ")."""
    return items.select("name", "url", HX.join_path("path").alias("path"), "parent", "depth",
                        F.col("has_nested").alias("has_nested_list"), "classification", "should_follow")


def group_members(items: DataFrame) -> DataFrame:
    """Direct members of every group (parent, name)."""
    return items.filter(F.col("parent").isNotNull()).select("parent", "name", "depth")


def ancestors(items: DataFrame) -> DataFrame:
    """The path of each item to the root, one row per ancestor (level 1 = root)."""
    x = items.select("name", F.posexplode("path").alias("p", "ancestor"), F.size("path").alias("n"))
    return x.filter(F.col("p") < F.col("n") - 1).select("name", (F.col("p") + 1).alias("level"), "ancestor")


def relational_tables(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tags(tag_id, name, classification_id, depth), tag_classifications, tag_paths
    (one row per path prefix joined by " → "). tag_id is the item name (a natural key)."""
    kinds = [HX.TAG_AND_TAG_GROUP, HX.TAG_GROUP_ONLY, HX.FINAL_TAG_ONLY, HX.TRADITIONAL_TAG_GROUP]
    spark = items.sparkSession
    cls = spark.createDataFrame([(i + 1, k) for i, k in enumerate(kinds)], "classification_id int, classification_name string")
    cid = F.lit(None).cast("int")
    for i, k in enumerate(kinds):
        cid = F.when(F.col("classification") == k, F.lit(i + 1)).otherwise(cid)
    tags = items.select(F.col("name").alias("tag_id"), "name", cid.alias("classification_id"), "depth")
    paths = items.select(F.col("name").alias("tag_id"), F.posexplode("path").alias("p", "seg"), "path").select(
        "tag_id", F.array_join(F.slice("path", 1, F.col("p") + 1), HX.PATH_SEP_FLAT).alias("path_value"))
    return tags, cls, paths


def items_under_path(items: DataFrame, term: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Items with a path prefix matching %term% (case-insensitive LIKE):
    their distinct count, and the first k by (depth, name) with the class name."""
    tags, cls, paths = relational_tables(items)
    hit = paths.filter(F.col("path_value").ilike(f"%{term}%")).select("tag_id").distinct()
    count = hit.agg(F.count(F.lit(1)).alias("items"))
    listing = (tags.join(cls, "classification_id").join(hit, "tag_id", "left_semi")
                   .orderBy("depth", "name").limit(k).select("name", "classification_name", "depth"))
    return count, listing


COUNT_UNDER_PATH = """
SELECT count(DISTINCT tag_id) AS items FROM {paths} WHERE path_value ILIKE concat('%', :term, '%')"""

LIST_UNDER_PATH = """
SELECT t.name, c.classification_name, t.depth
FROM {tags} t JOIN {classifications} c ON t.classification_id = c.classification_id
WHERE t.tag_id IN (SELECT tag_id FROM {paths} WHERE path_value ILIKE concat('%', :term, '%'))
ORDER BY t.depth, t.name LIMIT :k"""


def items_under_path_sql(items: DataFrame, term: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """S7/H16 as the two SQL statements over the three tables, with the term and k as parameters."""
    tags, classifications, paths = relational_tables(items)
    spark, views = items.sparkSession, {"tags": tags, "classifications": classifications, "paths": paths}
    return (spark.sql(COUNT_UNDER_PATH, {"term": term}, paths=paths), spark.sql(LIST_UNDER_PATH, {"term": term, "k": k}, **views))


def run_statistics(raw_items: DataFrame, resolved: DataFrame, nodes: DataFrame, norm_log: DataFrame,
                   removed: DataFrame) -> DataFrame:
    """Items, followable items, distinct excluded / ignored, log sizes (one row)."""
    def cnt(df):
        return df.select(F.count(F.lit(1))).scalar()

    return resolved.agg(F.count(F.lit(1)).alias("total_items"),
                        F.sum(F.col("should_follow").cast("int")).cast("bigint").alias("total_followable_items")) \
        .withColumn("excluded_sections", nodes.filter(F.col("kind") == "excluded").select(F.count_distinct("name")).scalar()) \
        .withColumn("ignored_elements", nodes.filter(F.col("kind") == "ignored").select(F.count_distinct("name")).scalar()) \
        .withColumn("normalization_changes", cnt(norm_log)) \
        .withColumn("removed_duplicates", cnt(removed)) \
        .withColumn("raw_rows", cnt(raw_items))

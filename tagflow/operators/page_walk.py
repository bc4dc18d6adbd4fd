"""From flat page rows to items with paths (H2-H6, W9, F12, F13), as DataFrame work.

Headings: the section path of a row is the last heading of each level that no higher heading has
closed -- six running windows within the page. Lists: a list item opens the list inside it, or else
the list that follows it at once; a list that no item opens belongs to its section, and so does one whose
opener turns out not to count. The list that holds an opener stands around the list it opens, so a list's way
from its section is among the lists around it: these meet their openers in one join, and a fold over them,
outermost first, decides at each step whether the opener counts. Nesting of any depth takes the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hierarchy as HX
from ..session import drop_state, ship_package, state_path
from .html_nodes import DDL, FIELDS, page_rows

#: Pages whose rows a task holds at once.
PAGES = 64


def parsed(pages: DataFrame, noise: tuple[str, ...] | None = None) -> DataFrame:
    """pages (page_id, base_path, html) -> page_id, base_path and a row for each heading, list and list item."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                which, rows = [], []
                for n, html in enumerate(part.column(2).to_pylist()):
                    found = page_rows(html, noise)
                    which.extend([n] * len(found))
                    rows.extend(found)
                if rows:
                    index = pa.array(which, pa.int64())
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), *columns],
                                                     ["page_id", "base_path", *FIELDS])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "base_path", "html").mapInArrow(run, f"page_id {kind}, base_path array<string>, {DDL}")


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_TYPES = [_ARROW[f.split()[1]] for f in DDL.split(", ")]


def sections(rows: DataFrame, exclude: list[str], drop_excluded: bool) -> DataFrame:
    """Headings and lists that stand in no list item, with level, the texts of the open headings, and excluded."""
    heading = F.col("tag").startswith("h")
    level = F.when(heading & (F.col("text") != ""), F.substring("tag", 2, 1).cast("int"))
    marked = rows.where(heading | ((F.col("tag") == "ul") & (F.col("parent_tag") != "li"))).withColumn("level", level)
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        marked = marked.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", "text")), ignorenulls=True).over(upto))
    open_ones = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"h{j}.pos"), F.lit(-1)) for j in range(1, k)]
        open_ones.append(F.when(F.col(f"h{k}.pos") > (F.greatest(F.lit(-1), *above) if above else F.lit(-1)), F.col(f"h{k}.text")))
    path = F.filter(F.array(*open_ones), lambda t: t.isNotNull())
    out = marked.withColumn("open", path).drop(*[f"h{k}" for k in range(1, 7)])
    excluded = F.exists("open", lambda t: HX.contains_any_term(t, exclude)) if drop_excluded and exclude else F.lit(False)
    return out.withColumn("excluded", excluded)


def text_item_allowed(name: Column, path: Column, cfg: dict) -> Column:
    """F13 for an item without a link: no excluded part, and a target group or a name pattern if there are any."""
    ex, targets, patterns = cfg.get("exclude_sections") or [], cfg.get("target_groups"), cfg.get("group_name_patterns")
    allowed = ~F.exists(path, lambda s: HX.contains_any_term(s, ex)) if ex else F.lit(True)
    rest = F.lit(True)
    if patterns is not None:
        rest = HX.glob_match_any(name, patterns)
    if targets is not None:
        direct, joined = name.isin(list(targets)), F.lower(HX.join_path(path, HX.PATH_SEP_MATCH))
        within = F.lit(False)
        for t in targets:
            within = within | joined.contains(t.lower())
        rest = direct | (within & rest)
    return allowed & rest


def reached_lists(raw: DataFrame, sections_of: DataFrame, items: DataFrame, cfg: dict) -> DataFrame:
    """page_id, ul, path, root (the list its section holds) and depth of each list that the walk comes to.

    raw: parsed rows; sections_of: page_id, ul, section (the path of lists that may belong to one); items: list
    items with ul, opens, part, name, ignored, has_link, start.
    """
    openers = items.where(F.col("opens").isNotNull()).groupBy("page_id", F.col("opens").alias("ul")).agg(F.min(F.struct(
        "pos", F.col("ul").alias("held"), "part", "name", "has_link", "ignored", "start")).alias("o"))
    lists = raw.where(F.col("tag") == "ul").select("page_id", F.col("pos").alias("list"), "outer_uls")
    around = lists.select("page_id", "list", F.explode(F.concat("outer_uls", F.array("list"))).alias("ul"))
    steps = (around.join(openers, ["page_id", "ul"], "left").join(sections_of, ["page_id", "ul"], "left")
             .select("page_id", "list", F.struct("ul", "o", "section").alias("x")).groupBy("page_id", "list")
             .agg(F.array_sort(F.collect_list("x"), lambda a, b: a["ul"] - b["ul"]).alias("steps")))  # as many as lists around it

    def link(acc: Column, x: Column) -> Column:
        linked = F.struct(x["o"]["held"].alias("need"), F.concat(F.array(x), acc["way"]).alias("way"))
        return F.when(x["ul"] == acc["need"], linked).otherwise(acc)

    none = F.filter("steps", lambda x: F.lit(False))
    way = F.aggregate(F.reverse("steps"), F.struct(F.col("list").alias("need"), none.alias("way")), link, lambda acc: acc["way"])
    kind = "struct<path:array<string>,root:int,depth:int,alive:boolean>"
    most = cfg.get("max_depth")

    def down(acc: Column, x: Column) -> Column:
        o = x["o"]
        fits = o["has_link"] | ~o["start"] | text_item_allowed(o["name"], F.concat(acc["path"], F.array(o["name"])), cfg)
        counts = acc["alive"] & o.isNotNull() & ~o["ignored"] & fits & (F.lit(True) if most is None else acc["depth"] < most)
        below = F.struct(F.concat(acc["path"], F.array(o["part"])), acc["root"], acc["depth"] + 1, F.lit(True)).cast(kind)
        again = F.struct(x["section"], x["ul"], F.lit(0), F.lit(True)).cast(kind)
        dead = F.struct(acc["path"], acc["root"], acc["depth"], F.lit(False)).cast(kind)
        return F.when(F.coalesce(counts, F.lit(False)), below).when(x["section"].isNotNull(), again).otherwise(dead)

    start = F.struct(F.array().cast("array<string>"), F.lit(None).cast("int"), F.lit(0), F.lit(False)).cast(kind)
    walked = steps.select("page_id", F.col("list").alias("ul"), F.aggregate(way, start, down).alias("s")).where("s.alive")
    return walked.select("page_id", "ul", "s.path", "s.root", "s.depth")


def walk(pages: DataFrame, cfg: dict) -> DataFrame:
    """pages (page_id, base_path, html) -> page_id, kind, pos, name, href, path, has_link, has_nested, level.

    kind: heading, excluded (a heading), ignored (a list item) or item. pos counts a page's rows in
    the order in which the walk meets them.
    """
    spark = pages.sparkSession
    made: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder; all but the result go at the end."""
        made.append(state_path(spark, f"page-{name}"))
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    noise = cfg.get("noise")
    raw = put(parsed(pages, None if noise is None else tuple(noise)), "nodes")
    ex, drop_excluded = cfg.get("exclude_sections") or [], cfg.get("exclude", "items") == "items"
    found = put(sections(raw, ex, drop_excluded), "sections")
    base = F.coalesce("base_path", F.array().cast("array<string>"))

    heads = found.where(F.col("level").isNotNull())
    nothing = F.array().cast("array<string>")
    null = F.lit(None).cast("string")

    def out(df, kind, name, href, path, link, nested, level=None):
        return df.select("page_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col("root"), F.col("pos").alias("at"), name.alias("name"),
                         href.alias("href"), path.alias("path"), link.alias("has_link"), nested.alias("has_nested"),
                         (level if level is not None else F.lit(None).cast("int")).alias("level"))

    no, yes = F.lit(False), F.lit(True)
    heads = heads.withColumn("root", F.col("pos"))
    parts = [out(heads, "heading", F.col("text"), null, nothing, no, no, F.col("level")),
             out(heads.where(F.col("excluded") & HX.contains_any_term("text", ex)) if ex else heads.limit(0),
                 "excluded", F.col("text"), null, nothing, no, no, F.col("level")),
             out(heads.where(~F.col("excluded") & (F.col("next_tag") == "ul")), "item", F.col("text"), null,
                 F.concat(base, "open"), no, yes)]

    ignored = HX.contains_any_term("text", cfg.get("ignore_elements") or []) if cfg.get("ignore_elements") else no
    opens = F.when(ignored, None).when(F.col("inner_ul").isNotNull(), F.col("inner_ul")).when(
        F.col("next_tag") == "ul", F.col("next_pos"))
    sibling = F.col("next_tag") == "ul" if cfg.get("sibling", "any") == "immediate" else F.col("next_ul").isNotNull()
    linked = F.col("href").isNotNull()
    lis = put(raw.where((F.col("tag") == "li") & (F.col("parent_tag") == "ul") & F.col("has_text")).select(
        "page_id", F.col("pos"), F.col("parent_pos").alias("ul"), F.col("text"), "href", "link_text", ignored.alias("ignored"),
        F.when(linked, F.col("link_text")).otherwise(F.col("text")).alias("name"), linked.alias("has_link"),
        (F.col("inner_ul").isNotNull() | F.coalesce(sibling, no)).alias("has_nested"), opens.alias("opens"),
        F.when(F.col("inner_ul").isNotNull(), F.col("text")).otherwise(F.coalesce("link_text", "text")).alias("part"),
        (F.size(base) == 0).alias("start")), "items")
    allowed = F.col("has_link") | ~F.col("start") | text_item_allowed(F.col("name"), F.col("full"), cfg)
    here = reached_lists(raw, found.where((F.col("tag") == "ul") & ~F.col("excluded")).select(
        "page_id", F.col("pos").alias("ul"), F.concat(base, "open").alias("section")), lis, cfg)
    met = lis.join(here, ["page_id", "ul"]).withColumn("full", F.concat("path", F.array("name"))).where(F.col("ignored") | allowed)
    parts.append(out(met, F.when(F.col("ignored"), "ignored").otherwise("item"), F.when(F.col("ignored"), F.col("text")).otherwise(F.col("name")),
                     F.when(~F.col("ignored"), F.col("href")), F.when(F.col("ignored"), F.col("path")).otherwise(F.col("full")),
                     F.col("has_link") & ~F.col("ignored"), F.col("has_nested") & ~F.col("ignored")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("page_id").orderBy("root", "at", F.array_position(F.array(
        F.lit("heading"), F.lit("excluded"), F.lit("ignored"), F.lit("item")), F.col("kind")))
    numbered = rows.withColumn("pos", F.row_number().over(order) - 1)
    result = put(numbered.select("page_id", "kind", "pos", "name", "href", "path", "has_link", "has_nested", "level"), "walk")
    for path in made[:-1]:
        drop_state(spark, path)
    return result

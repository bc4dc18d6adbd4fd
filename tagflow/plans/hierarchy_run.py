"""A hierarchy run over a pages table, its JSON sink (S10) and the nested-JSON reader."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..session import materialize

ITEM_STRUCT = ("struct<name:string, url:string, path:array<string>, parent:string, depth:int, "
               "has_nested_list:boolean, classification:string, should_follow:boolean>")


def run_hierarchy(pages: DataFrame, start_url: str, cfg: dict | None = None, hops: int = 1) -> dict[str, DataFrame]:
    """Start page -> walk -> one-hop expansion -> H8 -> H9/H10 -> H11 -> statistics."""
    cfg = cfg or H.default_config()
    start = H.page_nodes(pages.filter(F.col("url") == start_url), cfg)
    raw_items, followed = H.expand_links(start, pages, cfg, hops, start_url)
    raw_items = materialize(raw_items, "hier-raw")
    raw = materialize(H.resolve_duplicates(raw_items), "hier-resolved")
    norm = materialize(H.normalise(raw), "hier-normalised")
    headings = start.filter(F.col("kind") == "heading").select("pos", "level", F.col("name").alias("text"))
    ignored = start.filter(F.col("kind") == "ignored").select(F.col("name"))
    log = (H.normalisation_log(norm).withColumn("source", F.lit("item"))
           .unionByName(H.text_log(start.filter(F.col("kind") == "heading"), "heading"))
           .unionByName(H.text_log(start.filter(F.col("kind") == "ignored"), "ignored_element")))
    removed = H.removed_duplicates(raw, norm)
    cons = H.consolidate(norm)
    config = pages.sparkSession.createDataFrame([(json.dumps(cfg, sort_keys=True, default=list), start_url, hops)],
                                                "config string, start_url string, hops int")
    return {"config": config, "raw_items": raw, "headings": headings, "ignored": ignored, "followed": followed,
            "normalised": norm, "normalization_log": log, "removed_duplicates": removed,
            "items": cons, "consolidation_log": H.consolidation_log(norm),
            "statistics": H.run_statistics(raw_items, raw, start, log, removed)}


def write_result(result: dict[str, DataFrame], out_dir: str) -> None:
    """Every member as JSON lines (items keep their path arrays)."""
    for name in ("config", "items", "raw_items", "headings", "ignored", "followed", "normalization_log", "removed_duplicates",
                 "consolidation_log", "statistics"):
        df = result[name]
        if name in ("items", "raw_items"):
            df = df.select("name", "url", "path", "parent", "depth", F.col("has_nested").alias("has_nested_list"),
                           "classification", "should_follow")
        df.write.mode("overwrite").json(f"{out_dir}/{name}")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items written by write_result."""
    return spark.read.schema(ITEM_STRUCT[len("struct<"):-1].replace(":", " ")).json(path)


def write_nested_result(items: DataFrame, path: str, per_document: int = 1000, member: str = "normalized_data") -> None:
    """The studied project's nested format, {member: {items: {name: item}}}, one document for about per_document items.

    Items are dealt to documents by hash of the name, so no document or task holds more than its share."""
    n = max(1, -(-items.count() // per_document))
    fields = ["name", "url", "path", "parent", "depth", F.col("has_nested").alias("has_nested_list"), "classification", "should_follow"]
    docs = items.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).alias("document")).agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct(*fields)))).alias("items"))
    docs.select(F.to_json(F.struct(F.struct("items").alias(member)), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def read_nested_result(spark: SparkSession, path: str, member: str = "normalized_data") -> DataFrame:
    """Nested documents ({member: {items: {name: item}}}) -> rows, one for each entry.

    A document is read as VARIANT, a compact binary value of any shape, and exploded by key: no struct or map of
    all its items is built, and an item may lack fields (null) or have others. A JSON document is one record,
    so parsing it is one task's work; the rows are dealt anew by name for what follows."""
    docs = spark.read.option("multiLine", True).option("singleVariantColumn", "doc").json(path)
    items = docs.select(F.variant_get("doc", f"$.{member}.items", "variant").alias("items"))
    entries = items.lateralJoin(spark.tvf.variant_explode(F.col("items").outer())).select("key", "value")
    fields = ITEM_STRUCT[len("struct<"):-1].split(", ")
    return entries.repartition("key").select(*[F.variant_get("value", f"$.{f.split(':')[0]}", f.split(":")[1]).alias(f.split(":")[0]) for f in fields])

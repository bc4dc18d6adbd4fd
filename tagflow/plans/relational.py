"""The normalised layout as five bucketed tables, whose joins on post or tag need no exchange.

posts (post_id, ...) and post_tags (post_id, position, tag) share buckets by post; tags (tag, freq), wiki_pages (tag, ...)
and wiki_other_names (tag, other_name) by tag. A table is sorted inside its buckets, one file each. Tables are
external: their files lie in the folder given, their names in the session's catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import page_tag
from ..operators.counts import tag_frequency

KEYS = {"posts": "post_id", "post_tags": "post_id", "tags": "tag", "wiki_pages": "tag", "wiki_other_names": "tag"}


def normalised_tables(posts_with_tags: DataFrame, wiki: DataFrame) -> dict[str, DataFrame]:
    """The five tables from posts (post_id, score, rating, created_at, tags) and wiki (id, title, tag, body, other_names)."""
    bridge = posts_with_tags.select("post_id", F.posexplode("tags").alias("position", "tag"))
    pages = wiki.select(page_tag("tag", "title").alias("tag"), F.col("id").alias("wiki_id"), "title", "body", "other_names").where("tag IS NOT NULL")
    return {"posts": posts_with_tags.select("post_id", "score", "rating", "created_at"), "post_tags": bridge,
            "tags": tag_frequency(posts_with_tags), "wiki_pages": pages.drop("other_names"),
            "wiki_other_names": pages.select("tag", F.explode("other_names").alias("other_name"))}


def write_bucketed(tables: dict[str, DataFrame], out_dir: str, buckets: int) -> dict[str, str]:
    """Writes each table in buckets by its key; the names to read them by. ``drop_bucketed`` forgets them."""
    names = {}
    for table, df in tables.items():
        key = KEYS[table]
        names[table] = f"tagflow_{table}_{uuid.uuid4().hex[:12]}"
        (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
         .option("path", f"{out_dir}/{table}").saveAsTable(names[table]))
    return names


def drop_bucketed(spark: SparkSession, names: dict[str, str]) -> None:
    """Takes the tables out of the catalogue; their files stay."""
    for name in names.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def post_summaries(posts: DataFrame, post_tags: DataFrame) -> DataFrame:
    """J9 on the layout: (post_id, score, n_tags, first_tag): a join and an aggregation on the bucket key."""
    lists = post_tags.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_tags"), F.min_by("tag", "position").alias("first_tag"))
    return posts.join(lists, "post_id").select("post_id", "score", "n_tags", "first_tag")


def tag_pages(tags: DataFrame, wiki_pages: DataFrame, wiki_other_names: DataFrame) -> DataFrame:
    """J12 on the layout: (tag, freq, wiki_id, other_names) of tags that have a page, other names counted."""
    others = wiki_other_names.groupBy("tag").agg(F.count(F.lit(1)).alias("other_names"))
    return (tags.join(wiki_pages.select("tag", "wiki_id"), "tag").join(others, "tag", "left")
            .select("tag", "freq", "wiki_id", F.coalesce("other_names", F.lit(0)).alias("other_names")))

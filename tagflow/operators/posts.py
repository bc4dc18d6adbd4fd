"""Post filters and simple post statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.tags import DEFAULT_BLOCKLIST, has_any_tag, parse_tag_list, remove_tags
from .common import first_rows

# Ratings behind the two named filters; any other filter value keeps every rating.
RATING_SETS = {"safe": ("g", "s"), "nsfw": ("q", "e")}


def active_predicate() -> Column:
    """F1: not deleted, not banned, positive score."""
    return (~F.col("is_deleted")) & (~F.col("is_banned")) & (F.col("score") > 0)


def active_posts(posts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """F1 + F2: filter then prune (both reach the scan when posts is a parquet table)."""
    df = posts.filter(active_predicate())
    return df.select(*columns) if columns else df


def rating_filter(posts: DataFrame, rating: str | None) -> DataFrame:
    """'safe' -> g,s; 'nsfw' -> q,e; anything else -> no filter."""
    keep = RATING_SETS.get(rating or "")
    return posts.filter(F.col("rating").isin(*keep)) if keep else posts


def with_tags(posts: DataFrame, stop_tags: Iterable[str] | None = None) -> DataFrame:
    """X1 (+ optional F5): add `post_id` (= id) and the parsed general tag list `tags`."""
    tags = parse_tag_list("general")
    if stop_tags:
        tags = remove_tags(tags, stop_tags)
    return posts.withColumn("post_id", F.col("id")).withColumn("tags", tags)


def flag_blocked(posts_with_tags: DataFrame, blocklist: Iterable[str] = DEFAULT_BLOCKLIST) -> DataFrame:
    """F4 flag: any tag of the post is in the blocklist (exact match)."""
    return posts_with_tags.withColumn("_blocked", has_any_tag("tags", blocklist))


def filter_posts(posts: DataFrame, rating: str | None = "nsfw",
                 blocklist: Iterable[str] = DEFAULT_BLOCKLIST,
                 stop_tags: Iterable[str] | None = None) -> DataFrame:
    """Rating filter -> tag parse -> blocklist drop (the analysis input set)."""
    df = flag_blocked(with_tags(rating_filter(posts, rating), stop_tags), blocklist)
    return df.filter(~F.col("_blocked")).drop("_blocked")


def blocked_count(posts: DataFrame, rating: str | None = "nsfw",
                  blocklist: Iterable[str] = DEFAULT_BLOCKLIST) -> DataFrame:
    """Number of posts the blocklist removes (one row)."""
    df = flag_blocked(with_tags(rating_filter(posts, rating)), blocklist)
    return df.agg(F.sum(F.col("_blocked").cast("bigint")).alias("blocked_posts"),
                  F.count(F.lit(1)).alias("checked_posts"))


def first_n(posts: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """the first n rows in a stated order (Spark has no row position), by threshold where the order is one of numbers."""
    number = isinstance(posts.schema[order_col].dataType, NumericType)
    lead = F.col(order_col) if number else F.lit(None)
    return first_rows(posts, lead, [F.col(order_col).asc_nulls_last()], n, "_place")[0].drop("_place")


def filter_rate(posts: DataFrame) -> DataFrame:
    """kept / total under F1, over the whole table (one row)."""
    kept = F.sum(F.when(active_predicate(), 1).otherwise(0))
    return posts.agg(kept.cast("bigint").alias("kept"), F.count(F.lit(1)).alias("total"),
                     (kept / F.count(F.lit(1))).alias("rate"))


def rating_distribution(posts: DataFrame) -> DataFrame:
    """A12."""
    return posts.groupBy("rating").agg(F.count(F.lit(1)).alias("posts"))


def score_range(posts: DataFrame) -> DataFrame:
    """Global min / max of score and creation time (one row)."""
    return posts.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"),
                     F.min("created_at").alias("min_created_at"), F.max("created_at").alias("max_created_at"))

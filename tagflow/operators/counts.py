"""Tag counting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import split_comma_tags
from ..sources.adapters import TAG_TYPES


def tag_frequency(posts_with_tags: DataFrame) -> DataFrame:
    """A1: occurrences of each tag over the parsed lists (duplicates inside a post count).

    A hot tag is pre-aggregated map-side (partial aggregation), so skew never reaches one task
    as raw rows.
    """
    return (posts_with_tags.select(F.explode("tags").alias("tag"))
            .filter(F.col("tag") != "")
            .groupBy("tag").agg(F.count(F.lit(1)).alias("freq")))


def long_tags(posts: DataFrame, types: Iterable[str] = TAG_TYPES) -> DataFrame:
    """(tag_type, tag) rows of every tag column in one pass over the posts."""
    per_type = F.array(*[F.struct(F.lit(t).alias("tag_type"), split_comma_tags(t).alias("tags")) for t in types])
    return (posts.select(F.explode(per_type).alias("x"))
                 .select(F.col("x.tag_type").alias("tag_type"), F.explode("x.tags").alias("tag")))


def tag_counts_by_type(posts: DataFrame, types: Iterable[str] = TAG_TYPES) -> DataFrame:
    """A2/A3: (tag, tag_type, count) per tag column."""
    return long_tags(posts, types).groupBy("tag", "tag_type").agg(F.count(F.lit(1)).alias("count"))


def tag_counts_with_all(posts: DataFrame, types: Iterable[str] = TAG_TYPES) -> DataFrame:
    """A2 + A4: typed rows plus tag_type = 'all' totals, which sum the few typed counts of each tag
    (a rollup over counts, not over the exploded tags)."""
    typed = tag_counts_by_type(posts, types).rollup("tag", "tag_type").agg(
        F.sum("count").alias("count"), F.grouping("tag").alias("g_tag"), F.grouping("tag_type").alias("g_type"))
    return typed.filter(F.col("g_tag") == 0).select(
        "tag", F.when(F.col("g_type") == 1, F.lit("all")).otherwise(F.col("tag_type")).alias("tag_type"), "count")


def tag_count_stats(counts_with_all: DataFrame) -> DataFrame:
    """A5: distinct tags and total occurrences per tag_type ('all' included)."""
    return counts_with_all.groupBy("tag_type").agg(
        F.count(F.lit(1)).alias("distinct_tags"), F.sum("count").cast("bigint").alias("occurrences"))


def top_per_type(counts: DataFrame, k: int = 20) -> DataFrame:
    """K most frequent tags per type (ties: tag asc); row_number <= k plans a
    WindowGroupLimit, so only k rows per type and partition cross the shuffle."""
    w = Window.partitionBy("tag_type").orderBy(F.col("count").desc(), F.col("tag").asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

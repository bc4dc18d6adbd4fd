"""Separate the tags of one category from a post's others, or swap them for another category's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counterparts(categories: DataFrame, source: str, target: str) -> DataFrame:
    """(tag, swapped): tags of category source with the tag of category target that has the same trait.

    categories: (tag, category, trait); of several tags with one category and trait the smallest counts."""
    there = categories.where(F.col("category") == target).groupBy("trait").agg(F.min("tag").alias("swapped"))
    return categories.where(F.col("category") == source).select("tag", "trait").join(there, "trait").groupBy("tag").agg(
        F.min("swapped").alias("swapped"))


def swap_traits(posts: DataFrame, swaps: DataFrame, id_col: str = "post_id", tags_col: str = "tags") -> DataFrame:
    """(id, tags, n_swapped): every tag that has a counterpart is replaced in its place; repeated tags stay repeated.

    Tags meet the swaps as rows, so neither the category table nor a common tag has to fit into a task; lists are put
    together again by post."""
    long = posts.select(F.col(id_col), F.posexplode_outer(tags_col).alias("at", "tag"))
    met = long.join(swaps.select("tag", "swapped"), "tag", "left")
    item = F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("swapped", "tag").alias("tag")))
    lists = met.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("x"), F.count("swapped").alias("n_swapped"))
    return lists.select(id_col, F.transform("x", lambda x: x["tag"]).alias(tags_col), "n_swapped")


def first_word(tag) -> Column:
    return F.substring_index(F.col(tag) if isinstance(tag, str) else tag, " ", 1)

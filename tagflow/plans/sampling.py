"""Active-post samples (top-N by score per hour, or random-N) written per sample label."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts as K
from ..operators import sampling as S
from ..operators.posts import active_posts
from ..sources.adapters import POST_COLUMNS


def samples(posts: DataFrame, sizes: Iterable[int], method: str = "top", seed: int = 42) -> DataFrame:
    """All requested samples in one frame with a `sample_label` column; sizes above the active set
    are skipped. Top samples carry rank_score_per_hour and the per-sample re-based score_per_hour
    (trap 4); the re-basing minimum of each sample is an aggregate, a row for each size asked for."""
    active = active_posts(posts, [c for c in POST_COLUMNS])
    if method == "top":
        ranked = S.top_n_sizes(S.with_score_per_hour(active), sizes)
        origins = ranked.groupBy("sample_size").agg(F.min("created_datetime").alias("_origin"))
        hours = S.whole_hours_since("created_datetime", F.col("_origin"))
        return (ranked.join(F.broadcast(origins), "sample_size").withColumnRenamed("score_per_hour", "rank_score_per_hour")
                      .withColumn("hours_since_start", hours)
                      .withColumn("score_per_hour", S.per_hour("score", "hours_since_start")).drop("_origin"))
    return S.ranked_sizes(active, S.random_lead("id", seed), S.random_order("id", seed), sizes, "random")


def sample_stats(sampled: DataFrame) -> DataFrame:
    """A12/A13 per sample: rows, score range, rating counts."""
    base = sampled.groupBy("sample_label").agg(F.count(F.lit(1)).alias("rows"), F.min("score").alias("min_score"),
                                               F.max("score").alias("max_score"))
    ratings = sampled.groupBy("sample_label").pivot("rating", ["s", "q", "g", "e"]).count()
    return base.join(ratings, "sample_label", "left")


def write_samples(sampled: DataFrame, out_dir: str) -> None:
    """One parquet directory per sample label."""
    sampled.write.mode("overwrite").partitionBy("sample_label").parquet(f"{out_dir}/samples")


def write_tag_counts(posts: DataFrame, out_dir: str) -> None:
    """Tag counts (typed + 'all') partitioned by tag_type."""
    K.tag_counts_with_all(posts).write.mode("overwrite").partitionBy("tag_type").parquet(f"{out_dir}/tag_counts")

"""Report rows (R1-R4) and their text rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import representative_tags
from ..operators.common import row_count


def run_overview(filtered: DataFrame, tag_freq: DataFrame, size: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """One row -- posts, general tags, graph nodes / edges, detected clusters."""
    clusters = cluster_map.agg(F.count_distinct("cluster_id").alias("clusters"))
    return (size.select("nodes", "edges")
                .withColumn("posts", row_count(filtered))
                .withColumn("unique_tags", row_count(tag_freq))
                .withColumn("clusters", clusters.scalar()))


def ranked_clusters(metrics: DataFrame, min_posts: int = 50, k: int = 20) -> DataFrame:
    """R2 (F15, K7): clusters with >= min_posts posts by opportunity desc (ties: cluster_id asc)."""
    return (metrics.filter(F.col("num_posts") >= min_posts)
                   .orderBy(F.col("opportunity").desc(), F.col("cluster_id").asc()).limit(k))


def niche_clusters(metrics: DataFrame, min_posts: int = 50, k: int = 20) -> DataFrame:
    """Clusters below min_posts by median desc (ties: cluster_id asc)."""
    return (metrics.filter(F.col("num_posts") < min_posts)
                   .orderBy(F.col("demand_median").desc(), F.col("cluster_id").asc()).limit(k))


def all_clusters(cluster_map: DataFrame, metrics: DataFrame, vocab: DataFrame, k_tags: int = 15) -> DataFrame:
    """R4 (J17, K8): every detected cluster; scored clusters first by opportunity desc, unscored
    last, ties by larger cluster_id first; representative tags fall back to the members sorted by
    frequency. Rows are bounded by the number of clusters (<= vocabulary size)."""
    fallback = representative_tags(cluster_map, vocab, k_tags).select(
        "cluster_id", F.col("representative_tags").alias("member_tags"))
    j = fallback.join(metrics, "cluster_id", "left")
    rep = F.slice(F.coalesce(F.col("representative_tags"), F.col("member_tags")), 1, k_tags)
    order = [F.col("opportunity").desc_nulls_last(), F.col("cluster_id").desc()]
    return j.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "cluster_id",
                    F.coalesce("num_posts", F.lit(0)).cast("bigint").alias("num_posts"),
                    "opportunity", rep.alias("representative_tags"))


def render_lines(df: DataFrame, fmt: str, *cols: str) -> DataFrame:
    """One formatted text line per report row (written with write.text)."""
    return df.select(F.format_string(fmt, *[F.col(c) for c in cols]).alias("value"))

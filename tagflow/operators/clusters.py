"""Cluster analytics over a tag -> cluster map.

Exact order statistics without sorting a whole cluster: scores are counted per (cluster, score)
with map-side partial aggregation, and the ranks are found on that histogram, whose size is the
number of distinct scores, not the number of posts. A cluster holding a third of all posts is
therefore never gathered or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import opportunity
from .common import row_count


def post_cluster(filtered: DataFrame, cluster_map: DataFrame,
                 meta_cols: tuple[str, ...] = ("id", "score", "created_at")) -> DataFrame:
    """C1 (A7 + W2): each post's modal cluster over its tags (duplicates count); ties -> smaller
    cluster_id. Posts without a clustered tag are dropped. Post metadata rides along as grouping
    keys (functionally dependent on post_id), so no join back to the posts is needed."""
    keys = ["post_id", *meta_cols]
    long = filtered.select(*keys, F.explode("tags").alias("tag"))
    j = long.join(cluster_map.select("tag", "cluster_id"), "tag")
    hits = j.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("tag_hits"))
    best = hits.groupBy(*keys).agg(F.max(F.struct("tag_hits", (-F.col("cluster_id")).alias("neg_cid"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg_cid")).alias("cluster_id"), F.col("b.tag_hits").alias("tag_hits"))


def score_histogram(pc: DataFrame) -> DataFrame:
    """(cluster_id, score, c, cum, n): counts per score, running count and cluster size."""
    h = pc.groupBy("cluster_id", "score").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("cluster_id").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (h.withColumn("cum", F.sum("c").over(w))
             .withColumn("n", F.sum("c").over(Window.partitionBy("cluster_id"))))


def _at_rank(rank_expr):
    """Score of the bin holding the 1-based rank `rank_expr`."""
    return F.max(F.when((F.col("cum") - F.col("c") < rank_expr) & (rank_expr <= F.col("cum")), F.col("score")))


def cluster_metrics(pc: DataFrame, cluster_map: DataFrame, vocab: DataFrame, rep_k: int = 20) -> DataFrame:
    """C2 (A8-A10, X9, W3, J7, J8): per cluster with posts:
    num_posts, num_unique_tags, demand_median (mean of the two middle scores), demand_top10_avg
    (mean of scores >= q90, q90 = 'nearest' rank round((n-1)*0.9)), demand_max, demand_min,
    competition (= num_posts), trend_score (0.0), opportunity (median - ln posts) and the
    rep_k most frequent member tags (freq desc, tag asc; unknown freq -> 0)."""
    h = score_histogram(pc)
    n = F.col("n")
    r_lo = F.floor((n + 1) / 2)
    r_hi = F.floor(n / 2) + 1
    r90 = F.floor(((n - 1) * 9 + 5) / 10) + 1
    top = F.col("cum") >= r90
    m = h.groupBy("cluster_id").agg(
        F.first("n").alias("num_posts"),
        ((_at_rank(r_lo) + _at_rank(r_hi)) / 2.0).alias("demand_median"),
        (F.sum(F.when(top, F.col("score") * F.col("c"))) / F.sum(F.when(top, F.col("c")))).cast("double")
         .alias("demand_top10_avg"),
        F.max("score").alias("demand_max"),
        F.min("score").alias("demand_min"),
        _at_rank(r90).alias("q90"),
    )
    m = m.select("cluster_id", F.col("num_posts").cast("bigint").alias("num_posts"), "demand_median",
                 "demand_top10_avg", "demand_max", "demand_min",
                 F.col("num_posts").cast("bigint").alias("competition"), F.lit(0.0).alias("trend_score"),
                 opportunity("demand_median", "num_posts").alias("opportunity"), "q90")
    rep = representative_tags(cluster_map, vocab, rep_k)
    return m.join(rep, "cluster_id", "left")


def representative_tags(cluster_map: DataFrame, vocab: DataFrame, k: int = 20) -> DataFrame:
    """(cluster_id, num_unique_tags, representative_tags[k])."""
    f = cluster_map.join(vocab.select("tag", "freq"), "tag", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    w = Window.partitionBy("cluster_id").orderBy(F.col("freq").desc(), F.col("tag").asc())
    ranked = f.withColumn("r", F.row_number().over(w))
    sizes = cluster_map.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_unique_tags"))
    tops = (ranked.filter(F.col("r") <= k).groupBy("cluster_id")
                  .agg(F.sort_array(F.collect_list(F.struct("r", "tag"))).alias("rt"))
                  .select("cluster_id", F.transform("rt", lambda x: x["tag"]).alias("representative_tags")))
    return sizes.join(tops, "cluster_id", "left")


def distinctive_tags(filtered: DataFrame, pc: DataFrame, k: int = 15, min_cluster_tag_posts: int = 10,
                     min_global_posts: int = 50) -> DataFrame:
    """C3 (A11, J9, J10, X10, F8, W4): per cluster the k tags of highest log-lift.

    lift = (cluster_tag_posts / cluster_posts) / (global_posts / N) with N = all filtered posts,
    while the counts come from clustered posts only; duplicates inside a post count."""
    tl = filtered.select("post_id", F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull() & (F.col("tag") != ""))
    tl = tl.join(pc.select("post_id", "cluster_id"), "post_id")
    total = row_count(filtered)
    cluster_posts = pc.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_posts"))
    cluster_tag = tl.groupBy("cluster_id", "tag").agg(F.count(F.lit(1)).alias("cluster_tag_posts"))
    # a tag's count over all clusters is the sum of its counts in each
    lf = (cluster_tag.withColumn("global_posts", F.sum("cluster_tag_posts").over(Window.partitionBy("tag")))
                     .join(cluster_posts, "cluster_id", "left")
                     .withColumn("p_tag_given_cluster", F.col("cluster_tag_posts") / F.col("cluster_posts"))
                     .withColumn("p_tag", F.col("global_posts") / total.cast("double"))
                     .withColumn("lift", F.col("p_tag_given_cluster") / F.col("p_tag"))
                     .withColumn("log_lift", F.log(F.col("lift")))
                     .filter((F.col("cluster_tag_posts") >= min_cluster_tag_posts) & (F.col("global_posts") >= min_global_posts)))
    w = Window.partitionBy("cluster_id").orderBy(F.col("log_lift").desc(), F.col("tag").asc())
    return lf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def example_posts(pc: DataFrame, k: int = 5) -> DataFrame:
    """C4 (W5): k highest-scoring posts per cluster (ties: id asc); WindowGroupLimit keeps only k
    rows per cluster and partition before the shuffle, so a huge cluster costs no more."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return pc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cluster_example_lists(examples: DataFrame) -> DataFrame:
    """Per cluster the ordered lists top_post_ids / top_post_scores / top_post_created
    (k rows per cluster, so the collected lists are bounded by k)."""
    g = examples.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score", "created_at"))).alias("x"))
    return g.select("cluster_id", F.transform("x", lambda e: e["id"]).alias("top_post_ids"),
                    F.transform("x", lambda e: e["score"]).alias("top_post_scores"),
                    F.transform("x", lambda e: e["created_at"]).alias("top_post_created"))


def example_bundles(examples: DataFrame, filtered: DataFrame, n_tags: int = 20) -> DataFrame:
    """C5 (K10, J11): the first n_tags tags of every example post (k rows per cluster)."""
    tags20 = filtered.select(F.col("id").alias("ex_id"), F.slice("tags", 1, n_tags).alias("tags20"))
    ex = examples.select("cluster_id", "rank", F.col("id").alias("ex_id"))
    return tags20.join(ex, "ex_id", "right").select("cluster_id", "rank", F.col("ex_id").alias("id"), "tags20")


def fixed_cluster_map(vocab: DataFrame, n_clusters: int = 5) -> DataFrame:
    """cluster_id = length(tag) % n -- a detector-independent map for oracle checks."""
    return vocab.select("tag", (F.length("tag") % n_clusters).cast("bigint").alias("cluster_id"))

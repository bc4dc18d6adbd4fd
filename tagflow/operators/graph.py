"""Tag co-occurrence graph.

Plan of cooccurrence_edges, built for skewed tags (one tag may sit on most posts):
  explode tags -> broadcast join with the vocabulary (bounded by top_k) -> ONE exchange on post_id
  (uniform key) collecting each post's vocabulary tags with their frequencies -> cap to the post's
  k most frequent tags -> unordered pairs generated inside the row (at most k*(k-1)/2 per post,
  k = max_tags_per_post, the studied project's own cap), frequencies carried along -> pair count
  with map-side partial aggregation, so a hot pair is combined before the shuffle.
N (filtered posts) is a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import edge_weight
from .common import non_empty, row_count
from .counts import tag_frequency


def vocabulary(freq: DataFrame, min_freq: int, top_k: int | None) -> DataFrame:
    """F7 + K3: tags with freq >= min_freq, the top_k most frequent (ties: tag asc)."""
    v = freq.filter(F.col("freq") >= min_freq)
    if top_k is not None:
        v = v.orderBy(F.col("freq").desc(), F.col("tag").asc()).limit(int(top_k))
    return v


def capped_tag_lists(posts_with_tags: DataFrame, vocab: DataFrame, max_tags_per_post: int | None = None) -> DataFrame:
    """J1 + W1: per post, its vocabulary tags -- all, or the k most frequent (freq desc, tag asc) --
    sorted by tag as `ctags` = array<struct<tag, freq>>. Duplicates inside a post are kept (bag
    semantics). Carrying freq here spares the two frequency lookups after the pair count."""
    long = posts_with_tags.select("post_id", F.explode("tags").alias("tag"))
    per_post = long.join(vocab.select("tag", "freq"), "tag").groupBy("post_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("nf"), F.col("tag")))).alias("ranked"))
    kept = F.col("ranked") if max_tags_per_post is None else F.slice("ranked", 1, int(max_tags_per_post))
    capped = F.transform(kept, lambda x: F.struct(x["tag"].alias("tag"), (-x["nf"]).alias("freq")))
    return per_post.select("post_id", F.sort_array(capped).alias("ctags"))


def row_pairs(capped: DataFrame) -> DataFrame:
    """All pairs of a post's tags with tag_left < tag_right (equal tags never pair), with their
    frequencies. Two explodes: a row holds the tags after one tag, never a post's whole square. The
    multiset equals the same-post self-join filtered on tag_left < tag_right (J2)."""
    left = capped.select("ctags", F.posexplode("ctags").alias("at", "l"))
    both = left.select("l", F.explode(F.slice("ctags", F.col("at") + 2, F.size("ctags"))).alias("r"))
    return both.where(F.col("l.tag") < F.col("r.tag")).select(
        F.col("l.tag").alias("tag_left"), F.col("r.tag").alias("tag_right"), F.col("l.freq").alias("freq_left"),
        F.col("r.freq").alias("freq_right"))


def pair_counts(capped: DataFrame) -> DataFrame:
    """Co-occurrence count per (tag_left, tag_right); the frequencies ride along as grouping
    keys (functionally dependent on the tags)."""
    return row_pairs(capped).groupBy("tag_left", "tag_right", "freq_left", "freq_right").agg(F.count(F.lit(1)).alias("cooccur"))


def pair_counts_self_join(capped: DataFrame) -> DataFrame:
    """J2 in its plain form (same-post equi self-join + theta filter), kept for cross-checking."""
    long = capped.select("post_id", F.explode("ctags.tag").alias("tag"))
    l, r = long.alias("l"), long.alias("r")
    return (l.join(r, (F.col("l.post_id") == F.col("r.post_id")) & (F.col("l.tag") < F.col("r.tag")))
             .groupBy(F.col("l.tag").alias("tag_left"), F.col("r.tag").alias("tag_right"))
             .agg(F.count(F.lit(1)).alias("cooccur")))


def cooccurrence_edges(filtered: DataFrame, min_freq: int = 100, max_tags_per_post: int | None = None,
                       top_k_tags: int | None = None, min_cooccur: int = 10,
                       weight_method: str = "pmi") -> tuple[DataFrame, DataFrame]:
    """G1: weighted co-occurrence edges and the pruned vocabulary (tag, freq).

    N is every filtered post (also those without a vocabulary tag); frequencies are taken before
    the per-post cap (trap 8). pmi keeps weight > 0.
    """
    vocab = vocabulary(tag_frequency(filtered), min_freq, top_k_tags)
    pairs = pair_counts(capped_tag_lists(filtered, vocab, max_tags_per_post))
    edges = pairs.filter(F.col("cooccur") >= min_cooccur)
    n = row_count(filtered)
    edges = edges.withColumn("weight", edge_weight(weight_method, "cooccur", n, "freq_left", "freq_right"))
    if weight_method == "pmi":
        edges = edges.filter(F.col("weight") > 0)
    return edges.select("tag_left", "tag_right", "cooccur", "freq_left", "freq_right", "weight"), vocab


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    a = edges.select(F.col("tag_left").alias("tag"), F.col("tag_right").alias("neighbor"), "weight")
    b = edges.select(F.col("tag_right").alias("tag"), F.col("tag_left").alias("neighbor"), "weight")
    return a.unionByName(b)


def prune_links_to_vocabulary(links: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep a link only when both ends are vocabulary tags; no pruning for an empty vocabulary."""
    v = vocab.select("tag")
    va = v.select(F.col("tag"), F.lit(True).alias("_in_a"))
    vb = v.select(F.col("tag").alias("link"), F.lit(True).alias("_in_b"))
    j = links.filter(F.col("link").isNotNull()).join(va, "tag", "left").join(vb, "link", "left")
    keep = (~non_empty(vocab)) | (F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull())
    return j.filter(keep).select("tag", "link")


def merge_wiki_edges(edges: DataFrame, links: DataFrame, vocab: DataFrame, wiki_weight: float = 0.2) -> DataFrame:
    """Every directed wiki link adds wiki_weight to the undirected edge of its ends
    (a mutual pair adds twice, a self link makes a loop); co-occurrence weights carry over.
    Output canonical src <= dst."""
    pruned = prune_links_to_vocabulary(links, vocab)
    wiki = pruned.select(F.least("tag", "link").alias("src"), F.greatest("tag", "link").alias("dst"),
                         F.lit(float(wiki_weight)).alias("weight"), F.lit(0).alias("is_cooc"))
    co = edges.select(F.col("tag_left").alias("src"), F.col("tag_right").alias("dst"),
                      F.col("weight").cast("double").alias("weight"), F.lit(1).alias("is_cooc"))
    return (co.unionByName(wiki).groupBy("src", "dst")
              .agg(F.sum("weight").alias("weight"), F.max("is_cooc").alias("from_cooccurrence"),
                   F.sum(1 - F.col("is_cooc")).cast("bigint").alias("wiki_links")))


def graph_size(merged: DataFrame) -> DataFrame:
    """Nodes (distinct edge ends) and edges (one row)."""
    nodes = merged.select(F.col("src").alias("n")).unionByName(merged.select(F.col("dst").alias("n"))).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", row_count(merged))

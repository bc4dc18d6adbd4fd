"""The genre pipeline end to end, with its parquet sinks (S8) and text report.

Intermediates that later steps read several times (the analysis set, the vocabulary, the graph,
the tag -> cluster map, the post -> cluster map) are written once as parquet under the shared
checkpoint folder instead of being recomputed per consumer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import DEFAULT_BLOCKLIST, DEFAULT_STOP_TAGS
from ..operators import clusters as C
from ..operators import community as CM
from ..operators import counts as K
from ..operators import graph as G
from ..operators import links as L
from ..operators.posts import filter_posts
from ..session import materialize
from . import reports as R


@dataclass
class GenreParams:
    rating: str = "nsfw"
    remove_generic: bool = False
    min_freq: int = 50
    max_tags_per_post: int | None = None  # None: no cap
    top_k_tags: int | None = None
    min_cooccur: int = 5
    weight_method: str = "pmi"
    wiki_weight: float = 0.2
    link_mode: str = "section"
    resolution: float = 1.0
    detector: str = "leiden"           # or "louvain", "label_propagation"
    main_min_posts: int = 50


def run_genre_pipeline(spark: SparkSession, posts: DataFrame, wiki: DataFrame, params: GenreParams | None = None,
                       out_dir: str | None = None, cluster_map: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """cluster_map: vocabulary -> (tag, cluster_id), in place of a detector."""
    p = params or GenreParams()
    stop = DEFAULT_STOP_TAGS if p.remove_generic else None
    filtered = materialize(filter_posts(posts, p.rating, DEFAULT_BLOCKLIST, stop), "genre-filtered")
    links = L.see_also_links(wiki, mode=p.link_mode)
    edges, vocab = G.cooccurrence_edges(filtered, p.min_freq, p.max_tags_per_post, p.top_k_tags, p.min_cooccur,
                                        p.weight_method)
    vocab = materialize(vocab, "genre-vocab")
    edges = materialize(edges, "genre-edges")
    merged = materialize(G.merge_wiki_edges(edges, links, vocab, p.wiki_weight), "genre-graph")
    if cluster_map is not None:
        return assemble(filtered, links, edges, vocab, merged, cluster_map(vocab), p, out_dir)
    assign = {"leiden": lambda: CM.leiden(merged, p.resolution), "louvain": lambda: CM.louvain(merged, p.resolution),
              "label_propagation": lambda: CM.label_propagation(merged)}[p.detector]()
    return assemble(filtered, links, edges, vocab, merged, CM.number_clusters(assign), p, out_dir)


def assemble(filtered: DataFrame, links: DataFrame, edges: DataFrame, vocab: DataFrame, merged: DataFrame, clusters: DataFrame,
             p: GenreParams, out_dir: str | None = None) -> dict[str, DataFrame]:
    """All that follows from a tag -> cluster map (tag, cluster_id); written to out_dir if there is one."""
    tag_freq = K.tag_frequency(filtered)
    tag_clusters = materialize(clusters, "genre-clusters")
    pc = materialize(C.post_cluster(filtered, tag_clusters), "genre-post-cluster")
    metrics = C.cluster_metrics(pc, tag_clusters, vocab)
    examples = C.example_posts(pc)
    out = {
        "filtered": filtered, "tag_freq": tag_freq, "links": links, "edges": edges, "vocab": vocab,
        "graph": merged, "tag_clusters": tag_clusters, "post_cluster": pc, "metrics": metrics,
        "distinctive": C.distinctive_tags(filtered, pc),
        "example_posts": examples, "examples": C.cluster_example_lists(examples),
        "bundles": C.example_bundles(examples, filtered),
        "overview": R.run_overview(filtered, tag_freq, G.graph_size(merged), tag_clusters),
        "ranked": R.ranked_clusters(metrics, p.main_min_posts),
        "niche": R.niche_clusters(metrics, p.main_min_posts),
        "all_clusters": R.all_clusters(tag_clusters, metrics, vocab),
        "modularity": CM.modularity(merged, tag_clusters, p.resolution),
    }
    if out_dir:
        write_outputs(out, out_dir)
    return out


GENRE_COLUMNS = ["cluster_id", "num_posts", "num_unique_tags", "demand_median", "demand_top10_avg", "demand_max",
                 "demand_min", "competition", "trend_score", "opportunity"]


def write_outputs(out: dict[str, DataFrame], out_dir: str) -> None:
    """Genres / tag_clusters / cluster_examples as parquet; S11: the text report, a folder for each part."""
    out["metrics"].select(*GENRE_COLUMNS).write.mode("overwrite").parquet(f"{out_dir}/genres.parquet")
    out["tag_clusters"].write.mode("overwrite").parquet(f"{out_dir}/tag_clusters.parquet")
    out["examples"].write.mode("overwrite").parquet(f"{out_dir}/cluster_examples.parquet")
    for name, lines in report_lines(out).items():
        lines.coalesce(1).write.mode("overwrite").text(f"{out_dir}/{name}")  # 20 rows, or a row for each cluster


def report_lines(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The lines of the report: the overview, ranked and niche clusters, the ranked clusters' example posts with
    their scores and first tags (F16, C5), all clusters with their examples (J17)."""
    tags = F.array_join(F.slice("representative_tags", 1, 15), ", ")

    def ranked(df, *order):
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("tags", tags)

    main = ranked(out["ranked"], F.col("opportunity").desc(), F.col("cluster_id"))
    niche = ranked(out["niche"], F.col("demand_median").desc(), F.col("cluster_id"))
    o = F.col
    facts = F.array(*[F.concat(F.lit(f"{label}: "), o(c).cast("string")) for label, c in (
        ("posts", "posts"), ("general tags", "unique_tags"), ("graph nodes", "nodes"), ("graph edges", "edges"), ("clusters", "clusters"))])
    overview = out["overview"].select(F.explode(facts).alias("value"))
    every = out["all_clusters"].join(out["examples"].select("cluster_id", "top_post_ids"), "cluster_id", "left")
    shown = out["bundles"].join(out["example_posts"].select("cluster_id", "id", "score"), ["cluster_id", "id"]).join(
        out["ranked"].select("cluster_id"), "cluster_id", "left_semi")
    examples = shown.orderBy("cluster_id", "rank").select(F.concat(
        F.lit("Cluster "), o("cluster_id").cast("string"), F.lit(" example "), o("rank").cast("string"), F.lit(": "), o("id").cast("string"),
        F.lit(":"), o("score").cast("string"), F.lit(", tags="), F.coalesce(F.array_join("tags20", ", "), F.lit(""))).alias("value"))
    return {
        "overview": overview, "example_posts": examples,
        "genre_rank": R.render_lines(main, "#%d Cluster %d: posts=%d, unique tags=%d, median=%.2f, top10%%=%.2f, opportunity=%.2f, tags=%s",
                                     "rank", "cluster_id", "num_posts", "num_unique_tags", "demand_median", "demand_top10_avg",
                                     "opportunity", "tags"),
        "niche_rank": R.render_lines(niche, "#%d Cluster %d: posts=%d, median=%.2f, tags=%s", "rank", "cluster_id", "num_posts",
                                     "demand_median", "tags"),
        "all_clusters": every.orderBy("rank").select(F.concat(
            F.lit("#"), F.col("rank").cast("string"), F.lit(" Cluster "), F.col("cluster_id").cast("string"), F.lit(": posts="),
            F.col("num_posts").cast("string"), F.lit(", opportunity="), F.coalesce(F.round("opportunity", 2).cast("string"), F.lit("-")),
            F.lit(", tags="), tags, F.lit(", examples="),
            F.coalesce(F.array_join(F.transform("top_post_ids", lambda x: x.cast("string")), " "), F.lit("-"))).alias("value")),
    }

"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the adapters) in full. Arrays are rendered as
'|'-joined strings and doubles rounded to 9 digits so that results compare across engines;
the operators themselves return arrays and full-precision doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import parse_tag_list, split_comma_tags
from ..functions.timefmt import parse_created_lenient
from ..operators import clusters as C
from ..operators import counts as K
from ..operators import graph as G
from ..operators import links as L
from ..operators import posts as P
from ..operators import sampling as S
from ..sources import adapters
from ..operators.common import row_count
from ..session import materialize
from . import reports as R

# Run parameters: the studied project's pipeline values (rating, vocabulary and pair limits).
RATING = "nsfw"
GENERAL = ("general",)
GRAPH = dict(min_freq=50, max_tags_per_post=None, top_k_tags=None, min_cooccur=5)
CAPPED_TAGS_PER_POST = 3
VOCABULARY_MIN_FREQ, VOCABULARY_TOP_K = 400, 40   # of the queries named for them
NICHE_MIN_POSTS = 1500
PARITY_TAIL = 2000
WIKI_WEIGHT = 0.2
TOP_N = 1000
TOP_N_LARGE = 10_000
SAMPLE_SIZES = (100, 500, 1000, 1500, 5000, 1_000_000)
RANDOM_N = 1000
FIRST_N = 10_000
# Fixture lists that do occur in the test data (the project's own lists never match it).
FIXTURE_BLOCKLIST = ("old rod", "hot gear")
FIXTURE_STOP_TAGS = ("red plate",)
N_FIXED_CLUSTERS = 5

Query = Callable[[SparkSession, str], DataFrame]


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def joined(c):
    return F.array_join(F.col(c) if isinstance(c, str) else c, "|")


# ---------------------------------------------------------------- shared plan fragments
def posts(spark, d, tags=adapters.TAG_TYPES):
    return adapters.posts(spark, d, tags)


def active(spark, d, tags=adapters.TAG_TYPES):
    return P.active_posts(posts(spark, d, tags))


def filtered(spark, d):
    """The analysis set: active posts (the sampled frame) -> rating -> tags -> blocklist."""
    return P.filter_posts(active(spark, d, GENERAL), rating=RATING)


def analysis_set(spark, d):
    """filtered, written once for the plans that read it several times."""
    return materialize(filtered(spark, d).select("post_id", "id", "score", "created_at", "tags"), "filtered")


def scored(spark, d):
    return S.with_score_per_hour(active(spark, d, ()))


def graph(spark, d, method="pmi", cap=None):
    params = dict(GRAPH)
    if cap is not None:
        params["max_tags_per_post"] = cap
    f = analysis_set(spark, d)
    edges, vocab = G.cooccurrence_edges(f, weight_method=method, **params)
    return f, edges, vocab


def wiki_links(spark, d, mode="section"):
    return L.see_also_links(adapters.wiki(spark, d), mode=mode, tail_chars=PARITY_TAIL if mode == "parity" else None)


def merged(spark, d):
    f, edges, vocab = graph(spark, d)
    vocab = materialize(vocab, "vocabulary")
    m = materialize(G.merge_wiki_edges(edges, wiki_links(spark, d), vocab, WIKI_WEIGHT), "graph")
    return f, edges, vocab, m


def fixed_clusters(spark, d):
    f, edges, vocab = graph(spark, d)
    vocab = materialize(vocab, "vocabulary")
    cmap = C.fixed_cluster_map(vocab, N_FIXED_CLUSTERS)
    pc = materialize(C.post_cluster(f, cmap), "post-cluster")
    return f, vocab, cmap, pc


def metrics(spark, d):
    f, vocab, cmap, pc = fixed_clusters(spark, d)
    return f, vocab, cmap, pc, C.cluster_metrics(pc, cmap, vocab)


# ---------------------------------------------------------------- posts
def q_active_posts(spark, d):
    return active(spark, d).select("id", "created_at", "score", "rating", "general", "character",
                                   "copyright", "artist", "meta")


def q_rating_filter(spark, d):
    return P.rating_filter(active(spark, d, ()), RATING).select("id", "rating")


def q_rating_distribution(spark, d):
    return P.rating_distribution(active(spark, d, ()))


def q_filter_rate(spark, d):
    return P.filter_rate(posts(spark, d, ())).select("kept", "total", r9("rate").alias("rate"))


def q_first_n(spark, d):
    return P.first_n(posts(spark, d, ()), FIRST_N).select("id", "score")


def q_score_range(spark, d):
    return P.score_range(active(spark, d, ()))


def q_parse_tags(spark, d):
    return filtered(spark, d).select("post_id", F.size("tags").alias("n_tags"), joined("tags").alias("tags"))


def q_blocklist_filter(spark, d):
    f = P.filter_posts(active(spark, d, GENERAL), rating=RATING, blocklist=FIXTURE_BLOCKLIST)
    return f.select("post_id")


def q_blocked_count(spark, d):
    return P.blocked_count(active(spark, d, GENERAL), RATING, FIXTURE_BLOCKLIST)


def q_stop_tag_filter(spark, d):
    f = P.filter_posts(active(spark, d, GENERAL), rating=RATING, stop_tags=FIXTURE_STOP_TAGS)
    return f.select("post_id", F.size("tags").alias("n_tags"), joined("tags").alias("tags"))


def q_tag_frequency(spark, d):
    return K.tag_frequency(filtered(spark, d))


# ---------------------------------------------------------------- sampling
def q_score_per_hour(spark, d):
    return scored(spark, d).select("id", "hours_since_start", r9("score_per_hour").alias("score_per_hour"))


def q_top_n(spark, d):
    return S.top_n(scored(spark, d), TOP_N).select("id", "score", "hours_since_start",
                                                   r9("score_per_hour").alias("score_per_hour"))


def q_top_n_large(spark, d):
    """K1/K2 at a size beyond what one reducer should hold, with ranks."""
    return S.top_ranked(scored(spark, d), TOP_N_LARGE).select("id", "rank", r9("score_per_hour").alias("score_per_hour"))


def q_top_n_sizes(spark, d):
    return S.top_n_sizes(scored(spark, d), SAMPLE_SIZES).select("sample_label", "sample_size", "rank", "id")


def q_rebased_sample(spark, d):
    s = S.rebased_sample(S.top_n(scored(spark, d), TOP_N))
    return s.select("id", r9("rank_score_per_hour").alias("rank_score_per_hour"), "hours_since_start",
                    r9("score_per_hour").alias("score_per_hour"))


def q_random_n(spark, d):
    return S.random_n(active(spark, d, ()), RANDOM_N).select("id", "score")


def q_random_n_spread(spark, d):
    """K5: what makes a sample random: its size, distinct ids, no id from outside, a fair share of every tenth of
    the ids, and another set for another seed. The oracle states what must come out, not how it is drawn."""
    a = materialize(active(spark, d, ()).select("id", "score"), "active")
    one, two = S.random_n(a, RANDOM_N).select("id"), S.random_n(a, RANDOM_N, 7).select("id")
    cuts = a.select(F.percentile_approx("id", [k / 10 for k in range(1, 10)])).scalar()
    tenth = F.size(F.filter("cuts", lambda x: x < F.col("id")))
    shares = a.withColumn("cuts", cuts).join(one.withColumn("s", F.lit(1)), "id", "left").groupBy(tenth.alias("t")).agg(
        F.avg(F.coalesce("s", F.lit(0))).alias("share"))
    fair = F.least(F.lit(1.0), F.lit(RANDOM_N) / row_count(a))
    return one.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("distinct_ids")).select(
        "rows", "distinct_ids", row_count(one.join(a, "id", "left_anti")).alias("outside"),
        (shares.agg(F.max(F.abs(F.col("share") - fair))).scalar() < 0.5 * fair).alias("fair_in_every_tenth"),
        (row_count(one.join(two, "id", "left_semi")) < row_count(one) * F.lit(0.99)).alias("seeds_differ"))


def q_parse_tags_whitespace(spark, d):
    """Tabs and line breaks around tags are stripped like blanks."""
    messy = F.concat(F.lit("\n\t"), F.replace("general", F.lit(","), F.lit(" ,\t")), F.lit(" \n"))
    return active(spark, d, GENERAL).withColumn("general", messy).select(
        "id", joined(parse_tag_list("general")).alias("tags"), joined(split_comma_tags("general")).alias("comma_tags"))


def q_created_lenient(spark, d):
    """Other forms of a timestamp are read, what is none becomes null; no row fails the job."""
    c = F.col("created_at")
    forms = F.when(F.col("id") % 4 == 0, F.substring(c, 1, 10)).when(F.col("id") % 4 == 1, F.lit("no time")).when(
        F.col("id") % 4 == 2, F.concat(F.substring(c, 1, 19), F.lit("Z"))).otherwise(c)
    return active(spark, d, ()).select("id", F.unix_seconds(parse_created_lenient(forms)).alias("seconds"))


def q_sample_stats(spark, d):
    """A12, A13 for each stored sample."""
    from .sampling import sample_stats, samples

    return sample_stats(samples(posts(spark, d), SAMPLE_SIZES)).select(
        "sample_label", "rows", "min_score", "max_score", *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in "sqge"])


# ---------------------------------------------------------------- tag counts
def q_tag_counts_by_type(spark, d):
    return K.tag_counts_by_type(active(spark, d))


def q_tag_counts_all(spark, d):
    return K.tag_counts_with_all(active(spark, d))


def q_top_tags_per_type(spark, d):
    return K.top_per_type(K.tag_counts_with_all(active(spark, d)), 20).select("tag_type", "rank", "tag", "count")


def q_tag_count_stats(spark, d):
    return K.tag_count_stats(K.tag_counts_with_all(active(spark, d)))


# ---------------------------------------------------------------- graph
def q_vocabulary(spark, d):
    return G.vocabulary(K.tag_frequency(filtered(spark, d)), VOCABULARY_MIN_FREQ, None)


def q_vocabulary_top_k(spark, d):
    """K3: the most frequent tags only."""
    return G.vocabulary(K.tag_frequency(filtered(spark, d)), GRAPH["min_freq"], VOCABULARY_TOP_K)


def _edges_out(e):
    return e.select("tag_left", "tag_right", "cooccur", "freq_left", "freq_right", r9("weight").alias("weight"))


def q_cooccur_counts(spark, d):
    return _edges_out(graph(spark, d, method="count")[1])


def q_cooccur_pmi(spark, d):
    return _edges_out(graph(spark, d, method="pmi")[1])


def q_cooccur_lift(spark, d):
    return _edges_out(graph(spark, d, method="lift")[1])


def q_cooccur_capped(spark, d):
    return _edges_out(graph(spark, d, method="pmi", cap=CAPPED_TAGS_PER_POST)[1])


def q_adjacency(spark, d):
    return G.adjacency(graph(spark, d)[1]).select("tag", "neighbor", r9("weight").alias("weight"))


def q_see_also_links(spark, d):
    return wiki_links(spark, d, "section")


def q_see_also_links_parity(spark, d):
    return wiki_links(spark, d, "parity")


def q_merged_graph(spark, d):
    m = merged(spark, d)[3]
    return m.select("src", "dst", r9("weight").alias("weight"), "from_cooccurrence", "wiki_links")


def q_graph_size(spark, d):
    return G.graph_size(merged(spark, d)[3])


# ---------------------------------------------------------------- clusters
def q_post_cluster(spark, d):
    return fixed_clusters(spark, d)[3].select("post_id", "cluster_id", "tag_hits")


def _metrics_out(m):
    return m.select("cluster_id", "num_posts", "num_unique_tags", r9("demand_median").alias("demand_median"),
                    r9("demand_top10_avg").alias("demand_top10_avg"), "demand_max", "demand_min", "competition",
                    "trend_score", r9("opportunity").alias("opportunity"),
                    joined("representative_tags").alias("representative_tags"))


def q_cluster_metrics(spark, d):
    return _metrics_out(metrics(spark, d)[4])


def q_distinctive_tags(spark, d):
    f, vocab, cmap, pc = fixed_clusters(spark, d)
    return C.distinctive_tags(f, pc).select(
        "cluster_id", "rank", "tag", "cluster_tag_posts", "global_posts", r9("log_lift").alias("log_lift"))


def q_example_posts(spark, d):
    return C.example_posts(fixed_clusters(spark, d)[3]).select("cluster_id", "rank", "id", "score", "created_at")


def q_example_bundles(spark, d):
    f, vocab, cmap, pc = fixed_clusters(spark, d)
    ex = C.example_posts(pc)
    return C.example_bundles(ex, f).select(
        "cluster_id", "rank", "id", joined("tags20").alias("tags20"))


def q_ranked_clusters(spark, d):
    return _metrics_out(R.ranked_clusters(metrics(spark, d)[4]))


def q_niche_clusters(spark, d):
    return _metrics_out(R.niche_clusters(metrics(spark, d)[4], NICHE_MIN_POSTS, 2))


def q_all_clusters(spark, d):
    f, vocab, cmap, pc, m = metrics(spark, d)
    a = R.all_clusters(cmap, m, vocab)
    return a.select("rank", "cluster_id", "num_posts", r9("opportunity").alias("opportunity"),
                    joined("representative_tags").alias("representative_tags"))


def q_run_overview(spark, d):
    f, edges, vocab, m = merged(spark, d)
    cmap = C.fixed_cluster_map(vocab, N_FIXED_CLUSTERS)
    return R.run_overview(f, K.tag_frequency(f), G.graph_size(m), cmap).select(
        "posts", "unique_tags", "nodes", "edges", "clusters")


def q_cluster_examples(spark, d):
    """The cluster_examples table -- top 5 ids, scores and creation times per cluster."""
    ex = C.cluster_example_lists(C.example_posts(fixed_clusters(spark, d)[3]))
    return ex.select("cluster_id", joined(F.transform("top_post_ids", lambda x: x.cast("string"))).alias("top_post_ids"),
                     joined(F.transform("top_post_scores", lambda x: x.cast("string"))).alias("top_post_scores"),
                     joined("top_post_created").alias("top_post_created"))


def q_top_cluster_examples(spark, d):
    """F16: example posts of the top-20 ranked clusters only (left semi join)."""
    f, vocab, cmap, pc, m = metrics(spark, d)
    top = R.ranked_clusters(m).select("cluster_id")
    return C.example_posts(pc).join(top, "cluster_id", "left_semi").select("cluster_id", "rank", "id", "score")


def q_tag_trend(spark, d):
    """Monthly usage of every general tag of the analysis set."""
    f = filtered(spark, d)
    return (f.select(F.substring("created_at", 1, 7).alias("month"), F.explode("tags").alias("tag"))
             .groupBy("month", "tag").agg(F.count(F.lit(1)).alias("uses")))


def q_tag_phi(spark, d):
    """Phi coefficient of every counted pair from its 2x2 table (N = analysis posts)."""
    f, edges, vocab = graph(spark, d, method="count")
    n = row_count(f).cast("double")
    a, fl, fr = F.col("cooccur").cast("double"), F.col("freq_left").cast("double"), F.col("freq_right").cast("double")
    phi = (a * n - fl * fr) / F.sqrt(fl * fr * (n - fl) * (n - fr))
    return edges.select("tag_left", "tag_right", "cooccur", r9(phi).alias("phi"))


def q_post_tag_bridge(spark, d):
    """Post_Tags bridge table (post_id, position, tag) of the analysis set."""
    return filtered(spark, d).select("post_id", F.posexplode("tags").alias("position", "tag"))


def q_column_profile(spark, d):
    """One-row profile of the posts table."""
    p = posts(spark, d)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in adapters.TAG_TYPES:
        aggs.append(F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(f"null_{c}"))
    aggs += [F.min("score").alias("min_score"), F.max("score").alias("max_score"),
             F.round(F.avg("score"), 9).alias("avg_score"), F.count_distinct("rating").alias("ratings"),
             F.round(F.avg(F.col("is_deleted").cast("double")), 9).alias("deleted_share"),
             F.round(F.avg(F.col("is_banned").cast("double")), 9).alias("banned_share")]
    return p.agg(*aggs)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

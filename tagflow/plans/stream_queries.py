"""Registered streaming and graph-community queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import community as CM
from ..operators.common import row_count
from ..session import materialize
from ..sources import adapters
from ..streaming import ingest as ST
from . import queries as Q


FILES = 3


def q_incremental_ingest(spark, d):
    """Posts staged as files, drained three files a micro-batch into a parquet sink."""
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("src", "ingest", "ck"))
    ST.stage_post_files(adapters.posts(spark, d), src)
    ST.ingest_active(spark, src, sink, ck, FILES)
    return spark.read.parquet(sink)


def q_streaming_tag_counts(spark, d):
    """Maintained tag counts over the same file stream (final state)."""
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("src", "counts", "ck"))
    ST.stage_post_files(adapters.posts(spark, d), src)
    ST.maintain_tag_counts(spark, src, sink, ck, FILES)
    return ST.read_tag_counts(spark, sink)


def _graph_edges(spark, d):
    f, edges, vocab, m = Q.merged(spark, d)
    return vocab, m


def q_modularity_fixed(spark, d):
    """G6 for the detector-independent map (length(tag) % 5) on the merged graph."""
    vocab, m = _graph_edges(spark, d)
    cmap = C.fixed_cluster_map(vocab, Q.N_FIXED_CLUSTERS)
    return CM.modularity(m, cmap).select(F.round("modularity", 9).alias("modularity"), "communities",
                                         F.round("total_weight", 9).alias("total_weight"))


def q_communities_louvain(spark, d):
    """G5 + G7 (rows-only check; the invariants have a query of their own)."""
    vocab, m = _graph_edges(spark, d)
    return CM.number_clusters(CM.louvain(m))


def q_communities_leiden(spark, d):
    """G5 + G7 with the refinement phase, the studied project's own solver."""
    vocab, m = _graph_edges(spark, d)
    return CM.number_clusters(CM.leiden(m))


def q_communities_lp(spark, d):
    vocab, m = _graph_edges(spark, d)
    return CM.number_clusters(CM.label_propagation(m))


def _invariants(m, assigned, unsettled):
    """What any community detection must give: each node of the graph once, connected communities, a
    modularity no lower than that of the fixed map, cluster ids by size, then first tag, and a certificate: the
    nodes that would still move (unsettled, from (node, comm))."""
    found = materialize(CM.number_clusters(assigned), "communities")
    memb = found.select(F.col("tag").alias("node"), F.col("cluster_id").alias("comm"))
    nodes = m.select(F.col("src").alias("tag")).union(m.select("dst")).distinct()
    parts = CM.split_disconnected(m.select("src", "dst", "weight"), memb)
    fixed = CM.modularity(m, C.fixed_cluster_map(nodes, Q.N_FIXED_CLUSTERS)).select("modularity").scalar()
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min("tag").alias("first_tag"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "first_tag")) - 1)
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("tag").alias("distinct_nodes")).select(
        "nodes", "distinct_nodes", row_count(nodes.join(found, "tag", "left_anti")).alias("missing"),
        (row_count(parts.select("comm").distinct()) == row_count(sizes)).alias("connected"),
        (CM.modularity(m, found).select("modularity").scalar() >= fixed - F.lit(1e-9)).alias("no_worse_than_fixed"),
        (row_count(ranked.where(F.col("rank") != F.col("cluster_id"))) == 0).alias("numbered"),
        row_count(unsettled(m, memb.withColumn("comm", F.col("comm").cast("string")))).alias("unsettled"))


def _merged_table(spark, d):
    return materialize(_graph_edges(spark, d)[1], "merged")


def q_communities_louvain_invariants(spark, d):
    m = _merged_table(spark, d)
    return _invariants(m, CM.louvain(m), CM.unsettled)


def q_communities_leiden_invariants(spark, d):
    """Also: a modularity no lower than Louvain's."""
    m = _merged_table(spark, d)
    found = materialize(CM.leiden(m), "leiden")
    quality = [CM.modularity(m, x, comm_col="comm").select("modularity").scalar() for x in (found, materialize(CM.louvain(m), "louvain"))]
    return _invariants(m, found, CM.unsettled).withColumn("no_worse_than_louvain", quality[0] >= quality[1] - F.lit(1e-9))


def q_communities_lp_invariants(spark, d):
    """Label propagation doesn't maximise modularity; the rest must hold, and every node carries its heaviest label."""
    m = _merged_table(spark, d)
    return _invariants(m, CM.label_propagation(m), CM.unsettled_labels).drop("no_worse_than_fixed")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

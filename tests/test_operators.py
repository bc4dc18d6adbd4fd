"""Invariants and micro fixtures of the analytic operators."""

from pyspark.sql import functions as F

from tagflow.operators import clusters as C
from tagflow.operators import community as CM
from tagflow.operators import graph as G
from tagflow.operators import sampling as S
from tagflow.operators.posts import filter_posts, active_posts
from tagflow.sources import adapters
from tests.conftest import SMALL


def test_row_pairs_equal_self_join(spark):
    f = filter_posts(active_posts(adapters.posts(spark, SMALL)))
    vocab = G.vocabulary(G.tag_frequency(f), 1, None)
    capped = G.capped_tag_lists(f, vocab)
    cols = ["tag_left", "tag_right", "cooccur"]
    a = sorted(tuple(r) for r in G.pair_counts(capped).select(*cols).collect())
    b = sorted(tuple(r) for r in G.pair_counts_self_join(capped).select(*cols).collect())
    assert a == b and len(a) > 0


def test_pmi_edges_positive(spark):
    f = filter_posts(active_posts(adapters.posts(spark, SMALL)))
    edges, vocab = G.cooccurrence_edges(f, min_freq=5, top_k_tags=100, min_cooccur=2)
    assert edges.filter(F.col("weight") <= 0).count() == 0


def test_wiki_merge_weights(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "tag_left string, tag_right string, weight double")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("a", "z")], "tag string, link string")
    vocab = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "tag string, freq long")
    m = {(r["src"], r["dst"]): r["weight"] for r in G.merge_wiki_edges(edges, links, vocab, 0.2).collect()}
    assert abs(m[("a", "b")] - 1.4) < 1e-9 and abs(m[("c", "c")] - 0.2) < 1e-9 and ("a", "z") not in m


def test_quantile_fixture(spark):
    pc = spark.createDataFrame([(i, 0, s) for i, s in enumerate([1, 2, 3, 4])], "post_id long, cluster_id long, score long")
    cmap = spark.createDataFrame([("t", 0)], "tag string, cluster_id long")
    vocab = spark.createDataFrame([("t", 1)], "tag string, freq long")
    r = C.cluster_metrics(pc, cmap, vocab).collect()[0]
    assert r["demand_median"] == 2.5 and r["q90"] == 4 and r["demand_top10_avg"] == 4.0


def test_top_n_tie_keeps_smaller_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.5)], "id long, score_per_hour double")
    assert [r["id"] for r in S.top_n(df, 1).collect()] == [1]


def test_communities_two_cliques(spark):
    rows = []
    for grp in ("a", "b"):
        for i in range(5):
            for j in range(i + 1, 5):
                rows.append((f"{grp}{i}", f"{grp}{j}", 1.0))
    rows.append(("a0", "b0", 0.1))
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    for algo in (CM.louvain, CM.leiden, CM.label_propagation):
        cl = {r["tag"]: r["cluster_id"] for r in CM.number_clusters(algo(e)).collect()}
        assert len({cl[f"a{i}"] for i in range(5)}) == 1 and len({cl[f"b{i}"] for i in range(5)}) == 1
        assert cl["a0"] != cl["b0"]
    q = CM.modularity(e, CM.number_clusters(CM.louvain(e))).collect()[0]["modularity"]
    assert abs(q - 0.495025) < 1e-5


def test_stream_restart_equals_one_run(spark):
    from tagflow.streaming import ingest as ST
    posts = adapters.posts(spark, SMALL)
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("t-src", "t-sink", "t-ck"))
    ST.stage_post_files(posts.filter(F.col("id") % 2 == 0), src)
    ST.ingest_active(spark, src, sink, ck)
    first = spark.read.parquet(sink).count()
    ST.stage_post_files(posts.filter(F.col("id") % 2 == 1), src)
    ST.ingest_active(spark, src, sink, ck)                   # restart from the checkpoint
    got = sorted(r["id"] for r in spark.read.parquet(sink).select("id").collect())
    want = sorted(r["id"] for r in active_posts(posts).select("id").collect())
    assert 0 < first < len(got) and got == want


def test_components_of_a_long_path(spark):
    from tagflow.operators.community import split_disconnected

    edges = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(70)], "src string, dst string, weight double")
    memb = spark.createDataFrame([(f"n{k:03d}", "all") for k in range(71)], "node string, comm string")
    assert {r["comm"] for r in split_disconnected(edges, memb).collect()} == {"n000"}


def test_seeds_draw_different_samples(spark):
    from tagflow.operators.sampling import random_n

    ids = spark.range(150_000).select("id")
    one, two = ({r["id"] for r in random_n(ids, 1000, seed).collect()} for seed in (42, 7))
    assert len(one) == len(two) == 1000 and len(one & two) < 50
    assert sum(i < 75_000 for i in one) in range(400, 601)


def test_sample_labels(spark):
    from tagflow.operators.sampling import sample_label, top_n_sizes

    df = spark.createDataFrame([(n,) for n in (100, 500, 1000, 1500, 500_000, 1_500_000, 2_000_000)], "n long")
    assert [r[0] for r in df.orderBy("n").select(sample_label(F.col("n"))).collect()] == [
        "top100", "top500", "top1k", "top1500", "top500k", "top1500k", "top2m"]
    scored = spark.range(30).select("id", F.col("id").cast("double").alias("score_per_hour"))
    rows = top_n_sizes(scored, [5, 30, 31]).collect()
    assert len(rows) == 35 and {r["rank"] for r in rows if r["sample_size"] == 5} == set(range(1, 6))
    assert [r["id"] for r in rows if r["sample_size"] == 5 and r["rank"] == 1] == [29]
    assert top_n_sizes(scored, [99]).count() == 0


def test_state_is_deleted_on_request(spark):
    import os
    from urllib.parse import urlparse

    from tagflow.session import drop_state, materialize, state_path

    path = state_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert path in spark.sparkContext._tagflow_states and os.path.exists(urlparse(path).path)
    drop_state(spark, path)
    assert path not in spark.sparkContext._tagflow_states and not os.path.exists(urlparse(path).path)
    assert materialize(spark.range(3)).count() == 3


def test_first_rows_by_threshold(spark):
    """Against a plain sort: ties by the further order, nulls last, sizes around the number of rows, skewed leads."""
    import random

    from tagflow.operators.common import first_rows

    rng = random.Random(3)
    for leads in ([rng.random() for _ in range(3000)], [1.0] * 2500 + [rng.random() for _ in range(500)], [None] * 400 + [float(k) for k in range(50)], []):
        rows = list(enumerate(leads))
        df = spark.createDataFrame(rows, "id long, v double").repartition(5)
        for n in (0, 1, 49, 60, 1000, 5000):
            got, total = first_rows(df, F.col("v"), [F.col("v").asc_nulls_last(), F.col("id").desc()], n, "place")
            want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))[:n]
            assert total == len(rows)
            assert sorted((r["place"], r["id"]) for r in got.collect()) == [(k, r[0]) for k, r in enumerate(want)]


def test_few_rows_are_ranked(spark):
    """Of 200,000 rows the 100 first are cut off by value; what is written to be ranked is a small part."""
    from tagflow.operators import common

    df = spark.range(200_000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double"))
    written = []
    plain = common.numbered

    def spy(some, order, name):
        written.append(some.count())
        return plain(some, order, name)

    common.numbered = spy
    try:
        got, _ = common.first_rows(df, F.col("v"), [F.col("v"), F.col("id")], 100, "place")
    finally:
        common.numbered = plain
    assert 100 <= written[0] <= 1000
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in df.orderBy("v", "id").limit(100).collect())

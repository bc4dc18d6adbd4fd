"""End-to-end plans with their sinks."""

import json
import tempfile

from pyspark.sql import functions as F

from tagflow.operators import clusters as C
from tagflow.operators import hierarchy as H
from tagflow.plans import genre, hierarchy_run, sampling
from tagflow.sources import adapters
from tests.conftest import SMALL


def test_genre_pipeline_invariants_and_sinks(spark):
    out_dir = tempfile.mkdtemp(prefix="tagflow-test-genre-")
    params = genre.GenreParams(min_freq=5, top_k_tags=200, min_cooccur=2, detector="label_propagation")
    out = genre.run_genre_pipeline(spark, adapters.posts(spark, SMALL), adapters.wiki(spark, SMALL), params, out_dir)
    pc, m, tc = out["post_cluster"], out["metrics"], out["tag_clusters"]
    assert m.agg(F.sum("num_posts")).collect()[0][0] == pc.count()
    assert tc.groupBy("tag").count().filter("count > 1").count() == 0
    nodes = out["graph"].select(F.col("src").alias("tag")).union(out["graph"].select("dst")).distinct()
    assert nodes.join(tc, "tag", "left_anti").count() == 0
    assert spark.read.parquet(f"{out_dir}/genres.parquet").count() == m.count()
    assert spark.read.text(f"{out_dir}/genre_rank").count() == out["ranked"].count()
    lines = [r["value"] for r in spark.read.text(f"{out_dir}/all_clusters").collect()]
    assert len(lines) == out["all_clusters"].count() and lines[0].startswith("#1 Cluster ") and "examples=" in lines[0]
    assert spark.read.text(f"{out_dir}/niche_rank").count() == out["niche"].count()
    # before the noise floor: sum_c cluster_posts * lift(c, t) = N for every tag
    n = out["filtered"].count()
    lifts = C.distinctive_tags(out["filtered"], pc, k=10**6, min_cluster_tag_posts=0, min_global_posts=0)
    sums = lifts.groupBy("tag").agg(F.sum(F.col("cluster_posts") * F.col("lift")).alias("s")).collect()
    assert sums and all(abs(r["s"] - n) < 1e-6 * n for r in sums)
    q = out["modularity"].collect()[0]["modularity"]
    assert q is not None and -0.5 <= q <= 1.0


def test_samples_per_label(spark):
    out_dir = tempfile.mkdtemp(prefix="tagflow-test-samples-")
    s = sampling.samples(adapters.posts(spark, SMALL), [1000, 10**9])          # the larger size is skipped
    labels = {r["sample_label"]: r["count"] for r in s.groupBy("sample_label").count().collect()}
    assert labels == {"top1k": 1000}
    assert s.filter(F.col("score_per_hour") < F.col("rank_score_per_hour") - 1e-12).count() == 0
    sampling.write_samples(s, out_dir)
    assert spark.read.parquet(f"{out_dir}/samples").count() == s.count()
    r = sampling.samples(adapters.posts(spark, SMALL), [50], method="random")
    assert r.count() == 50


def test_hierarchy_run_roundtrip(spark):
    start = '<h4>Garden</h4><ul><li><a href="/wiki_pages/roses">Tag group:Roses</a></li><li>Beds</li><ul><li>herbs</li></ul></ul>'
    roses = '<ul><li><a href="/r1">Tea Rose</a></li><li><a href="/r2">tea rose</a></li></ul>'
    pages = spark.createDataFrame([(0, "start", start), (1, "https://wiki.example.org/posts?tags=roses", roses)],
                                  "page_id long, url string, html string")
    res = hierarchy_run.run_hierarchy(pages, "start", H.default_config())
    names = {r["name"] for r in res["items"].collect()}
    assert {"garden", "tag group:roses", "beds", "herbs", "tea rose"} <= names
    assert res["removed_duplicates"].count() == 1
    stats = res["statistics"].collect()[0]
    assert stats["total_followable_items"] == 1 and stats["removed_duplicates"] == 1
    out_dir = tempfile.mkdtemp(prefix="tagflow-test-hier-")
    hierarchy_run.write_result(res, out_dir)
    back = hierarchy_run.read_items(spark, f"{out_dir}/items")
    assert back.count() == res["items"].count()
    doc = {"normalized_data": {"items": {"a": {"name": "a", "url": None, "path": ["x", "a"], "parent": "x", "depth": 2,
                                               "has_nested_list": False, "classification": "final_tag_only",
                                               "should_follow": False}}}}
    p = f"{out_dir}/doc.json"
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    rows = hierarchy_run.read_nested_result(spark, p).collect()
    assert rows[0]["name"] == "a" and rows[0]["path"] == ["x", "a"]

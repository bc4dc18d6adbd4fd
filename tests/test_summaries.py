"""Cycles, stored sketches, compacted counts, nested documents, SQL statements, trait swaps."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tagflow.operators import hierarchy as H
from tagflow.operators import profile as PR
from tagflow.operators import traits as TR
from tagflow.operators.cycles import find_cycles
from tagflow.plans import hierarchy_run
from tagflow.sources import adapters
from tagflow.streaming import ingest as ST
from tests.conftest import SMALL


def plain_cycles(links):
    parent = {}
    for child, up in links:
        if child is not None and up is not None:
            parent[child] = min(up, parent.get(child, up))
    out = set()
    for start in parent:
        seen, at = [start], parent[start]
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at == start:
            out.add((min(seen), start, parent[start], len(seen)))
    return out


def test_cycles_of_random_parents(spark):
    rng = random.Random(1)
    for n, share in ((0, 0), (30, 0.9), (200, 1.0), (60, 0.3)):
        links = [(f"n{k:03d}", f"n{rng.randrange(n):03d}" if rng.random() < share else None) for k in range(n)]
        links += [("self", "self"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "z"), (None, "a")] if n else []
        found = {tuple(r) for r in find_cycles(spark.createDataFrame(links, "name string, parent string")).select("cycle", "node", "parent", "length").collect()}
        assert found == plain_cycles(links)


def test_a_long_chain_has_no_cycle(spark):
    links = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(300)]
    assert find_cycles(spark.createDataFrame(links, "name string, parent string")).collect() == []


def test_merged_sketches_equal_the_sketch_of_all(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 700).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    columns, numbers = ["id", "v", "s"], ["id", "v"]
    parts = PR.merged_profile(PR.sketched(df, (F.col("id") % 9).cast("string"), columns, numbers))
    got = {r["column"]: r for r in parts.collect()}
    for c, distinct in (("id", 20_000), ("v", 700), ("s", 13_333)):
        assert abs(got[c]["distinct"] - distinct) <= PR.DISTINCT_ERROR * distinct and got[c]["rows"] == 20_000
    assert got["s"]["nulls"] == 6667 and got["s"]["quantiles"] is None
    for c, top in (("id", 20_000), ("v", 700)):
        assert all(abs(q / top - s) <= PR.RANK_ERROR + 1 / top for q, s in zip(got[c]["quantiles"], (0.5, 0.9)))
    assert PR.merged_profile(PR.sketched(df.limit(0), F.lit("x"), columns, numbers)).collect() == []


def test_compaction_keeps_the_counts_and_drops_old_epochs(spark):
    posts = adapters.posts(spark, SMALL)
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("c-src", "c-sink", "c-ck"))
    wanted = {}
    for k in range(3):
        ST.stage_post_files(posts.where(F.col("id") % 3 == k), src)
        ST.maintain_tag_counts(spark, src, sink, ck, 2, snapshot_every=2)
        whole = posts.where(F.col("id") % 3 <= k)
        plain, sink2, ck2 = ST.shared_dir(spark, "p-src"), ST.shared_dir(spark, "p-sink"), ST.shared_dir(spark, "p-ck")
        ST.stage_post_files(whole, plain)
        ST.maintain_tag_counts(spark, plain, sink2, ck2, None, None)
        wanted = {tuple(r) for r in ST.read_tag_counts(spark, sink2).collect()}
        assert {tuple(r) for r in ST.read_tag_counts(spark, sink).collect()} == wanted
    snapshots = [e for e, _ in ST._snapshots(spark, sink)]
    assert len(set(snapshots)) == 2 and all(e > min(snapshots) for e, _ in ST._deltas(spark, sink))
    # a snapshot that a failed batch left without its marker doesn't count; compaction done again changes nothing
    spark.createDataFrame([("x", "y", 1)], "tag string, tag_type string, count long").write.parquet(f"{sink}/snapshot=999/half")
    ST._delete(spark, f"{sink}/snapshot=999/half/_SUCCESS")
    ST.compact_tag_counts(spark, sink, max(snapshots))
    assert {tuple(r) for r in ST.read_tag_counts(spark, sink).collect()} == wanted


def test_failed_batch_is_retried(spark, monkeypatch):
    """A batch that fails after its delta was written, before its snapshot: the next run gives the same rows."""
    posts = adapters.posts(spark, SMALL)
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("f-src", "f-sink", "f-ck"))
    ST.stage_post_files(posts, src)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ST, "compact_tag_counts", broken)
        with pytest.raises(Exception, match="lost"):
            ST.maintain_tag_counts(spark, src, sink, ck, 2, snapshot_every=1)
    ST.maintain_tag_counts(spark, src, sink, ck, 2, snapshot_every=1)
    from tagflow.operators.counts import long_tags
    from tagflow.operators.posts import active_posts
    plain = {(r["tag"], r["tag_type"], r["count"]) for r in long_tags(active_posts(posts)).groupBy("tag", "tag_type").count().collect()}
    assert {(r["tag"], r["tag_type"], r["count"]) for r in ST.read_tag_counts(spark, sink).collect()} == plain


def _posts_of_tags(spark, n):
    return spark.range(n).select(
        "id", F.lit("2020-01-01T00:00:00.000+00:00").alias("created_at"), F.lit(5).cast("long").alias("score"), F.lit("g").alias("rating"),
        (F.col("id") % 10 == 0).alias("is_deleted"), F.lit(False).alias("is_banned"), F.concat(F.lit("a,b"), F.col("id") % 7).alias("general"),
        *[F.lit(None).cast("string").alias(c) for c in ("character", "copyright", "artist", "meta")])


def test_batches_go_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    """Files and state partitions don't multiply with the shuffle partitions; more rows give more files, none is lost."""
    n, width = 1000, max(12, spark.sparkContext.defaultParallelism)
    posts = _posts_of_tags(spark, n)
    few, many, sink, ck = (ST.shared_dir(spark, x) for x in ("b-few", "b-many", "b-sink", "b-ck"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ST.stage_post_files(posts, few)
        assert len(ST._folders(spark, f"{few}/*.parquet")) == width
        monkeypatch.setattr(ST, "FILE_ROWS", 100)
        ST.stage_post_files(posts, many)
        sizes = [r["n"] for r in spark.read.parquet(many).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) <= 100 and sum(sizes) == n and len(sizes) <= n / 100 + width
        ST.maintain_tag_counts(spark, few, sink, ck, 1, 2)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        assert len(ST._folders(spark, f"{ck}/commits/[0-9]*")) == width
        assert len(ST._folders(spark, f"{ck}/state/0/[0-9]*")) == width
        got = {(r["tag"], r["tag_type"], r["count"]) for r in ST.read_tag_counts(spark, sink).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = [k for k in range(n) if k % 10]
    assert got == {("a", "general", len(kept))} | {(f"b{m}", "general", sum(k % 7 == m for k in kept)) for m in range(7)}


def test_one_staged_file_is_read_by_several_tasks(spark):
    """A batch of one file isn't one task: the file has row groups of a bounded size."""
    long = F.concat_ws(",", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 512) for k in "abcd"])
    path = ST.shared_dir(spark, "g-src")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ST.stage_post_files(_posts_of_tags(spark, 60_000).withColumn("general", long), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = ST._folders(spark, f"{path}/*.parquet")
    assert len(files) == 1
    parts = [r["n"] for r in spark.read.parquet(path).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) >= 3 and sum(parts) == 60_000


def test_nested_documents_of_any_shape(spark):
    folder = tempfile.mkdtemp(prefix="tagflow-test-nested-")
    docs = [{"normalized_data": {"items": {"a": {"name": "a", "path": ["x", "a"], "depth": 2, "classification": "c", "more": {"z": 1}},
                                           "b.c": {"name": "b.c", "url": "/u", "parent": None, "has_nested_list": True, "depth": 1}}}},
            {"normalized_data": {"items": {}}}, {"other": 1}]
    for n, doc in enumerate(docs):
        with open(f"{folder}/{n}.json", "w") as f:
            json.dump(doc, f, indent=1)
    rows = {r["name"]: r for r in hierarchy_run.read_nested_result(spark, folder).collect()}
    assert set(rows) == {"a", "b.c"}
    assert rows["a"]["path"] == ["x", "a"] and rows["a"]["url"] is None and rows["b.c"]["has_nested_list"] is True


def test_sql_statements_take_any_term(spark):
    items = spark.createDataFrame([("a", ["Body's \"x\"", "a"], 2, "final_tag_only"), ("b", ["b"], 1, "tag_group_only"), ("c", ["b", "c"], 2, "nothing")],
                                  "name string, path array<string>, depth int, classification string")
    for term in ("body's \"", "b", "%", "none"):
        plain, by_sql = H.items_under_path(items, term), H.items_under_path_sql(items, term)
        for one, other in zip(plain, by_sql):
            assert one.collect() == other.collect()


def test_traits_keep_the_bag(spark):
    posts = spark.createDataFrame([(1, ["red cup", "old pan", "red cup", "red lid"]), (2, []), (3, None)], "post_id long, tags array<string>")
    categories = spark.createDataFrame([(t, *t.split(" ")) for t in ("red cup", "red lid", "hot cup", "old pan")], "tag string, category string, trait string")
    got = {r["post_id"]: (r["tags"], r["n_swapped"]) for r in TR.swap_traits(posts, TR.counterparts(categories, "red", "hot")).collect()}
    assert got == {1: (["hot cup", "old pan", "hot cup", "red lid"], 2), 2: ([], 0), 3: ([], 0)}


def test_joins_of_the_bucketed_layout_need_no_exchange(spark):
    from tagflow.plans import relational as RL
    from tagflow.session import state_path

    posts = spark.createDataFrame([(k, k % 7, "q", "2024", [f"t{k % 5}", f"t{k % 3}"]) for k in range(200)],
                                  "post_id long, score long, rating string, created_at string, tags array<string>")
    wiki = spark.createDataFrame([(k, f"t{k}", None if k % 2 else f"t{k}", "b", [f"o{k}"]) for k in range(6)],
                                 "id long, title string, tag string, body string, other_names array<string>")
    names = RL.write_bucketed(RL.normalised_tables(posts, wiki), state_path(spark, "relational"), 4)
    t = {k: spark.table(n) for k, n in names.items()}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        one, two = RL.post_summaries(t["posts"], t["post_tags"]), RL.tag_pages(t["tags"], t["wiki_pages"], t["wiki_other_names"])
        assert one.count() == 200 and {r["tag"]: r["other_names"] for r in two.collect()} == {f"t{k}": 1 for k in range(5)}
        for df in (one, two):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set(key, before)
        RL.drop_bucketed(spark, names)

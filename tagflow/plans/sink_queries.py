"""Registered queries that write a job's files and read them back, and those over stored summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hierarchy as HX
from ..operators import clusters as C
from ..operators import hierarchy as H
from ..operators import posts as P
from ..operators import profile as PR
from ..operators import traits as TR
from ..operators.common import row_count
from ..operators.cycles import find_cycles
from ..session import materialize, state_path
from ..sources import adapters
from ..streaming import ingest as ST
from . import genre, hierarchy_run, relational, sampling
from . import hierarchy_queries as HQ
from . import queries as Q
from . import reports as R

WRITTEN_SIZES = (100, 1000)
WIDE_TERM = "brand#"            # more items than the list shows
IGNORED = ["brand#1"]           # elements of the site's pages to ignore
TRAITS = ("red", "hot")         # categories to swap: first words of general tags
FEW_CLUSTERS = 2
SNAPSHOT_EVERY = 3


# ------------------------------------------------------------------ samples and counts
def q_samples_written(spark, d):
    """The samples of two sizes as written, a folder for each label."""
    out = state_path(spark, "samples")
    sampling.write_samples(sampling.samples(Q.posts(spark, d), WRITTEN_SIZES), out)
    back = spark.read.parquet(f"{out}/samples")
    return back.select("sample_label", "id", "rank", "hours_since_start", Q.r9("score_per_hour").alias("score_per_hour"))


def q_tag_counts_written(spark, d):
    """Tag counts as written, partitioned by type."""
    out = state_path(spark, "tag-counts")
    sampling.write_tag_counts(Q.active(spark, d), out)
    return spark.read.parquet(f"{out}/tag_counts").select("tag", "tag_type", "count")


# ------------------------------------------------------------------ genre pipeline
def _genre_folder(spark, d):
    out = state_path(spark, "genre")
    genre.run_genre_pipeline(spark, Q.active(spark, d, Q.GENERAL), adapters.wiki(spark, d), out_dir=out,
                             cluster_map=lambda vocab: C.fixed_cluster_map(vocab, Q.N_FIXED_CLUSTERS))
    return out


def q_genre_tables(spark, d):
    """Genres, tag_clusters and cluster_examples as written."""
    out = _genre_folder(spark, d)
    tags = spark.read.parquet(f"{out}/tag_clusters.parquet").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("member_tags"))
    examples = spark.read.parquet(f"{out}/cluster_examples.parquet").select(
        "cluster_id", Q.joined(F.transform("top_post_ids", lambda x: x.cast("string"))).alias("top_post_ids"))
    return (spark.read.parquet(f"{out}/genres.parquet").join(tags, "cluster_id", "left").join(examples, "cluster_id", "left")
            .select("cluster_id", "num_posts", "num_unique_tags", Q.r9("demand_median").alias("demand_median"),
                    Q.r9("opportunity").alias("opportunity"), "member_tags", "top_post_ids"))


def q_report_lines(spark, d):
    """The overview and the example posts with their tag bundles, lines of the report as written."""
    out = _genre_folder(spark, d)
    return spark.read.text(f"{out}/overview").select(F.lit("overview").alias("part"), F.col("value").alias("line")).unionByName(
        spark.read.text(f"{out}/example_posts").select(F.lit("example_posts").alias("part"), F.col("value").alias("line")))


def q_few_cluster_examples(spark, d):
    """F16: example posts of fewer clusters than there are."""
    f, vocab, cmap, pc, m = Q.metrics(spark, d)
    top = R.ranked_clusters(m, k=FEW_CLUSTERS).select("cluster_id")
    return C.example_posts(pc).join(top, "cluster_id", "left_semi").select("cluster_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


def q_rating_filter_values(spark, d):
    """posts that pass the filters 'safe', 'nsfw' and one it doesn't know."""
    a = materialize(Q.active(spark, d, ()).select("id", "rating"), "ratings")
    parts = [P.rating_filter(a, r).agg(F.count(F.lit(1)).alias("posts")).select(F.lit(r).alias("filter"), "posts") for r in ("safe", "nsfw", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ hierarchy
def q_hierarchy_run_written(spark, d):
    """A run over the site, its raw items as written (JSON lines) and read back."""
    out = state_path(spark, "hierarchy-run")
    hierarchy_run.write_result(hierarchy_run.run_hierarchy(HQ.site(spark, d), "index", HQ.SITE_CFG), out)
    return hierarchy_run.read_items(spark, f"{out}/raw_items").select("name", HQ.pj().alias("path"), "classification", "depth")


def q_nested_json_items(spark, d):
    """The items as nested documents, written, read as VARIANT and exploded by key."""
    out = state_path(spark, "nested-json")
    hierarchy_run.write_nested_result(HQ.consolidated(spark, d), out)
    back = hierarchy_run.read_nested_result(spark, out)
    return back.select("name", "url", HX.join_path("path").alias("path"), "parent", "depth", "has_nested_list", "classification", "should_follow")


def q_items_under_path_sql(spark, d):
    """The listing statement as SQL, for a term with more items than it lists."""
    return H.items_under_path_sql(HQ.consolidated(spark, d), WIDE_TERM)[1]


def q_items_under_path_sql_count(spark, d):
    return H.items_under_path_sql(HQ.consolidated(spark, d), WIDE_TERM)[0]


def _ignoring(spark, d):
    return H.page_nodes(HQ.site(spark, d), H.default_config(ignore_elements=IGNORED))


def q_ignored_items(spark, d):
    """list items and ignored elements of each page; what stands in an ignored item's own list goes with it."""
    return _ignoring(spark, d).where(F.col("kind").isin("item", "ignored")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("rows"))


def q_ignored_log(spark, d):
    """Ignored elements whose text lower-casing changes."""
    log = H.text_log(_ignoring(spark, d).where(F.col("kind") == "ignored"), "ignored_element")
    return log.groupBy("source", "original", "normalized").agg(F.count(F.lit(1)).alias("rows"))


def q_tag_group_base_names(spark, d):
    """Candidate base names, of names with tabs and line breaks around them too."""
    names = HQ.normalised(spark, d).where(F.col("name").startswith(HX.GROUP_PREFIX)).select(F.substring_index("name", ":", -1).alias("x"))
    planted = names.select(F.explode(F.array(
        F.concat(F.lit("tag group:"), "x"), F.concat(F.lit("tag group:\t"), "x", F.lit(" tags \n")), F.concat(F.lit("tag group: \r"), "x", F.lit(" tags")))).alias("name"))
    base, alt = HX.group_base_names("name")
    return planted.select("name", base.alias("base"), alt.alias("alt"))


def q_hierarchy_cycles(spark, d):
    """Cycles among parents; some are planted: the root of a path gets the smallest item three steps down or more as its parent."""
    c = HQ.consolidated(spark, d)
    deep = c.where("depth >= 3").groupBy(F.element_at("path", 1).alias("name")).agg(F.min("name").alias("parent"))
    return find_cycles(c.select("name", "parent").unionByName(deep))


# ------------------------------------------------------------------ streaming, profiles, traits
def q_tag_counts_compacted(spark, d):
    """Maintained counts, a batch for each file, compacted every few epochs."""
    src, sink, ck = (ST.shared_dir(spark, x) for x in ("src", "counts", "ck"))
    ST.stage_post_files(adapters.posts(spark, d), src)
    ST.maintain_tag_counts(spark, src, sink, ck, 1, SNAPSHOT_EVERY)
    return ST.read_tag_counts(spark, sink)


def q_column_profile_sketched(spark, d):
    """Profiles of posts and wiki from sketches stored by part and merged, held against exact counts: whether the
    estimates lie within the sketches' bounds."""
    shares = (0.5, 0.9)
    tables = {
        "posts": (Q.posts(spark, d, ("general", "artist")), F.substring("created_at", 1, 7), ["id", "score", "rating", "general", "artist"], ["id", "score"]),
        "wiki": (adapters.wiki(spark, d), F.pmod("id", F.lit(16)).cast("string"), ["id", "title", "tag", "body"], ["id"])}
    out = None
    for name, (df, part, columns, numbers) in tables.items():
        df = materialize(df, "profiled")
        found = PR.merged_profile(materialize(PR.sketched(df, part, columns, numbers), "sketches"), shares)
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns])).alias("x")).select("x.*")
        marks = {c: found.where(F.col("column") == c).select("quantiles").scalar() for c in numbers}
        held = F.lit(None).cast("boolean")
        for c in numbers:
            fits = F.lit(True)
            for n, s in enumerate(shares):
                q = F.get(marks[c], n)
                below, upto = (df.select(F.avg(F.when(cond, 1.0).otherwise(0.0))).scalar() for cond in (F.col(c) < q, F.col(c) <= q))
                fits = fits & (below <= s + PR.RANK_ERROR) & (upto >= s - PR.RANK_ERROR)
            held = F.when(F.col("column") == c, fits).otherwise(held)
        rows = found.join(exact, "column").select(
            F.lit(name).alias("table"), "column", "rows", "nulls",
            (F.abs(F.col("distinct") - F.col("exact")) <= PR.DISTINCT_ERROR * F.col("exact") + 1).alias("distinct_within"), held.alias("quantiles_within"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _relational(spark, d, build):
    """The five bucketed tables, written; build gets them by name. Their names leave the catalogue, their files stay for the result."""
    out = state_path(spark, "relational")
    wiki = adapters.wiki(spark, d).withColumn("other_names", F.array(F.replace("title", F.lit(" "), F.lit("_")), F.upper("title")))
    tables = relational.normalised_tables(Q.filtered(spark, d).select("post_id", "score", "rating", "created_at", "tags"), wiki)
    names = relational.write_bucketed(tables, out, int(spark.conf.get("spark.sql.shuffle.partitions")))
    result = materialize(build({t: spark.table(n) for t, n in names.items()}), "relational-result")
    relational.drop_bucketed(spark, names)
    return result


def q_relational_posts(spark, d):
    """Posts with their tags, on the bucketed layout."""
    return _relational(spark, d, lambda t: relational.post_summaries(t["posts"], t["post_tags"]))


def q_relational_tag_pages(spark, d):
    """Tags with their wiki page and other names, on the bucketed layout."""
    return _relational(spark, d, lambda t: relational.tag_pages(t["tags"], t["wiki_pages"], t["wiki_other_names"]))


def q_trait_swap(spark, d):
    """In every post the general tags of one category replaced by their counterparts of another."""
    f = materialize(Q.filtered(spark, d).select("post_id", "tags"), "traits")
    tags = f.select(F.explode("tags").alias("tag")).distinct()
    named = tags.select("tag", TR.first_word("tag").alias("category"), F.expr("substring(tag, instr(tag, ' ') + 1)").alias("trait"))
    swapped = TR.swap_traits(f, TR.counterparts(named, *TRAITS))
    return swapped.select("post_id", Q.joined("tags").alias("tags"), "n_swapped")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

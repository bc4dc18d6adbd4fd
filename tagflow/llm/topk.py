"""Exact top-k inner products by a pivot-distance index.

Inner products become distances: with one more component every vector gets the length R of the
longest, a query gets 0 there, and |q - x|^2 = |q|^2 + R^2 - 2 q.x, so the best scores are the
nearest points. The index keys each point by its nearest pivot and its distance to it. Points in
the order of that key, cut into cells of bounded size, make annuli of bounded size around the pivots
(a cell is as large where thousands of points are equal). By the triangle inequality no point of an
annulus with distances lo to hi from pivot p is nearer to q than max(d(q,p) - hi, lo - d(q,p)).

Search: each query expands the annuli in the order of that bound. The first round visits the cells
that can be nearest and yields the k-th best distance so far; the second visits those cells only
whose bound isn't beyond it, which leaves nothing out. Queries travel in blocks as well, so a visit
is a small matrix product, and a task returns a query's k best of each visit.

Pivots come from a bounded sample; every vector is indexed, and the result is exact whatever they
are. Scores are computed on the integers. Tasks get the pivots (pivots x dimension numbers) and
nothing else that isn't dealt out: the bounds of cells travel CHUNK to a row and meet every query
block, and a cell meets only the blocks that visit it.

Defined cases: a null id takes no part; of rows with one id the smallest vector counts; vectors that
are null or hold null or non-finite components take no part; shorter vectors are filled with zeros;
ties go to the smaller id; fewer than k candidates give all; an empty table gives no rows; other
columns are ignored. Scaled components must stay below 2^31 and scores below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import state_path
from ..sources.tables import read_table
from .common import partitions, pick, workers_ready

SCALE, K, EVERY = 256, 5, 50
#: Rows that pivots are chosen from, pivots, points of a cell, queries of a block, and cells of the first round.
SAMPLE, PIVOTS, CELL, BLOCK, FIRST = 4096, 48, 2048, 1024, 2
#: Rows of cell bounds that travel together.
CHUNK = 4096


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def unpack(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i4").reshape(-1, dim).astype(np.float64)


def choose_pivots(sample: np.ndarray, count: int, radius2: float) -> np.ndarray:
    """Centres (with the added component) of a few rounds of k-means, from points far apart."""
    points = with_length(sample, radius2)
    centres = points[:1]
    nearest = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(count, len(points)) and nearest.max() > 0:
        centres = np.concatenate((centres, points[[int(nearest.argmax())]]))
        nearest = np.minimum(nearest, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(5):
        own = distances(points, centres).argmin(axis=1)
        centres = np.stack([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


def with_length(points: np.ndarray, radius2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(radius2 - (points ** 2).sum(axis=1), 0))
    return np.concatenate((points, rest[:, None]), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def packed_by_key(points: DataFrame, pivots: np.ndarray, dim: int, radius2: float, size: int, is_query: bool) -> DataFrame:
    """Points in the order of (pivot, distance), packed: number, pivot, lo, hi, ids, matrix. Packs don't span pivots."""
    spark = points.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.zeros((batch.num_rows, dim), dtype="<i4")
            for n, v in enumerate(batch.column(1).to_pylist()):
                vectors[n, :len(v)] = v
            real = vectors.astype(np.float64)
            full = np.concatenate((real, np.zeros((len(real), 1))), axis=1) if is_query else with_length(real, radius2)
            far = distances(full, pivots)
            own = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own]), batch.column(0),
                 pa.array([v.tobytes() for v in vectors], pa.binary())], ["pivot", "far", "vec_id", "v"])

    order = ["pivot", "far", "vec_id"]
    rows = points.mapInArrow(keyed, "pivot int, far double, vec_id long, v binary")
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot = batch.column(0).to_numpy()
            far, ids = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            data = batch.column(3).to_pylist()
            at = 0
            while at < len(ids):
                end = min(at + size, int(np.searchsorted(pivot, pivot[at], side="right")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([pivot[at]], pa.int32()), pa.array([far[at]]), pa.array([far[end - 1]]),
                     pa.array([np.array(ids[at:end], dtype="<i8").tobytes()], pa.binary()),
                     pa.array([b"".join(data[at:end])], pa.binary())], ["number", "pivot", "lo", "hi", "ids", "matrix"])
                number += 1
                at = end

    return dealt.mapInArrow(pack, "number long, pivot int, lo double, hi double, ids binary, matrix binary")


def kept(df: DataFrame, name: str) -> DataFrame:
    path = state_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def annuli(blocks: DataFrame, bounds: DataFrame, pivots: np.ndarray, dim: int, radius2: float, first: int | None) -> DataFrame:
    """(block, cell, qs): the queries of a block that visit a cell.

    blocks: number, matrix, and after a first round for each query kth (a score) and seen (cells).
    With first: (block, q, cell, far), the so many cells of each query with the smallest bound, among
    each chunk of bounds. Without: every cell whose bound allows the query's kth score, but for those
    visited already.
    """
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries = unpack(row["matrix"], dim)
                to_pivots = distances(np.concatenate((queries, np.zeros((len(queries), 1))), axis=1), pivots)
                lo, hi = np.frombuffer(row["lo"], "<f8"), np.frombuffer(row["hi"], "<f8")
                cells, pivot = np.frombuffer(row["cells"], "<i8"), np.frombuffer(row["pivot"], "<i4")
                d = to_pivots[:, pivot]
                least = np.maximum(np.maximum(d - hi, lo - d), 0)
                length = (queries ** 2).sum(axis=1)[:, None] + radius2
                if first:
                    nearest = np.argsort(least, axis=1, kind="stable")[:, :first]
                    far = np.take_along_axis(least, nearest, axis=1)
                    q = np.repeat(np.arange(len(queries)), nearest.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), row["number"])), pa.array(q, pa.int32()), pa.array(cells[nearest.ravel()]),
                         pa.array(far.ravel())], ["block", "q", "cell", "far"])
                    continue
                most = (length - least ** 2) / 2 + slack * length + 1e-6  # no score beyond an annulus's bound
                visit = most >= np.array(row["kth"])[:, None]
                place = {int(c): n for n, c in enumerate(cells)}
                for q, seen in enumerate(row["seen"]):
                    visit[q, [place[c] for c in seen if c in place]] = False
                for c in np.flatnonzero(visit.any(axis=0)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["number"]]), pa.array([int(cells[c])]),
                         pa.array([np.flatnonzero(visit[:, c]).tolist()], pa.list_(pa.int32()))], ["block", "cell", "qs"])

    # every block meets every chunk of bounds: the query set against all cells, CHUNK at a time
    count = bounds.count()
    met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(bounds, "chunk")
    spread = met.repartition(partitions(blocks.sparkSession), "number", "chunk")
    return spread.mapInArrow(run, "block long, q int, cell long, far double" if first else "block long, cell long, qs array<int>")


def bounds_of(cells: DataFrame) -> DataFrame:
    """The bounds of cells, CHUNK to a row: chunk (from 0), cells, pivot, lo, hi."""
    spark = cells.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                data = [part.column(n).to_numpy().astype(t).tobytes() for n, t in enumerate(("<i8", "<i4", "<f8", "<f8"))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["cells", "pivot", "lo", "hi"])

    # a row for each cell, so few that one task for each million of them is plenty
    some = cells.select("number", "pivot", "lo", "hi").coalesce(max(1, min(partitions(spark), cells.count() // 1_000_000)))
    packed = kept(some.mapInArrow(run, "cells binary, pivot binary, lo binary, hi binary"), "bounds")
    return packed.withColumn("chunk", F.row_number().over(W.orderBy(F.xxhash64("cells"), "cells")) - 1)


def visited(visits: DataFrame, cells: DataFrame, blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """(block, q, query_id, vec_id, score): the k best of each visit for each of its queries, not below its kth score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                qs = np.array(row["qs"])
                queries, names = unpack(row["q_matrix"], dim)[qs], np.frombuffer(row["q_ids"], "<i8")[qs]
                kth = np.array(row["kth"])[qs] if row["kth"] else np.full(len(qs), -np.inf)
                points, ids = unpack(row["matrix"], dim), np.frombuffer(row["ids"], "<i8")
                by_id = np.argsort(ids, kind="stable")  # then equal scores stand in the order of ids
                points, ids = points[by_id], ids[by_id]
                for part in range(0, len(qs), 256):
                    end = min(part + 256, len(qs))
                    scores = queries[part:end] @ points.T
                    scores[names[part:end, None] == ids[None]] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(scores, best, axis=1)
                    ok = (found >= kth[part:end, None]) & (found > -np.inf)
                    n, c = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), row["block"])), pa.array(qs[part:end][n], pa.int32()),
                         pa.array(names[part:end][n]), pa.array(ids[best[n, c]]), pa.array(found[n, c].astype(np.int64))],
                        ["block", "q", "query_id", "vec_id", "score"])

    sides = blocks.select(F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "kth")
    rows = (visits.join(cells.select(F.col("number").alias("cell"), "ids", "matrix"), "cell").join(sides, "block")
            .select("block", "qs", "q_ids", "q_matrix", "kth", "ids", "matrix"))
    return rows.mapInArrow(run, "block long, q int, query_id long, vec_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding", sample: int = SAMPLE, pivots: int = PIVOTS, cell: int = CELL,
          block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id that says which rows ask."""
    spark = vectors.sparkSession
    workers_ready(spark)
    points = kept(pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"),
                                                                  scaled(F.col("v"), scale).alias("v"))
                  .where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")), "points")
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dim, radius2 = points.agg(F.max(F.size("v")), F.max(length2)).collect()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    some = [r["v"] for r in points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    centres = choose_pivots(np.array([v + [0] * (dim - len(v)) for v in some], dtype=np.float64), pivots, radius2)
    cells = kept(packed_by_key(points, centres, dim, radius2, cell, False), "cells")
    asked = kept(packed_by_key(points.where(is_query), centres, dim, radius2, block, True).select("number", "ids", "matrix"), "queries")
    bounds = kept(bounds_of(cells), "bounds")
    # first round: the nearest annuli of each query
    near = annuli(asked, bounds, centres, dim, radius2, FIRST)
    nearest = near.withColumn("n", F.row_number().over(W.partitionBy("block", "q").orderBy("far", "cell"))).where(
        F.col("n") <= FIRST)
    nearest = kept(nearest.select("block", "q", "cell"), "nearest")
    none = F.array().cast("array<double>")
    visits = nearest.groupBy("block", "cell").agg(F.array_sort(F.collect_list("q")).alias("qs"))  # at most a block's queries
    found = kept(best(visited(visits, cells, asked.withColumn("kth", none), dim, k), k), "found")
    # second round: what the first can't rule out
    kth = found.where(F.col("rank") == k).select("block", "q", F.col("score").cast("double").alias("kth"))
    each = (nearest.groupBy("block", "q").agg(F.collect_list("cell").alias("seen")).join(kth, ["block", "q"], "left")
            .withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))
    state = each.groupBy(F.col("block").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("q", "kth", "seen"))).alias("s")).select(
        "number", F.col("s.kth").alias("kth"), F.col("s.seen").alias("seen"))
    asked = kept(asked.join(state, "number"), "thresholds")
    rest = visited(annuli(asked, bounds, centres, dim, radius2, None), cells, asked, dim, k)
    columns = ["query_id", "vec_id", "score"]
    return best(found.select(*columns).unionByName(rest.select(*columns)), k).select("query_id", "rank", "vec_id", "score")


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


QUERIES = {"op3_pivot_top_k": op3_pivot_top_k}
ORACLE_SQL = {"op3_pivot_top_k": f"""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""}

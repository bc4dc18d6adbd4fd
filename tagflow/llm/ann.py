"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

With one more component, sqrt(R^2 - |x|^2) for points and 0 for queries, the largest inner product is
the smallest distance. The tree is fitted on at most SAMPLE rows (those with the smallest hash of their id;
it has no more leaves than that); every row descends it and is indexed under its leaf. Queries walk it with a
priority queue. How many leaves they visit is calibrated: for CALIBRATE queries the exact neighbours are found
by comparing them with every row, and visits are widened until TARGET of those lie in visited leaves.

The search is one shuffle of visits and points. A leaf of many rows is dealt into cells of about CELL rows
by hash of the id, the queries of a much visited leaf into pieces of about PIECE queries, and each cell meets
each piece in a group of its own, so neither a common vector nor a popular leaf ends in one task. Sizes of
leaves are the only counts the driver reads. Scores are summed in the order of components, in doubles, so
equal vectors tie exactly.

Defined cases: a null id takes no part; of rows with one id the smallest vector counts; vectors that are
null, zero (or empty) or hold null or non-finite components take no part; shorter vectors are filled with
zeros; ties go to the smaller id; a query with fewer than k candidates gets all, and the search widens while
the visited leaves hold too few; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import read_table
from . import kmeans_tree
from .common import pick, slices, workers_ready

K, EVERY = 20, 20
#: Rows the tree is fitted on, the most of them a leaf has, rows of a cell, queries of a piece.
SAMPLE, LEAF, CELL, PIECE = 32_768, 128, 2048, 4096
#: Calibration: queries, the share of their neighbours to reach, and the step by which visits widen.
CALIBRATE, TARGET, WIDEN = 160, 0.95, 1.1
HASHES = 1 << 30


@dataclass(frozen=True)
class Index:
    tree: kmeans_tree.Tree
    points: DataFrame  # leaf, cell, vec_id, v
    sizes: np.ndarray  # points of each leaf
    cell: int
    dim: int
    radius2: float


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as doubles, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None] < lengths[:, None]] = flat
    return out


def as_point(vectors: np.ndarray, radius2: float) -> np.ndarray:
    return np.concatenate((vectors, np.sqrt(np.maximum(radius2 - (vectors ** 2).sum(axis=1), 0))[:, None]), axis=1)


def as_query(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate((vectors, np.zeros((len(vectors), 1))), axis=1)


def nearest(queries: np.ndarray, names: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, point row, score) of the k best points of each query, its own left out, ties to the smaller id.

    A matrix product finds what can be among the k best; those are then summed component by component.
    """
    rough = queries @ points.T
    rough[names[:, None] == ids[None]] = -np.inf
    kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(queries), -np.inf)
    slack = 1e-10 * (np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * points.shape[1] + 1)
    q, p = np.nonzero((rough >= kth[:, None] - slack) & (rough > -np.inf))
    score = np.zeros(len(q))
    for d in range(points.shape[1]):
        score += queries[q, d] * points[p, d]
    order = np.lexsort((ids[p], -score, q))
    q, p, score = q[order], p[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], p[place < k], score[place < k]


def per_leaf(counts: np.ndarray, size: int) -> Column:
    """Into how many parts of about size each leaf is dealt, by the column leaf."""
    return F.get(F.array(*[F.lit(max(1, -(-int(n) // size))) for n in counts]), F.col("leaf"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaf: int = LEAF,
          cell: int = CELL) -> Index | None:
    """The index of all rows that take part; None if there are none."""
    spark = vectors.sparkSession
    workers_ready(spark)
    own = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    rows = materialize(own.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, dim, radius2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(length2)).collect()[0]
    if not count:
        return None
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(HASHES))
    some = rows.where(hashed <= HASHES * min(1.0, (1.2 * sample + 400) / count)).orderBy(hashed, "vec_id").limit(sample)
    tree = kmeans_tree.fit(as_point(matrix(some.select("v").toArrow()["v"], dim), radius2), leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                found = kmeans_tree.leaf_of(tree, as_point(matrix(batch.column("v"), dim), radius2))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], ["leaf", *batch.schema.names])

    kind = rows.schema["v"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"leaf int, vec_id long, v {kind}"), "ann-points")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each leaf
        sizes[r["leaf"]] = r["n"]
    number = F.pmod(F.xxhash64("vec_id", F.lit(1)), per_leaf(sizes, cell)).cast("int")
    return Index(tree, placed.select("leaf", number.alias("cell"), "vec_id", "v"), sizes, cell, dim, radius2)


def exact(index: Index, names: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf, score): the true neighbours of some queries, which every task gets, among all rows."""
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                q, p, score = nearest(queries, names, matrix(batch.column("v"), dim), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[p]), pa.array(leaf[p]), pa.array(score)],
                                                 ["query_id", "vec_id", "leaf", "score"])

    return best(index.points.mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k)


def best(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(index: Index, asked: DataFrame, k: int = K, queries: int = CALIBRATE, target: float = TARGET) -> tuple[int, float]:
    """(visits, recall): the fewest leaves, widened step by step, that reach target for a sample of the queries."""
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(queries).toArrow()
    if not some.num_rows:
        return 1, 1.0
    names, vectors = some["vec_id"].to_numpy(), matrix(some["v"], index.dim)
    orders = kmeans_tree.best_bin_first(index.tree, as_query(vectors), index.tree.leaves)
    at = {int(q): {leaf: n for n, leaf in enumerate(order)} for q, order in zip(names, orders)}
    ranks = np.array([at[r["query_id"]][r["leaf"]] for r in exact(index, names, vectors, k).select("query_id", "leaf").collect()])
    visits = 1
    while len(ranks) and (ranks < visits).mean() < target:
        visits = max(visits + 1, int(visits * WIDEN))
    return min(visits, index.tree.leaves), float((ranks < visits).mean()) if len(ranks) else 1.0


def search(index: Index, asked: DataFrame, visits: int, k: int = K, piece: int = PIECE) -> DataFrame:
    """query_id, rank, vec_id, score. asked: rows of index.points that ask."""
    tree, dim, sizes = index.tree, index.dim, index.sizes
    kind = asked.schema["v"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            if not batch.num_rows:
                continue
            orders = kmeans_tree.best_bin_first(tree, as_query(matrix(batch.column("v"), dim)), visits, sizes, k + 1)
            row = np.repeat(np.arange(len(orders)), [len(o) for o in orders])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(orders), pa.int32()), batch.column("vec_id").take(pa.array(row)),
                 batch.column("v").take(pa.array(row))], ["leaf", "vec_id", "v"])

    visited = asked.select("vec_id", "v").mapInArrow(walk, f"leaf int, vec_id long, v {kind}")
    counted = np.zeros(tree.leaves, dtype=np.int64)
    for r in visited.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each leaf
        counted[r["leaf"]] = r["n"]
    pieces = per_leaf(counted, piece)
    cells = per_leaf(index.sizes, index.cell)
    left = visited.select("leaf", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"),
                          F.pmod(F.xxhash64("vec_id", F.lit(3)), pieces).cast("int").alias("piece"), "vec_id", "v")
    right = index.points.select("leaf", "cell", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "vec_id", "v")

    def meet(queries: pa.Table, points: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and points.num_rows:
            names, vectors = queries["vec_id"].to_numpy(), matrix(queries["v"], dim)
            ids, rows = points["vec_id"].to_numpy(), matrix(points["v"], dim)
            for s in range(0, len(names), 256):
                q, p, score = nearest(vectors[s:s + 256], names[s:s + 256], rows, ids, k)
                found.append((names[s:s + 256][q], ids[p], score))
        columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["leaf", "cell", "piece"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return best(met, k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
                       target: float = TARGET, **options: int) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id that says which rows ask."""
    index = build(vectors, id_col, vector_col, **options)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.points.where(is_query).select("vec_id", "v")
    visits, _ = calibrate(index, asked, k, target=target)
    return search(index, asked, visits, k)


def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return nearest_neighbours(vectors, F.col("vec_id") % EVERY == 0)


QUERIES = {"op12_kmeans_tree": op12_kmeans_tree}
ORACLE_SQL: dict[str, str] = {}

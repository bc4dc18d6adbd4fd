"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (runs of ASCII letters and digits, lower-cased, and of characters
beyond ASCII) and the five-letter pieces of each word with its borders marked, so that a word unseen
in training still shares pieces with its relatives. Terms are hashed to buckets. Each bucket has a
weight and a vector; a pair of terms in one text adds the inner product of their vectors, which an
additive model can't.

Training: labelled rows of the folds that train, at most ``SAMPLE`` of each class (those with the
smallest hash of their id) and ``MAX_TERMS`` terms in all, go to one task as bucket numbers; texts
with the same terms count once. Every bucket that ``LEAST_TEXTS`` texts have starts with a weight and
a vector, whether or not its share differs between the classes: all are fitted together, under
penalties against chance, in blocks of bounded memory (``FactorizationMachine.start``). A bucket that
neither a weight nor a pair needs ends at zero; the rest are fitted once more without penalties. The
driver gets these: a weight and a vector for each.

Scoring reads every text once, in Arrow batches, without a shuffle. A worker remembers the known
buckets of the words it has met, in bounded memory.

Defined cases: a null or empty text scores what the bias alone gives; a null id is in no training
fold and held out is false for it; a null label is none; of several labels of an id the larger
counts; repeated rows get a row each; if all rows to learn from are of one class every score is
practically that class (0 if there are none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import documents, keep_nothing, pick, slices, workers_ready
from .decontamination import words_of
from .factorization import FactorizationMachine
from .pretokens import Recent

BUCKETS, SAMPLE, MAX_TERMS = 1 << 18, 8_000, 12_000_000
LEAST_TEXTS, THRESHOLD = 3, 0.7
PIECE = 5
#: Words that a worker remembers.
WORDS = 100_000


def term_buckets(word: bytes, buckets: int = BUCKETS) -> list[int]:
    shown = f"^{word.decode(errors='replace')}$"
    terms = {word, *(b"\x02" + shown[k:k + PIECE].encode() for k in range(len(shown) - PIECE + 1))}
    return [xxhash.xxh32_intdigest(t) % buckets for t in terms]


def fold(id_col: str = "doc_id") -> Column:
    """1: held out; 0, 2: trains."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_terms(docs: DataFrame, labels: DataFrame, sample: int, max_terms: int, label_col: str) -> DataFrame:
    """Rows (label, terms as little-endian 32-bit integers) of the bounded sample. docs: doc_id and text."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold() != 1))
              .groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label")))
    order = F.xxhash64("doc_id")
    chosen = marked.where("label = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        marked.where("label = 0").orderBy(order, "doc_id").limit(sample))
    # at most 2 * sample rows of two integers
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        known = Recent(lambda w: term_buckets(w.encode("latin-1")), WORDS)
        for part in slices(batches, 64):
            terms = []
            for text in part.column(2).to_pylist():
                seen: set[int] = set()
                for w in set(words_of(text)):
                    seen.update(known[w.decode("latin-1")])
                terms.append(np.array(sorted(seen), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, pa.binary())],
                                             ["doc_id", "label", "terms"])

    rows = texts.mapInArrow(run, "doc_id long, label int, terms binary")
    # texts with the same terms once, then as many as hold max_terms in all (a window over the sample's rows)
    rows = rows.groupBy("terms").agg(F.max("label").alias("label"), F.min(order).alias("h"))
    total = F.sum(F.length("terms") / 4).over(W.orderBy("h", "terms").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= max_terms).select("label", "terms")


def train(labels: np.ndarray, terms: list[np.ndarray], buckets: int = BUCKETS) -> tuple[FactorizationMachine, np.ndarray]:
    """The model of the buckets that end with a weight or a vector, and these."""
    none = FactorizationMachine(1), np.zeros(0, dtype=np.int64)
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        none[0].factors[:] = 0
        none[0].bias = 40.0 if ones else -40.0
        return none
    known = np.bincount(np.concatenate(terms), minlength=buckets) >= LEAST_TEXTS
    used = np.flatnonzero(known)
    if not len(used):  # no term to learn from: the bias alone
        machine = FactorizationMachine(1)
        machine.fit(np.zeros(0, dtype=np.int64), np.zeros(len(labels), dtype=np.int64), labels)
        return machine, used
    place = (np.cumsum(known) - 1).astype(np.int32)
    ends = np.cumsum([int(known[t].sum()) for t in terms])
    machine = FactorizationMachine(len(used))
    kept = machine.start(np.concatenate([place[t[known[t]]] for t in terms]), ends, labels)
    machine, used = machine.only(kept), used[kept]
    known[:] = False
    known[used] = True
    place = np.cumsum(known) - 1
    terms = [place[t[known[t]]] for t in terms]
    machine.fit(np.concatenate(terms), np.cumsum([len(t) for t in terms]), labels)
    return machine, used


def fitted(rows: DataFrame) -> tuple[FactorizationMachine, np.ndarray]:
    """train() on the rows of training_terms, in the task that holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        labels: list[int] = []
        terms: list[np.ndarray] = []
        for batch in batches:
            labels.extend(batch.column(0).to_pylist())
            terms.extend(np.frombuffer(t, dtype="<u4").astype(np.int64) for t in batch.column(1).to_pylist())
        machine, used = train(np.array(labels, dtype=np.int64), terms)
        data = [used.astype("<i8"), machine.linear.astype("<f8"), machine.factors.astype("<f8")]
        yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                                         ["bias", "used", "linear", "factors"])

    found = rows.coalesce(1).mapInArrow(run, "bias double, used binary, linear binary, factors binary").collect()
    if not found:
        return train(np.zeros(0, dtype=np.int64), [])
    linear = np.frombuffer(found[0]["linear"], "<f8")
    machine = FactorizationMachine(len(linear))
    machine.bias, machine.linear = found[0]["bias"], linear
    machine.factors = np.frombuffer(found[0]["factors"], "<f8").reshape(len(linear), -1)
    return machine, np.frombuffer(found[0]["used"], "<i8")


def score(docs: DataFrame, machine: FactorizationMachine, used: np.ndarray, text_col: str = "text",
          out_col: str = "score") -> DataFrame:
    """docs with out_col, between 0 and 1."""
    spark = docs.sparkSession
    workers_ready(spark)
    at = docs.columns.index(text_col)
    # a weight and a vector for each bucket that takes part, BUCKETS at most
    model = spark.sparkContext.broadcast((machine, {int(b): n for n, b in enumerate(used)}, BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        fm, places, buckets = model.value
        words = Recent(lambda w: tuple(sorted({places[b] for b in term_buckets(w.encode("latin-1"), buckets) if b in places})), WORDS)
        for part in slices(batches):
            found, ends = [], []
            for text in part.column(at).to_pylist():
                # latin-1 gives each byte a character: a string key for words of any bytes
                mine = set().union(*map(words.__getitem__, set(b" ".join(words_of(text)).decode("latin-1").split(" "))))
                found.extend(sorted(mine))
                ends.append(len(found))
            scores = fm.scores(np.array(found, dtype=np.int64), np.array(ends, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out_col}` double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_terms: int = MAX_TERMS,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[FactorizationMachine, np.ndarray]:
    workers_ready(docs.sparkSession)
    rows = training_terms(pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")),
                          pick(labels, doc_id=id_col, **{label_col: label_col}).withColumn("doc_id", F.col("doc_id").cast("long")),
                          sample, max_terms, label_col)
    return fitted(rows)


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return score(docs, *model).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity_fm": op4_toxicity_fm}
ORACLE_SQL: dict[str, str] = {}

"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

A word's score is c(context word) / c(context) if the n-gram occurs in another document, else ALPHA
times the score with one context word less; at the end c(word) / N, where a word that no other
document has counts as one. Counts leave out the document's own, or every n-gram would have been seen.

As a relation that is: n-grams exploded from documents, joined to count tables partitioned by n-gram
hash, summed for each document. Rows of single n-grams would make a shuffle of many times the input,
so both sides of the join travel in packs. A slice of documents lists its distinct n-grams (64-bit
hashes) once, cut by hash range into a pack for each partition of the count tables. A partition sums
the counts of all packs and answers each with the sums in the pack's order. Answers meet their slice
again by its number, where each document adds up its words. Every n-gram of every document takes
part; a pack has one row for an n-gram however often its slice repeats it, which is the aggregation
before the shuffle. The number of ranges grows with the bytes of text, so a range's share of n-grams
stays the same at every size.

A slice is bounded in documents and in bytes of text (a longer document is one by itself). It is
numbered by its input partition and place in it and read twice; an answer whose lengths don't fit the
slice read the second time stops the job.

Defined cases: a null or empty text has no words, sum 0 and a null mean; a null id is kept; repeated
rows get a row each (each is another document to the others); if no other document has a word, N
counts as one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from .common import documents, keep_nothing, partitions, pick, workers_ready
from .decontamination import words_of

ORDER, ALPHA = 2, 0.4
#: Documents and bytes of text of a slice; bytes of text for each range of hashes, and the least number of ranges.
SLICE, SLICE_BYTES, RANGE_BYTES, RANGES = 1024, 8_000_000, 1_000_000, 64
#: Words whose hashes a worker remembers.
WORDS = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Grams:
    """A slice's n-grams. hashes[k]: of the k + 1 words that end at each word, where the document has so many."""

    def __init__(self, texts: list[str | None], order: int, known: WordHashes):
        per_text = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) for w in per_text], dtype=np.int64)
        base = np.fromiter((known[w] for words in per_text for w in words), dtype=np.uint64, count=int(self.lengths.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])) if len(texts) else np.array([], dtype=np.int64)
        self.place = np.arange(len(base)) - np.repeat(starts, self.lengths)  # words before it in its document
        self.hashes = [mixed(base)]
        for k in range(1, order):
            longer = np.zeros_like(base)
            longer[1:] = mixed(self.hashes[-1][:-1] * _PRIME + base[1:] + np.uint64(k))
            self.hashes.append(longer)
        every = [h[self.place >= k] for k, h in enumerate(self.hashes)]
        self.distinct, self.counts = np.unique(np.concatenate(every), return_counts=True)

    def others(self, k: int, totals: np.ndarray) -> np.ndarray:
        """How often each word's (k + 1)-gram stands in other documents; 0 where there is none."""
        out = np.zeros(len(self.doc), dtype=np.int64)
        there = np.flatnonzero(self.place >= k)
        if len(there):
            gram = np.searchsorted(self.distinct, self.hashes[k][there])
            own = self.doc[there] * len(self.distinct) + gram
            _, place, count = np.unique(own, return_inverse=True, return_counts=True)
            out[there] = totals[gram] - count[place]
        return out

    def scores(self, totals: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: the sum of logs without the -log N of words scored alone, these, and words scored in full context."""
        order = len(self.hashes)
        others = [self.others(k, totals) for k in range(order)]
        log = np.log(np.maximum(others[0], 1))
        level = np.zeros(len(log), dtype=np.int64)
        for k in range(1, order):
            context = np.concatenate(([0], others[k - 1][:-1])) if len(log) else others[0]
            found = others[k] > 0
            log = np.where(found, np.log(np.maximum(others[k], 1)) - np.log(np.maximum(context, 1)), log)
            level = np.where(found, k, level)
        log = log + np.log(alpha) * (np.minimum(self.place, order - 1) - level)
        n = len(self.lengths)
        return (np.bincount(self.doc, log, n), np.bincount(self.doc, level == 0, n).astype(np.int64),
                np.bincount(self.doc, (level == order - 1) & (order > 1), n).astype(np.int64))


def planes(numbers: np.ndarray) -> bytes:
    """Integers with their bytes by significance: the zeros of small numbers stand together and compress away."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def numbered_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Of rows (doc_id, text)."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE_BYTES, side="right"))
            end = min(at + SLICE, max(at + 1, fits))
            yield number, batch.slice(at, end - at)
            number, at = number + 1, end


def ranges_of(hashes: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges that sorted hashes fall into, and where the hashes of each begin and end."""
    found, begins = np.unique(hashes >> shift, return_index=True)
    return found.astype(np.int64), begins, np.append(begins[1:], len(hashes)).astype(np.int64)[:len(found)]


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_full (scored in full context), n_alone (by its own count), log_score (a sum of natural logs)."""
    spark = docs.sparkSession
    workers_ready(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranges, size = RANGES, rows.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    while ranges * RANGE_BYTES < size:
        ranges *= 2
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        known = WordHashes()
        for number, part in numbered_slices(batches):
            grams = Grams(part.column(1).to_pylist(), order, known)
            some, begins, ends = ranges_of(grams.distinct, shift)
            steps = np.diff(grams.distinct, prepend=np.uint64(0))
            steps[begins] = grams.distinct[begins]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), number)),
                 pa.array([planes(steps[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
                 pa.array([planes(grams.counts[a:b].astype("<u4")) for a, b in zip(begins, ends, strict=True)], pa.binary())],
                ["part", "slice", "grams", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[tuple[int, bytes, bytes]] = []
        current = None

        def answered() -> pa.RecordBatch:
            grams = [np.cumsum(from_planes(g, "<u8"), dtype=np.uint64) for _, g, _ in packs]
            counts = np.concatenate([from_planes(c, "<u4") for *_, c in packs])
            table, place = np.unique(np.concatenate(grams), return_inverse=True)
            totals = np.bincount(place, counts, len(table)).astype("<u8")[place]
            ends = np.cumsum([len(g) for g in grams])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packs), current), pa.int64()), pa.array([n for n, *_ in packs], pa.int64()),
                 pa.array([planes(t) for t in np.split(totals, ends[:-1])], pa.binary())], ["part", "slice", "totals"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != current and packs:
                    yield answered()
                    packs = []
                current = row["part"]
                packs.append((row["slice"], row["grams"], row["counts"]))
        if packs:
            yield answered()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for number, part in numbered_slices(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())],
                                             ["slice", "docs"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        data = zstandard.ZstdDecompressor().decompress(left.column("docs")[0].as_py())
        part = pa.ipc.open_stream(data).read_all()
        grams = Grams(part.column("text").to_pylist(), order, WordHashes())
        answers = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist(), strict=True))
        totals = [from_planes(t, "<u8").astype(np.int64) for _, t in answers]
        some, begins, ends = ranges_of(grams.distinct, shift)
        if [(p, len(t)) for (p, _), t in zip(answers, totals, strict=True)] != list(zip(some.tolist(), (ends - begins).tolist(), strict=True)):
            raise RuntimeError("a slice was read differently the second time")
        log, alone, full = grams.scores(np.concatenate([np.zeros(0, np.int64), *totals]), alpha)
        return pa.table({"doc_id": part.column("doc_id").combine_chunks(), "n_words": pa.array(grams.lengths),
                         "n_full": pa.array(full), "n_alone": pa.array(alone), "log_sum": pa.array(log)})

    n = partitions(spark)
    asked = rows.mapInArrow(ask, "part long, slice long, grams binary, counts binary")
    totals = asked.repartition(n, "part").sortWithinPartitions("part").mapInArrow(answer, "part long, slice long, totals binary")
    texts = rows.mapInArrow(pack, "slice long, docs binary")
    path = state_path(spark, "lm-scores")
    texts.groupBy("slice").cogroup(totals.groupBy("slice")).applyInArrow(
        score, "doc_id long, n_words long, n_full long, n_alone long, log_sum double").write.parquet(path)
    done = spark.read.parquet(path)
    total = done.select(F.sum("n_words")).scalar()
    rest = F.greatest(total - F.col("n_words"), F.lit(1))
    return done.select("doc_id", "n_words", "n_full", "n_alone",
                       (F.col("log_sum") - F.col("n_alone") * F.log(rest.cast("double"))).alias("log_score"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "n_full", "n_alone", F.round("log_score", 4).alias("log_score"),
                         F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")), 6).alias("mean_log"))


QUERIES = {"op7_stupid_backoff": op7_stupid_backoff}
ORACLE_SQL = {"op7_stupid_backoff": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT word, count(*) AS n FROM t GROUP BY word),
own AS (SELECT r, word, count(*) AS n FROM t GROUP BY r, word),
two AS (SELECT before, word, count(*) AS n FROM t WHERE i > 1 GROUP BY before, word),
own2 AS (SELECT r, before, word, count(*) AS n FROM t WHERE i > 1 GROUP BY r, before, word),
c AS (
  SELECT t.r, t.i, one.n - own.n AS alone, coalesce(two.n - own2.n, 0) AS pair, coalesce(b.n - bo.n, 0) AS context
  FROM t JOIN one USING (word) JOIN own ON own.r = t.r AND own.word = t.word
  LEFT JOIN two ON two.before = t.before AND two.word = t.word
  LEFT JOIN own2 ON own2.r = t.r AND own2.before = t.before AND own2.word = t.word
  LEFT JOIN one AS b ON b.word = t.before LEFT JOIN own AS bo ON bo.r = t.r AND bo.word = t.before),
s AS (
  SELECT r, count(*) FILTER (WHERE pair > 0) AS n_full, count(*) FILTER (WHERE pair = 0) AS n_alone,
    sum(CASE WHEN pair > 0 THEN ln(pair) - ln(context) ELSE ln(greatest(alone, 1)) + CASE WHEN i > 1 THEN ln({ALPHA}) ELSE 0 END END) AS x
  FROM c GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_full, 0) AS n_full, coalesce(n_alone, 0) AS n_alone,
    coalesce(x, 0) - coalesce(n_alone, 0) * ln(CAST(greatest(sum(len(w)) OVER () - len(w), 1) AS DOUBLE)) AS log_score
  FROM d LEFT JOIN s USING (r))
SELECT doc_id, n_words, n_full, n_alone, round(log_score, 4) AS log_score,
  round(CASE WHEN n_words > 0 THEN log_score / n_words END, 6) AS mean_log FROM f
"""}

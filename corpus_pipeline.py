"""A corpus pipeline: each stage calls one operator of ``tagflow.llm`` and works on what the one before kept.

1. toxicity: documents that the factorization machine scores 0.7 or more go.
2. near_duplicates: one document of each component of SimHash links stays, the one with the smallest id.
3. decontamination: passages of benchmark items are cut out of the texts.
4. pii: personal data is replaced by its kind in brackets.
5. bpe: texts become token ids; the ids are decoded again, and both have a digest.

All but the last return the columns of ``documents`` (n_chars follows the text where a stage changes
it); the last returns doc_id, lang, source, ids, n_tokens, ids_sha256 and decoded_sha256. Null and
empty texts, repeated rows, empty tables and further columns are as the operators define them; a
document whose whole text is cut out stays, with what is left of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.llm import bpe, decontamination, pii, simhash, toxicity
from tagflow.llm.common import column, unused
from tagflow.session import state_path
from tagflow.sources.tables import read_table


def with_text(docs: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """The columns called names, with another text and, where it differs, the number of its characters."""
    fresh = unused(docs, "new_text")
    changed = docs.withColumn(fresh, text)
    count = F.when(column(fresh) != column("text"), F.length(column(fresh))).otherwise(column("n_chars")) if "n_chars" in names else None
    return changed.select(*[column(fresh).alias("text") if n == "text" else count.cast(docs.schema["n_chars"].dataType).alias(n)
                            if n == "n_chars" else column(n) for n in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    name = unused(docs, "toxicity")
    scored = toxicity.score(docs, *model, out_col=name)
    return scored.where(column(name) < toxicity.THRESHOLD).select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = unused(docs, "passages") + "_"
    found = decontamination.find_passages(docs, read_table(spark, sf_dir, "benchmark"), prefix=prefix)
    return with_text(found, decontamination.cut_out(column("text"), column(prefix + "spans")), docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, spans = pii.find_pii(docs)
    return with_text(found, pii.redacted(column("text"), column(spans)), docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(bpe.RANKS)
    back = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", cut_benchmark_passages), ("pii", redact_pii), ("bpe", encode_and_decode)]

#: Fingerprints (XXH64) and the tokenizer's merges have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = state_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

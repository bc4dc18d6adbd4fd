"""Incremental ingest and maintained tag counts with Structured Streaming.

The studied project processes the posts in chunks, keeps a "chunks done" state file and resumes
after a failure. Here a file source with a checkpoint gives the same: every new file is read
exactly once, a restarted query continues after the last committed batch, and
trigger(availableNow=True) drains what is there and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import long_tags
from ..operators.posts import active_predicate
from ..session import state_path

POST_SCHEMA = ("id long, created_at string, score long, rating string, is_deleted boolean, is_banned boolean, "
               "general string, character string, copyright string, artist string, meta string")
COUNT_SCHEMA = "tag string, tag_type string, count long"
FILE_ROWS = 1_000_000           # of a staged file, some 70 MB
LEAST_WIDTH = 12
ROW_GROUP_BYTES = 8 << 20       # a batch of one file is still read by many tasks
KEEP = ["id", "created_at", "score", "rating", "general", "character", "copyright", "artist", "meta"]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location; ``clear_state`` deletes it."""
    return state_path(spark, name)


def _width(spark: SparkSession) -> int:
    """Tasks that run at once (LEAST_WIDTH, if executors are still to come), at most the shuffle partitions."""
    return min(int(spark.conf.get(PARTITIONS)), max(LEAST_WIDTH, spark.sparkContext.defaultParallelism))


def stage_post_files(posts: DataFrame, path: str) -> None:
    """Write posts as parquet files, to feed a stream: one for each task that runs at once, and a further one
    whenever FILE_ROWS are written, so the number of batches goes by the rows, not by the shuffle partitions."""
    (posts.repartition(_width(posts.sparkSession), F.xxhash64("id")).write.mode("append")
     .option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path))


def post_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """files_per_trigger None: a batch takes all files there are."""
    reader = spark.readStream.schema(POST_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_active(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int | None = None):
    """F1 + F2 over newly arrived files into a parquet sink; restartable from checkpoint."""
    q = (post_stream(spark, source, files_per_trigger).filter(active_predicate()).select(*KEEP)
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


PARTITIONS = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, by Hadoop's file system API, so wherever the sink is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [x.getPath().toString() for x in (found or [])]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _snapshots(spark: SparkSession, sink: str) -> list[tuple[int, str]]:
    """(epoch, folder) of the snapshots that are complete: Spark's marker file is written last, in one step."""
    done = (x.rsplit("/", 1)[0] for x in _folders(spark, f"{sink}/snapshot=*/*/_SUCCESS"))
    return sorted((int(x.rsplit("/", 2)[-2].split("=")[1]), x) for x in done)


def _deltas(spark: SparkSession, sink: str) -> list[tuple[int, str]]:
    return sorted((int(x.rsplit("=", 1)[1]), x) for x in _folders(spark, f"{sink}/epoch=*"))


def compact_tag_counts(spark: SparkSession, sink: str, epoch: int) -> None:
    """Writes the counts as of epoch into a snapshot of their own, then deletes what two snapshots have made useless.

    A snapshot counts once its marker is there, so readers see the old state or the new one. The snapshot
    before stays, with the deltas after it, for readers that have just chosen it."""
    read_tag_counts(spark, sink, epoch).write.parquet(f"{sink}/snapshot={epoch}/{uuid.uuid4().hex}")
    kept = sorted({e for e, _ in _snapshots(spark, sink)})[-2:]
    if len(kept) == 2:
        for e, path in _deltas(spark, sink):
            if e <= kept[0]:
                _delete(spark, path)
        for path in _folders(spark, f"{sink}/snapshot=*"):
            if int(path.rsplit("=", 1)[1]) < kept[0]:
                _delete(spark, path)


def maintain_tag_counts(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int | None = None,
                        snapshot_every: int | None = 16):
    """Running (tag_type, tag) counts of active posts. The state, in RocksDB, is bounded by the distinct tags.
    Every batch opens and commits each of its partitions, so a new checkpoint gets one for each task that runs at once
    (an old one keeps its number).

    A batch writes the counts it changed to a folder of its epoch, which a retried batch writes anew;
    every snapshot_every epochs (None: never) they are compacted. ``read_tag_counts`` takes the latest of each tag."""
    counts = (post_stream(spark, source, files_per_trigger).filter(active_predicate())
              .transform(long_tags).groupBy("tag", "tag_type").agg(F.count(F.lit(1)).alias("count")))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        if snapshot_every and epoch % snapshot_every == snapshot_every - 1:
            compact_tag_counts(spark, sink, epoch)

    conf = {PROVIDER: ROCKSDB, PARTITIONS: _width(spark)}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:  # the stream takes the settings as of its start; compaction has the session's own
        q = (counts.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    q.awaitTermination()
    return q


def read_tag_counts(spark: SparkSession, sink: str, upto: int | None = None) -> DataFrame:
    """The current counts (as of epoch upto): the last snapshot, and of each tag changed since the count of its latest epoch."""
    snapshots = [x for x in _snapshots(spark, sink) if upto is None or x[0] <= upto]
    since, last = snapshots[-1] if snapshots else (-1, None)
    later = [(e, x) for e, x in _deltas(spark, sink) if e > since and (upto is None or e <= upto)]
    parts = [spark.read.schema(COUNT_SCHEMA).parquet(x).select("tag", "tag_type", "count", F.lit(e).cast("long").alias("epoch"))
             for e, x in ([(since, last)] if last else []) + later]
    if not parts:
        return spark.createDataFrame([], COUNT_SCHEMA)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("tag", "tag_type").agg(F.max_by("count", "epoch").alias("count"))

"""Arriving scan entries as a stream: each batch is one run of the incremental target."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.incremental import FILES, VersionedTarget, run_once, seen_files


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps over restarts: it stands in its checkpoint from the start."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def follow(entries: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep a target up to date with a stream of entries (path_key, size, mtime, seen_at, entry_id).

    A batch can't tell what is gone, so the state is kept for what it didn't see. Versions carry the stream's id and
    the batch's number, so a batch that was published before a crash is not run again, while other streams (or the
    same source under a new checkpoint) lose nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        target = VersionedTarget(batch.sparkSession, root)
        own = f"{stream_id(batch.sparkSession, checkpoint)}:"
        last = next((label for _, label in target.labels() if (label or "").startswith(own)), None)
        if last is not None and int(last[len(own) :]) >= number:
            return
        run_once(target, seen_files(batch), FILES, label=f"{own}{number}", keep_unseen=True)

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

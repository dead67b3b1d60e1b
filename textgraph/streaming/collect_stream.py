"""Collecting from a stream of files: each micro-batch of (path, content) rows is diffed and merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textgraph import schema
from textgraph.collect import extract
from textgraph.operators import diff, store


def merge_batch(db: store.Store, files: DataFrame, home: str, timestamp: float) -> None:
    """Upserts files (path, content, modified, root); files that aren't in the batch stay.  A repeated batch changes nothing.

    Of a file that a batch has more than once the newest holds, of equally new ones the greatest content.
    """
    newest = files.groupBy("path").agg(F.max(F.struct("modified", "content", "root")).alias("f")).select("path", "f.*")
    rows = newest.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("size", F.octet_length("content").cast("long")).persist()
    tables = db.tables()
    status = diff.snapshot_diff(tables["nodes"].join(rows.select("path"), "path", "left_semi"), rows)
    work = rows.join(diff.work_set(status), "path", "left_semi")
    found = extract(work, home)
    new = store.remove_files(tables, status.filter("status = 'changed'").select("path"))
    new["nodes"] = store.upsert(new["nodes"], work.select("path", "hash", "size", "modified", "root").withColumn("collected_at", F.lit(timestamp)), ["path"])
    new["edges"] = store.insert_edges(new["edges"], found["edges"])
    for n in ("regions", "attributes"):
        new[n] = store.upsert(new[n], found[n].select(*schema.columns(n)), schema.KEYS[n])
    new.pop("changelog")
    db.commit(new, {"changelog": store.changes(status, timestamp)})
    rows.unpersist()


def start(files: DataFrame, db: store.Store, checkpoint: str, home: str, clock=None) -> StreamingQuery:
    """Runs a stream of files (path, content, modified, root) into the store until all that is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.head(1):
            merge_batch(db, batch, home, float(clock(number) if clock else number))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental ingest as a stream: new files are deduplicated against history and chunked once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegrove.functions.text import normalize
from notegrove.operators import chunking, dedup
from notegrove.session import stored

_FILES = "path string, file_checksum string, text_checksum string, dup_kind string, batch string"


def new_files(spark: SparkSession, inbox: str, most: int = 1000) -> DataFrame:
    """A stream of (path, content, modified) of text files."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(inbox)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All batches of ``files`` or ``chunks``, with the batch that added each row."""
    return spark.read.parquet(f"{root}/{name}")


def ingest(spark: SparkSession, inbox: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs each batch of files through the duplicate layers and chunking and appends the outcome to the tables ``files`` and
    ``chunks`` below root, a folder a batch, so nothing that is there is written again. A batch that runs again replaces its own
    folder only, and a file whose path and bytes another batch has is left out. A file with the bytes of one in an earlier batch is a
    duplicate ``file``, one with its text a duplicate of ``content``."""
    stream, run = new_files(spark, inbox), hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        name = f"{run}-{number:09d}"
        known = table(spark, root, "files").where(F.col("batch") != name) if _exists(spark, f"{root}/files") else spark.createDataFrame([], _FILES)
        rows = df.withColumn("file_checksum", F.sha2("text", 256)).withColumn("text_checksum", F.sha2(normalize(F.col("text")), 256))
        rows = rows.withColumn("order", F.struct("arrived", "path")).join(known.select("path", "file_checksum"), ["path", "file_checksum"], "left_anti")
        judged = dedup.cascade(rows, "order", "file_checksum", "text_checksum")
        seen = lambda c: known.select(c).distinct().withColumn(f"__{c}", F.lit(True))
        judged = judged.join(seen("file_checksum"), "file_checksum", "left").join(seen("text_checksum"), "text_checksum", "left")
        kind = F.when(F.col("__file_checksum"), "file").when((F.col("dup_kind") != "file") & F.col("__text_checksum"), "content").otherwise(F.col("dup_kind"))
        judged = stored(judged.withColumn("dup_kind", kind).drop("__file_checksum", "__text_checksum", "order", "duplicate_of"))
        fresh = judged.where("dup_kind = 'new'").select(F.col("file_checksum").alias("source_id"), "text")
        chunks = chunking.chunk_rows(chunking.chunks(chunking.chapters(fresh, "source_id", "text"), "source_id"), "source_id")
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch={name}")
        judged.select("path", "file_checksum", "text_checksum", "dup_kind").write.mode("overwrite").parquet(f"{root}/files/batch={name}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def unseen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without events that repeat within the watermark; state is kept for that long only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def usage_by_window(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Streaming usage totals by event-time window and type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))

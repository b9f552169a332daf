"""Files that arrive in a folder are parsed, indexed and stored, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checkpoints import cut
from ..sources.documents import decode_utf8


def percentage(current, total):
    """Share done in percent, to one place."""
    return F.coalesce(F.round(F.try_divide(current * F.lit(100.0), total), 1), F.lit(0.0))


def watch(spark: SparkSession, folder: str, index, status_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Streams Markdown and text files into index(documents) with documents (document_id, filename, path, text).

    Each batch leaves rows (batch_id, document_id, filename, status, message) in status_path, by document: completed or failed. If a batch
    fails, its documents are tried one by one, so that one bad file fails alone. A failed batch does not stop the stream.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}").option("recursiveFileLookup", True).load(folder)
    docs = files.select(F.xxhash64("path").alias("document_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", decode_utf8("content").alias("text"))

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch)

        def tried(part: DataFrame) -> str | None:
            try:
                index(part)
            except Exception as error:  # the status table tells of it
                return str(error)[:500] or type(error).__name__
            return None

        def tell(part: DataFrame, message: str | None) -> None:
            status = F.lit("completed" if message is None else "failed")
            part.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "document_id", "filename", status.alias("status"), F.lit(message).cast("string").alias("message")).write.mode("append").parquet(status_path)

        message = tried(rows)
        if message is None:
            tell(rows, None)
            return
        # the ids of one batch of files
        for row in rows.select("document_id").distinct().toLocalIterator():
            part = rows.where(F.col("document_id") == row["document_id"])
            tell(part, tried(part))

    writer = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

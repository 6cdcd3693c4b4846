"""Folders that fill up: new files are optimised as they come. An extension; the batch plan runs on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trimlake.operators.ooxml import Options
from trimlake.plans.optimize import optimize_documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def optimize_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options | None = None, most_files: int = 1000) -> StreamingQuery:
    """Results of all files that are there, appended as Parquet. A batch that runs again replaces what it wrote before."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder)

    def one(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("hint"), "content")
        optimize_documents(docs, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

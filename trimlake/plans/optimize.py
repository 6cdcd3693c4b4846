"""The engine over a table of documents, and its reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimlake.operators.engine import optimize
from trimlake.operators.ooxml import Options
from trimlake.sources.files import _small_batches

SCHEMA = "doc_id string, path string, format string, success boolean, original_size long, optimized_size long, candidates int, savings_by_pass map<string,bigint>, message string, content binary"


def optimize_documents(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id, path, hint, content in; one result a document out. Each document is worked on where it was read: no shuffle."""
    _small_batches(docs.sparkSession)
    options = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, path, hint, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "path", "hint", "content"))):
                r = optimize(data or b"", hint or "", options)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc], pa.string()), pa.array([path], pa.string()), pa.array([r.format]), pa.array([r.success]), pa.array([r.original_size], pa.int64()),
                        pa.array([r.optimized_size], pa.int64()), pa.array([r.candidates], pa.int32()), pa.array([list(r.saved.items())], pa.map_(pa.string(), pa.int64())), pa.array([r.message]),
                        pa.array([r.data], pa.binary()),
                    ],
                    [f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("hint").cast("string").alias("hint"), "content").mapInArrow(run, SCHEMA)


def bytes_saved(original: Column, optimized: Column) -> Column:
    return F.greatest(original - optimized, F.lit(0))


def percent_saved(original: Column, optimized: Column) -> Column:
    return F.when((original == 0) | (optimized >= original), 0.0).otherwise((1 - optimized / original) * 100)


def format_bytes(n: Column) -> Column:
    """Bytes whole, kilobytes with one digit, megabytes with two."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1 << 20)))


def text_report(results: DataFrame) -> DataFrame:
    """A line for people and a JSON object a document."""
    saved = bytes_saved(F.col("original_size"), F.col("optimized_size"))
    pct = percent_saved(F.col("original_size"), F.col("optimized_size"))
    line = F.when(F.col("success"), F.format_string("%s: %s -> %s (-%.1f%%)", "path", format_bytes(F.col("original_size")), format_bytes(F.col("optimized_size")), pct)).otherwise(F.concat_ws(": ", "path", "message"))
    whole = F.struct(F.col("path").alias("file"), "format", "original_size", "optimized_size", saved.alias("saved_bytes"), pct.alias("reduction_pct"))
    none = F.struct(F.col("path").alias("file"), F.lit("skipped").alias("status"), "message")
    return results.select("doc_id", line.alias("line"), F.when(F.col("success"), F.to_json(whole)).otherwise(F.to_json(none)).alias("json"))


def batch_totals(results: DataFrame) -> DataFrame:
    """Files, successes and bytes by format, and over all."""
    return results.groupBy("format").agg(F.count("*").alias("files"), F.sum(F.col("success").cast("long")).alias("optimized"), F.sum("original_size").alias("original_size"), F.sum("optimized_size").alias("optimized_size"))


def pass_totals(results: DataFrame) -> DataFrame:
    """Raw bytes that passes saved, rolled up over format and pass. Raw: not what the files got smaller by."""
    rows = results.select("format", F.explode("savings_by_pass").alias("pass", "saved"))
    return rows.rollup("format", "pass").agg(F.sum("saved").alias("raw_saved"), F.count("*").alias("documents"))

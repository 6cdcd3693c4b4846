"""Files in and out: whole documents as rows, packages as parts, results as files and reports."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trimlake.functions.codec import Refused
from trimlake.session import bound_batches, ship
from trimlake.sources.zip_parts import Part, read_zip, write_order, write_zip

SUFFIX = ".slim"
#: Bytes of an Arrow batch of whole files, but for a single larger file.
FILE_BATCH_BYTES = 32 << 20
PART = "doc_id string, ord int, name string, data binary, size long, attributes long, stored boolean, status string"


def scan_files(spark: SparkSession, *paths: str, recursive: bool = True, suffix: str = SUFFIX) -> DataFrame:
    """doc_id, path, hint, content, length of every file; earlier outputs are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(~F.contains(name, F.lit(suffix + "."))).select(F.col("path").alias("doc_id"), "path", name.alias("hint"), "content", "length")


def _small_batches(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark, FILE_BATCH_BYTES)


def unpack(docs: DataFrame) -> DataFrame:
    """One row a part, in order; a package that can't be read is one row with its reason as status. No shuffle."""
    _small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = [(doc, k, p.name, p.data, len(p.data), p.attributes, p.stored, "ok") for k, p in enumerate(read_zip(raw or b""))]
                except Refused as e:
                    rows = [(doc, -1, None, None, 0, 0, False, str(e))]
                cols = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in PART.split(", ")])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, PART)


def repack(parts: DataFrame) -> DataFrame:
    """doc_id, content: packages from parts, the last of those with one name. One shuffle, by document; the data travel once."""
    ship(parts.sparkSession)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
        made = write_zip([Part(r["name"], r["data"], r["attributes"] or 0, bool(r["stored"])) for r in rows if r["name"] is not None])
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.string()), "content": pa.array([made], pa.binary())})

    return parts.where("status = 'ok'").select("doc_id", "ord", "name", "data", "attributes", "stored").groupBy("doc_id").applyInArrow(one, "doc_id string, content binary")


def part_order(name: Column) -> list[Column]:
    """Sort columns of the order in which parts are written."""
    ext = F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    return [name != "mimetype", name != "[Content_Types].xml", ext, name]


def output_name(path: str, suffix: str = SUFFIX, taken=lambda p: False) -> str:
    """The path with a suffix before its extension, and a number from 1 on if that is taken."""
    stem, ext = posixpath.splitext(path)
    name, n = f"{stem}{suffix}{ext}", 0
    while taken(name):
        n += 1
        name = f"{stem}{suffix}.{n}{ext}"
    return name


def _put(fs: pyarrow.fs.FileSystem, place: str, data: bytes) -> None:
    """A whole file under its name, written under one of the attempt's own first."""
    with fs.open_output_stream(own := f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}") as f:
        f.write(data)
    fs.move(own, place)


def _holds(fs: pyarrow.fs.FileSystem, place: str, data: bytes) -> bool:
    """Whether a file is there with other content: one with the same content is what an earlier attempt left."""
    info = fs.get_file_info(place)
    if info.type == pyarrow.fs.FileType.NotFound:
        return False
    if info.type != pyarrow.fs.FileType.File or info.size != len(data):
        return True
    with fs.open_input_stream(place) as f:
        return f.read() != data


def put_files(files: DataFrame) -> DataFrame:
    """Writes content to each path; path, length. Folders are made."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                fs.create_dir(posixpath.dirname(place), recursive=True)
                _put(fs, place, data or b"")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([len(x or b"") for x in b.column("content").to_pylist()], pa.int64())], ["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, length long")


def write_files(results: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """Writes the content of every success beside its input; doc_id, output_path. Executors write; an attempt that runs again finds its own file and leaves it."""
    ship(results.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                to = output_name(place, suffix, lambda p, fs=fs, data=data: _holds(fs, p, data))
                _put(fs, to, data)
                out.append(to)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "output_path"])

    return results.where("success").select("doc_id", "path", "content").mapInArrow(run, "doc_id string, output_path string")


__all__ = ["output_name", "part_order", "put_files", "repack", "scan_files", "unpack", "write_files", "write_order"]

"""Helpers shared by the training-data operators: shared scratch space and batch views of text."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimlake.session import bound_batches, shared_folder, ship

#: Rows and bytes at most in an Arrow batch that carries whole texts.
TEXT_BATCH_ROWS = 512
TEXT_BATCH_BYTES = 32 << 20

#: Bytes that separate words: blank and tab to carriage return.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory, and the package at hand there."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    bound_batches(spark, TEXT_BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows restarts from the files if an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that this worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


class TwoGenerations:
    """What was found for keys, in a worker: when the newer generation is full, it becomes the older one, from which keys that come again are taken back."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def unknown(self, keys: set) -> set:
        """The keys that must be found; all others are in now."""
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now
        rest = keys.difference(self.now)
        back = rest.intersection(self.older)
        self.now.update((k, self.older[k]) for k in back)
        return rest - back


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def utf8_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins (one more entry for the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A flag for each byte that begins a word of its text, and one for each byte inside a word."""
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    starts[first] = inside[first]
    return starts, inside


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of set flags in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

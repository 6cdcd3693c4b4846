"""Token ids in succinct files: a wavelet matrix a shard.

A shard holds the ids of consecutive documents as bit planes, the most significant first; each plane is stored in the order
that the planes above it leave (their zeros first, then their ones). A plane is cut into blocks that are compressed one by one; a directory at the head
of the file holds where each block begins and the number of ones before it. So one compressed file answers, from its directory and
one or two blocks a plane: the id at a place, how often an id occurs before a place, and where its k-th occurrence is.

Documents are dealt by ranges of doc_id (a sample sets the bounds), sorted, encoded, and written as shards of about
SHARD_TOKENS ids; a file is written under a name of its own and renamed, so a task that runs again replaces like by like. The start
of a document is the sum of the shards before its own plus its place in it.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows with one doc_id come in an order
fixed by their text; an empty table writes no files and gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trimlake.llm.bpe import byte_alphabet
from trimlake.llm.common import cut, text_of, tune
from trimlake.session import shared_folder

MODEL = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 19
#: Bits of a block of a plane; blocks that an open shard keeps.
BLOCK = 1 << 15
KEPT_BLOCKS = 64
#: Shards that a task reads.
READ_SHARDS = 8
MAGIC = b"TLWM2\n"

#: Fixed value: the pattern by which the tokenizer cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose class is the same in every version of Unicode, and a run of white space that may be too long for the pattern's look-ahead.
_PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞]*+")
_LONG_RUN = re.compile(r"\s{400}")


class Encoder:
    """The ids that the tokenizers library gives.

    Texts of plain characters are encoded by a second, quicker library with the words, ranks and pattern of the same file, which
    gives the same ids (tests hold it against the first one); all others by the first one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes([byte[c] for c in token]): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if _PLAIN.fullmatch(text) and not _LONG_RUN.search(text) and not any(s in text for s in self.special):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load_encoder(model: str) -> Encoder:
    import public_tokenizers

    return Encoder(model if "/" in model else public_tokenizers.path(model))


def planes_of(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The packed bit planes of a sequence, most significant first, and the zeros of each."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    planes, zeros, seq = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in range(bits - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << k)).astype(bool)
        planes.append(np.packbits(one, bitorder="little"))
        low = np.compress(~one, seq)  # twice as quick as seq[~one]
        zeros.append(len(low))
        seq = np.concatenate([low, np.compress(one, seq)])
    return planes, zeros


class WaveletMatrix:
    """Bit planes over n ids in blocks, with rank and select. ones: for each plane, the ones before each block and, last, all; block: gives the bytes of a block of a plane."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.ones = n, zeros, ones
        self.levels = len(zeros)
        self.block = lru_cache(maxsize=KEPT_BLOCKS)(block)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        at, rest = divmod(i, BLOCK)
        count = int(self.ones[level][at])
        if rest:
            part = self.block(level, at)[: (rest + 7) // 8]
            count += int(np.bitwise_count(part).sum())
            if rest % 8:
                count -= (int(part[-1]) >> (rest % 8)).bit_count()
        return count

    def _bit(self, level: int, i: int) -> int:
        at, rest = divmod(i, BLOCK)
        return int(self.block(level, at)[rest // 8]) >> (rest % 8) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the occurrences of a symbol before place i end up below the last plane."""
        if symbol >> self.levels:
            return 0, 0
        low, high = 0, i
        for k in range(self.levels):
            a, b = self._ones(k, low), self._ones(k, high)
            if symbol >> (self.levels - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol before place i."""
        low, high = self._range(symbol, i)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind in a plane: its block from the directory, then inside the block."""
        before = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * BLOCK, self.n) - self.ones[level]
        at = int(np.searchsorted(before, k, side="right")) - 1
        held = np.unpackbits(self.block(level, at), count=min(BLOCK, self.n - at * BLOCK), bitorder="little")
        return at * BLOCK + int(np.flatnonzero(held == bit)[k - int(before[at])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a symbol; -1 if there are fewer."""
        low, high = self._range(symbol, self.n)
        if k < 0 or low + k >= high:
            return -1
        i = low + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        seq = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            plane = [self.block.__wrapped__(k, b) for b in range(self.ones.shape[1] - 1)]
            one = np.unpackbits(np.concatenate(plane), count=self.n, bitorder="little").astype(bool) if plane else np.zeros(0, bool)
            above = np.empty_like(seq)
            above[np.flatnonzero(~one)] = seq[: self.zeros[k]]  # twice as quick as by flags
            above[np.flatnonzero(one)] = seq[self.zeros[k] :] | seq.dtype.type(1 << (self.levels - 1 - k))
            seq = above
        return seq.astype(np.uint32)


#: Of a file's head, after MAGIC: documents, ids, planes, bytes of the directory and of the documents' section.
HEAD = struct.Struct("<QQIQQ")


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: head; directory (compressed): zeros of each plane, ones before and end of each block; documents (compressed): which ids are known, doc ids, lengths; blocks."""
    planes, zeros = planes_of(ids)
    codec = zstandard.ZstdCompressor(level=3)
    blocks, ones = [], []
    for p in planes:
        parts = [p[i : i + BLOCK // 8] for i in range(0, len(p), BLOCK // 8)]
        ones.append(np.cumsum([0, *(int(np.bitwise_count(x).sum()) for x in parts)]))
        blocks += [codec.compress(x.tobytes()) for x in parts]
    table = np.concatenate([zeros, *ones, np.cumsum([0, *map(len, blocks)])]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    directory = codec.compress(table.tobytes())
    documents = codec.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + lengths.astype("<u8").tobytes())
    return b"".join([MAGIC, HEAD.pack(len(doc_ids), len(ids), len(planes), len(directory), len(documents)), directory, documents, *blocks])


class Shard:
    """An open file. read(offset, size) gives bytes of it: the head and the directory at once, all else when it is asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, len(MAGIC) + HEAD.size)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.read, self.codec = read, (codec := zstandard.ZstdDecompressor())
        self.n_docs, n, levels, directory, self.documents_size = HEAD.unpack_from(head, len(MAGIC))
        each = -(-n // BLOCK)
        table = np.frombuffer(self.codec.decompress(read(len(head), directory)), dtype="<u8").astype(np.int64)
        ones = table[levels : levels + levels * (each + 1)].reshape(levels, each + 1)
        self.at = len(head) + directory
        ends = self.at + self.documents_size + table[levels + ones.size :]

        def block(level: int, k: int) -> np.ndarray:  # holds no reference to self: a shard that is done with goes at once
            i = level * each + k
            return np.frombuffer(codec.decompress(read(int(ends[i]), int(ends[i + 1] - ends[i]))), dtype=np.uint8)

        self.matrix = WaveletMatrix(n, table[:levels].tolist(), ones, block)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The doc ids, and the number of ids of each."""
        raw = self.codec.decompress(self.read(self.at, self.documents_size)) if self.n_docs else b""
        known = np.frombuffer(raw, dtype=np.uint8, count=self.n_docs)
        ids, lengths = (np.frombuffer(raw, dtype="<i8", count=self.n_docs, offset=self.n_docs * k) for k in (1, 9))
        return [int(d) if k else None for d, k in zip(ids, known)], lengths


def open_shard(raw: bytes) -> Shard:
    return Shard(lambda at, size: raw[at : at + size])


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, folder: str, model: str = MODEL, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents in ascending doc_id order to folder; one row a shard: part, seq, path, n_docs, n_tokens."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = load_encoder(model), TaskContext.get().partitionId(), 0
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        end = np.array([end_id], dtype="<u4").tobytes()
        names: list[int | None] = []
        codes: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, codes, held, seq
            ids = np.frombuffer(b"".join(codes), dtype="<u4")
            raw = pack_shard(names, np.array([len(c) // 4 for c in codes]), ids)
            path = f"{base}/shard-{part:06d}-{seq:06d}.wm"
            with fs.open_output_stream(own := f"{base}/.{uuid.uuid4().hex}") as f:
                f.write(raw)
            fs.move(own, path)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [f"shard-{part:06d}-{seq:06d}.wm"], "n_docs": [len(names)], "n_tokens": [len(ids)]})
            names, codes, held, seq = [], [], 0, seq + 1
            return row

        for b in batches:
            for d, c in zip(b.column("doc_id").to_pylist(), map(encoder.encode, b.column("text").to_pylist())):
                names.append(d)
                codes.append(c + end)
                held += len(c) // 4 + 1
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    return cut(dealt.select("doc_id", "text").mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that shards lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    shard = open_shard(f.read())
                docs, lengths = shard.documents()
                ids = shard.matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Ids before a shard: those of all earlier parts (one row a part), and of the earlier shards of its own part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("whole"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = shards.withColumn("inside", inside).join(parts, F.col("part") == F.col("p")).select("path", (F.col("before") + F.col("inside")).alias("start"))
    tasks = -(-max(1, shards.count()) // READ_SHARDS)  # a number of its own: rows are few, but each stands for a file
    return starts.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)

"""Token counts with overlap resynchronisation.

A huge document is encoded in overlapping chunks, with the byte offsets of the tokens. Two neighbouring chunks are spliced
at a place where both have a token boundary and where the vocabulary proves that no merge can cross: no piece of it holds the two characters on
either side next to each other. The places are found before anything is encoded. If the overlap has none, it is widened twofold, back to the last
splice; if there is none at all, the chunk reaches on to the next place (or to the end of the text). So all of a text is encoded twice at
most, with or without blanks in it.

Defined results: a null or empty text has 0 bytes and 0 tokens. A text that the model's normaliser changes otherwise than by marks for blanks,
and one whose chunks don't agree at a place, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trimlake.llm.common import tune, utf8_view

MODEL = "piece_bpe_32k.model"
CHUNK = 24_000
OVERLAP = 512
LIMIT = 4096


MARK = "▁"


@lru_cache(maxsize=4)
def load_pieces(path: str):
    """The library's processor, and the pairs of characters that some piece holds next to each other, ascending."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    pairs = {pair for p in pieces for pair in zip(p, p[1:])}
    return sp, np.array(sorted(ord(a) << 21 | ord(b) for a, b in pairs), dtype=np.int64)


def places(pairs: np.ndarray, text: str) -> np.ndarray:
    """The places of a text, ascending, over which nothing merges: before the character of that number."""
    codes = np.frombuffer(text.replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    if not len(pairs):
        return np.arange(1, len(codes))
    both = codes[:-1] << 21 | codes[1:]
    at = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
    return np.flatnonzero(pairs[at] != both) + 1


def windows(safe: np.ndarray, n: int, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Chunks of a text of n characters: begin, end, the places from and up to which each one's tokens count, and times that its overlap was widened."""
    begin, last = 0, 0
    while True:
        stop, wide, widened = min(n, begin + chunk), overlap, 0
        place = None
        while stop < n and place is None:
            low, high = np.searchsorted(safe, [max(last, stop - wide) + 1, stop])
            if low < high:  # the middlemost
                place = int(safe[(low + high) // 2])
            elif stop - wide > last:
                wide, widened = 2 * wide, widened + 1
            else:
                place = int(safe[high]) if high < len(safe) else n
                stop, widened = min(n, place + overlap // 2 + 1), widened + 1
        if stop == n:
            yield begin, n, last, n, widened
            return
        yield begin, stop, last, place, widened
        begin, last = max(last, place - overlap // 2), place


def _upto(ends: np.ndarray, at: int) -> int | None:
    """Tokens up to a byte offset, if a token ends there."""
    k = int(np.searchsorted(ends, at, side="right"))
    return k if at == 0 or k and ends[k - 1] == at else None


def count_tokens(sp, pairs: np.ndarray, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of a text, chunks encoded, and times that an overlap was widened."""
    if len(text) <= chunk + overlap or sp.normalize(text) != MARK + text.replace(" ", MARK):
        return len(sp.encode(text)), 1, 0
    total, chunks, widened = 0, 0, 0
    for begin, stop, first, upto, wider in windows(places(pairs, text), len(text), chunk, overlap):
        part = text[begin:stop]
        ends = np.fromiter((p.end for p in sp.encode(part, return_type="proto").pieces), dtype=np.int64)
        # The first chunk counts from its start, with the mark that the library sets before a text.
        low = _upto(ends, len(part[: first - begin].encode())) if first else 0
        high = _upto(ends, len(part[: upto - begin].encode())) if upto < len(text) else len(ends)
        if low is None or high is None:
            return len(sp.encode(text)), chunks + 1, widened
        total, chunks, widened = total + high - low, chunks + 1, widened + wider
    return total, chunks, widened


FIELDS = "doc_id {}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document. model: a path that every executor has, or the name of a file of public_tokenizers."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, pairs = load_pieces(_path(model))
        for b in batches:
            n_bytes = np.diff(utf8_view(b.column("text"))[1])
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            small = [k for k, t in enumerate(texts) if len(t) <= chunk + overlap]
            tokens, chunks = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
            for i in range(0, len(small), 64):
                some = small[i : i + 64]
                for k, ids in zip(some, sp.encode([texts[k] for k in some], num_threads=1)):
                    tokens[k] = len(ids)
            for k in set(range(len(texts))).difference(small):
                tokens[k], chunks[k], _ = count_tokens(sp, pairs, texts[k], chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_bytes, tokens, tokens > limit, chunks))], [f.split()[0] for f in FIELDS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS.format(docs.schema["doc_id"].dataType.simpleString()))


def _path(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL)

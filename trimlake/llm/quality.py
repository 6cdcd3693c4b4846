"""Quality rules: Gopher-like counts and compression bands.

Zstandard compresses a whole document, and each of its fixed chunks. The ratio of compressed to plain bytes says how
predictable a text is: below a band's floor it repeats itself, above its ceiling it is noise. Short texts compress
badly whatever they say, so the limits depend on the length; below 64 bytes there is no ceiling. A last chunk that is shorter
is judged from LEAST_CHUNK bytes on.

Defined results: a null text counts as empty: no words, base_failed, not kept, ratio null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import zstandard
from pyspark.sql import DataFrame

from trimlake.llm.common import mix64, per_text, tune, utf8_view, word_starts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEVEL = 3
CHUNK = 2048
#: Bytes from which a last, shorter chunk is judged too, by the limits of a text of its length.
LEAST_CHUNK = 512
#: Fixed values: (bytes below which the row holds, least ratio, greatest ratio) for whole documents, by length. The greatest ratios lie just
#: above those of prose (0.80 to 0.95 below 384 bytes, 0.44 for the longest), so that base64 fails from 192 bytes, letters of both cases at
#: random from 512, small letters from 1,280 and hexadecimal from 4,096; below these lengths prose and noise compress alike.
WHOLE_BANDS = (
    (64, 0.10, 10.0), (128, 0.10, 1.20), (160, 0.10, 0.96), (192, 0.10, 0.945), (256, 0.10, 0.87), (384, 0.08, 0.81), (512, 0.08, 0.76), (768, 0.08, 0.71), (1024, 0.08, 0.67),
    (1280, 0.07, 0.64), (1536, 0.07, 0.60), (2048, 0.07, 0.59), (3072, 0.07, 0.57), (4096, 0.07, 0.55), (8192, 0.06, 0.52), (16384, 0.06, 0.51), (1 << 62, 0.05, 0.49),
)
#: The same for a full chunk; and the share of a document's judged bytes that may lie in chunks outside their limits.
CHUNK_BAND = (0.06, 0.57)
CHUNK_SHARE = 0.25

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it. ids: word numbers, doc: their documents, ascending."""
    n = len(ids) - window + 1
    out = np.zeros(n_docs, dtype=np.int64)
    if n <= 0:
        return out
    h = mix64(doc[:n].astype(np.uint64))
    for k in range(window):
        h = mix64(h ^ (ids[k : n + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    own = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = own[np.argsort(h[own], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return out
    a, b = order[:-1][same], order[1:][same]
    equal = doc[a] == doc[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    marked = np.zeros(len(ids) + 1, dtype=np.int64)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    marked[hit] += 1
    ends = np.bincount(hit + window, minlength=len(ids) + 1)[: len(ids) + 1]
    covered = np.cumsum(marked - ends)[:-1] > 0
    np.add.at(out, doc[covered], 1)
    return out


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _limits(n: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in WHOLE_BANDS if n < below)


def band_verdict(raw: bytes, codec: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
    """Ratio of the whole text, share of its judged bytes in chunks outside their limits, and whether the text is inside all limits."""
    if not raw:
        return None, 0.0, False
    ratio = len(codec.compress(raw)) / len(raw)
    low, high = _limits(len(raw))
    bad = judged = 0
    for k in range(0, len(raw) if len(raw) >= CHUNK + LEAST_CHUNK else 0, CHUNK):
        chunk = raw[k : k + CHUNK]
        if len(chunk) >= LEAST_CHUNK:
            least, most = CHUNK_BAND if len(chunk) == CHUNK else _limits(len(chunk))
            judged += len(chunk)
            bad += 0 if least <= len(codec.compress(chunk)) / len(chunk) <= most else len(chunk)
    share = bad / judged if judged else 0.0
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


FIELDS = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    for b in batches:
        texts = ["" if t is None else t for t in b.column("text").to_pylist()]
        data, at = utf8_view(b.column("text"))
        starts, inside = word_starts(data, at)
        n_words = per_text(starts, at)
        word_chars = per_text(inside & ((data & 0xC0) != 0x80), at)
        n_symbols = per_text(_SYMBOL[data], at)
        ids: dict[str, int] = {}
        flat: list[int] = []
        for t in texts:
            flat += [ids.setdefault(w, len(ids)) for w in WORD.findall(t)]
        doc = np.repeat(np.arange(len(texts)), n_words)
        repeated = repeat_words(np.array(flat, dtype=np.int64), doc, len(texts))
        base_failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
        lines = [duplicate_lines(t) for t in texts]
        raw = data.tobytes()
        bands = [band_verdict(raw[at[k] : at[k + 1]], codec) for k in range(len(texts))]
        kept = ~base_failed & np.array([x[2] for x in bands], dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *map(pa.array, (n_words, word_chars, n_symbols)), pa.array(lines, pa.int64()), pa.array(repeated), pa.array(base_failed), pa.array(kept), pa.array([x[0] for x in bands], pa.float64()), pa.array([x[1] for x in bands], pa.float64())],
            [f.split()[0] for f in FIELDS.split(", ")],
        )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: the counts, the compression figures, and the verdicts. One pass, no shuffle."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rules, FIELDS.format(kind))


def op6_compression_bands(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lowered, all else becomes a blank, and the n-grams of 1 to 3 characters are hashed into BUCKETS. Document
frequencies come from every row that may be learned from; the regression is fitted on at most PER_LANG rows a language by
follow-the-regularised-leader with elastic-net penalties, and a temperature set on rows that it left out calibrates its probabilities.
Features are scaled to a sum of SCALE a document, so a text's logits are sums over its n-grams, whatever its length.

Defined results: null text, or none with a letter, is `und` with score 0; with nothing to learn from, every row is; rows with a null
doc_id are neither learned from nor held out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trimlake.llm.common import tune

UNKNOWN = "und"
GRAMS = 3
BUCKETS = 1 << 16
SCALE = 20.0
#: Rows a language, at most, that the regression is fitted on (stated bound of the sample).
PER_LANG = 600
#: Share of PER_LANG that the bound on the hash lets through on average, and numbers that the hash takes.
SPARE = 1.3
HASHES = 1 << 40
#: Languages up to which their bounds are broadcast.
BROADCAST_LANGS = 10_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
HELD_FOR_HEAT = 0.2
#: Documents whose buckets are marked at once, and characters whose weights are summed at once.
MARK_ROWS = 32
SUM_CHARS = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mapped code points of all texts, each with a blank on either side, and where each text begins."""
    parts = [f" {t.lower()} " for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return _letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], at


def grams(chars: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: buckets by place, and which places count (inside one text, not blank alone)."""
    inside = chars != 32
    ends = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(chars))
    h = chars.astype(np.uint64) + np.uint64(1)
    any_letter = inside.copy()
    for n in range(1, GRAMS + 1):
        if n > 1:
            nxt = np.zeros_like(h)
            nxt[: len(h) - n + 1] = chars[n - 1 :]
            h = h * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(n)
            later = np.zeros_like(inside)
            later[: len(h) - n + 1] = inside[n - 1 :]
            any_letter = any_letter | later
        bucket = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        yield bucket, any_letter & (place + n <= ends)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, ascending, and how often each occurs."""
    chars, at = characters([text])
    found = np.concatenate([b[ok] for b, ok in grams(chars, at)])
    return np.unique(found, return_counts=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that have each bucket; bucket -1 holds the number of documents."""
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        texts = ["" if t is None else t for t in b.column("text").to_pylist()]
        for i in range(0, len(texts), MARK_ROWS):
            some = texts[i : i + MARK_ROWS]
            chars, at = characters(some)
            doc = np.repeat(np.arange(len(some)), np.diff(at))
            mark = np.zeros((len(some), BUCKETS), dtype=bool)
            for bucket, ok in grams(chars, at):
                mark[doc[ok], bucket[ok]] = True
            total += mark.sum(axis=0)
            n += len(some)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], n))], ["bucket", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [counts(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), *(pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)), b.column("h")], ["lang", "bucket", "n", "h"])


class Model:
    """Weights times idf, idf, biases, temperature and the languages in order."""

    def __init__(self, langs: list[str], weight: np.ndarray, idf: np.ndarray, bias: np.ndarray, heat: float):
        self.langs, self.idf, self.bias, self.heat = langs, idf.astype(np.float32), bias, heat
        self.table = (weight * idf[:, None]).astype(np.float32)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and whether it has a letter."""
        chars, at = characters(texts)
        sums, norm = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        for bucket, ok in grams(chars, at):
            where = np.flatnonzero(ok)
            for i in range(0, len(where), SUM_CHARS):
                w = where[i : i + SUM_CHARS]
                d, h = doc[w], bucket[w]
                norm += np.bincount(d, weights=self.idf[h], minlength=len(texts))
                for c in range(len(self.langs)):
                    sums[:, c] += np.bincount(d, weights=self.table[h, c], minlength=len(texts))
        seen = norm > 0
        return sums * (SCALE / np.where(seen, norm, 1.0))[:, None] + self.bias, seen

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, seen = self.logits(texts)
        p = softmax(z / self.heat)
        best = p.argmax(axis=1)
        return [self.langs[k] if s else UNKNOWN for k, s in zip(best, seen)], np.where(seen, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases. rows: buckets and feature values. Weights whose pull stays below L1 are exactly 0."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) > L1, -(pull - np.sign(pull) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)  # the last is the bias
            w = weights(at)
            g = softmax(x @ w)
            g[labels[i]] -= 1.0
            step = x[:, None] * g
            more = step**2
            z[at] += step - (np.sqrt(n[at] + more) - np.sqrt(n[at])) / ALPHA * w
            n[at] += more
    w = weights(slice(None))
    return w[:-1], w[-1]


def fit_heat(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, on a fine geometric grid."""
    if not len(z):
        return 1.0
    grid = np.geomspace(0.05, 20.0, 121)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """labelled: doc_id, text, lang, of which nulls are left out. Document frequencies over all rows, weights on a bounded sample."""
    tune(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df = rows.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    freq = {r["bucket"]: r["df"] for r in df.collect()}  # at most BUCKETS + 1 rows
    total = freq.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + total) + 1)
    for b, k in freq.items():
        idf[b] = np.log((1 + total) / (1 + k)) + 1
    # Of each language the rows below a bound on a hash of their id, set so that a little more than per_lang are expected; of these the least ones.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    bounds = [(lang, int(min(1.0, SPARE * per_lang / n) * HASHES)) for lang, n in counts.items()]
    edge = rows.sparkSession.createDataFrame(bounds or [("", 0)], "lang string, bound long")
    edge = F.broadcast(edge) if len(bounds) <= BROADCAST_LANGS else edge
    keyed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HASHES)))
    # Rows that share one id share its hash: the limit keeps the sample's bound.
    sample = keyed.join(edge, "lang").where("h <= bound").select("lang", "text", "h").mapInArrow(_sparse, "lang string, bucket array<int>, n array<int>, h long").limit(2 * per_lang * max(1, len(counts)))
    by_lang: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in sample.collect():
        by_lang[r["lang"]].append((r["h"], len(r["bucket"]), r["bucket"], r["n"]))
    got = [(lang, b, n) for lang, rs in by_lang.items() for _, _, b, n in sorted(rs)[:per_lang]]
    langs = list(by_lang)
    labels = np.array([langs.index(r[0]) for r in got], dtype=np.int64)
    feats = []
    for _, b, n in got:
        b = np.array(b, dtype=np.int64)
        v = np.array(n, dtype=np.float64) * idf[b]
        feats.append((b, v * (SCALE / v.sum()) if len(v) else v))
    keep = np.random.default_rng(3).random(len(got)) >= HELD_FOR_HEAT
    used = np.flatnonzero(keep) if keep.any() else np.arange(len(got))
    w, bias = fit_ftrl([feats[i] for i in used], labels[used], max(1, len(langs)))
    rest = np.flatnonzero(~keep)
    z = np.array([feats[i][1] @ w[feats[i][0]] + bias for i in rest]).reshape(len(rest), max(1, len(langs)))
    return Model(langs, w, idf, bias, fit_heat(z, labels[rest]))


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs (any columns, text among them) with two columns appended, whose names must be free."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column(at).to_pylist()]
            langs, scores = [], []
            for i in range(0, len(texts), 64):
                one, two = held.value.predict(texts[i : i + 64])
                langs += one
                scores += two.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]))


def held_out():
    """Whether a row is held out of learning: crc32 of its doc_id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def op7_ftrl_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learn_rows(docs))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")

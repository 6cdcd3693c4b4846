"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are dealt to lists by their nearest centre (centres are fitted on a bounded sample; every vector is indexed). A vector's
offset from its centre, scaled to length 1 and randomly rotated into a space of BITS times as many dimensions, is kept as the signs of its components, with its length and the
inner product of the signs with it. These give an unbiased estimate of the inner product with a query, and a bound on its error.

The index (packed signs, two scalars, list) is written once, and searched twice, many codes and queries at once. First the FIRST nearest by estimate of each query
are measured exactly, which bounds the distance of its k-th neighbour; then every code whose lower bound on the distance is below that is measured, in double
precision. Only codes travel to the searches; of the vectors themselves only those that are measured.

A query looks into the nearest lists, a share of all of them; with share 1 and epsilon infinity, all vectors are measured and the result is exact.
Equal vectors are indexed once, with their k + 1 smallest ids: no others can be among the k nearest of anything. Lists lie together on shelves, which are cut
into blocks of rows and of queries, so that a task's work is bounded whatever the size of a list.

Defined results: null or zero vectors and those with null or non-finite components take no part, neither as queries nor as
candidates; vectors are compared only with those of the same length; fewer than k candidates give fewer rows; rows
with null ids take no part; a repeated id counts once for each different vector that it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimlake.llm.common import cut
from trimlake.session import ship

K = 10
QUERY_STEP = 100
#: Rows at most from which centres are fitted; rows a list aimed at; most lists; lists of a shelf; share of the lists that a query looks into, and least number.
SAMPLE = 20_000
LIST_ROWS = 128
MOST_LISTS = 4096
SHELF = 32
SHARE = 0.65
LEAST_LISTS = 16
#: Bits of a code for each dimension, up to MOST_BITS in all (but one for each dimension at least).
BITS = 8
MOST_BITS = 1024
#: Candidates of a query that are measured first; error bound of the estimate, in standard deviations.
FIRST = 32
EPSILON = 2.5
#: Rows and queries of a block, and queries that are looked at together.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 1024
TOGETHER = 64
#: Values from which estimates are reckoned with all digits.
LARGE = 1e12
SEED = 20240521


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    x = sample.astype(np.float64)
    centres = x[np.sort(rng.choice(len(x), size=min(lists, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest_centres(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centres of each row, nearest first."""
    out = []
    half = (centres**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        part = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, m), np.int64)


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random matrix of orthonormal columns: dim of them, a row a bit."""
    bits = -(-max(dim, min(BITS * dim, MOST_BITS)) // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit offsets, the offsets' lengths, and the inner product of signs (of length 1 together) and unit offset. centre: one, or one for each row."""
    off = x.astype(np.float64) - centre
    length = np.sqrt((off**2).sum(axis=1))
    unit = np.divide(off, length[:, None], out=np.zeros_like(off), where=length[:, None] > 0) @ turn.T
    return np.packbits(unit >= 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(len(turn))


class Codes:
    """Codes of one block, ready for many queries. own: the place in centres of each one's list."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, own: np.ndarray, centres: np.ndarray, turn: np.ndarray):
        # Half the digits are enough for a bound, but for values whose squares they can't hold.
        self.kind = kind = np.float32 if max(np.abs(centres).max(initial=0.0), length.max(initial=0.0)) < LARGE else np.float64
        signs = np.unpackbits(codes, axis=1).astype(kind)
        signs *= 2
        signs -= 1
        self.signs, self.own, self.centres, self.turn = signs, own, centres, turn
        bits = len(turn)
        safe = np.where(fit > 0, fit, 1.0)
        self.square = (length**2).astype(kind)
        self.scale = (2 * length / (safe * np.sqrt(bits))).astype(kind)
        self.slack = (2 * length * np.sqrt(np.maximum(0.0, 1 - safe**2)) / safe / np.sqrt(max(1, bits - 1))).astype(kind)
        self.middle = np.einsum("ij,ij->i", signs, (centres @ turn.T).astype(kind)[own])

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each code and query: the estimated square of the distance, and one standard deviation of it."""
        far = np.sqrt(((queries[None] - self.centres[:, None]) ** 2).sum(axis=2)).astype(self.kind)[self.own]
        dot = self.signs @ (queries @ self.turn.T).T.astype(self.kind)
        dot -= self.middle[:, None]
        dot *= -self.scale[:, None]
        dot += self.square[:, None]
        dot += far * far
        far *= self.slack[:, None]
        return dot, far


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _distance(a: str, b: str) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda total, x: total + x))


class Index:
    """The codes of all vectors, written, and what a search needs besides. vectors: vec_id, embedding."""

    def __init__(self, vectors: DataFrame, k: int = K):
        spark = vectors.sparkSession
        ship(spark)
        self.k = k
        e = F.col("embedding").cast("array<double>")
        good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))
        good = good.where(F.coalesce(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.exists("v", lambda v: v != 0))
        good = good.withColumn("v", F.transform("v", lambda v: v + F.lit(0.0)))  # -0.0 and 0.0 are one
        self.good = cut(good.withColumn("h", F.xxhash64("v")).distinct())
        # One row a distinct vector, with the ids that can ever be wanted: the window's limit applies before its shuffle too.
        first = self.good.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
        store = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))
        self.store = cut(store.withColumn("vid", F.monotonically_increasing_id()))
        counts = {r["dim"]: r["count"] for r in self.store.groupBy("dim").count().collect()}  # one row a length of vector
        share = SAMPLE / max(1, sum(counts.values()))
        pick = self.store.where(F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))).select("dim", "v").limit(2 * SAMPLE)
        sample: dict[int, list] = {}
        for r in pick.collect():
            sample.setdefault(r["dim"], []).append(r["v"])
        centres = {}
        for dim, n in counts.items():
            have = np.array(sorted(sample.get(dim) or [[0.0] * dim]))
            centres[dim] = fit_centres(have, max(1, min(MOST_LISTS, -(-n // LIST_ROWS), len(have)))).astype(np.float64)
        self.held = held = spark.sparkContext.broadcast(centres)  # at most MOST_LISTS centres a length
        self.lists = {dim: len(c) for dim, c in centres.items()}

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = np.asarray(b.column("dim"))
                for dim in np.unique(dims):
                    some = b.filter(pa.array(dims == dim))
                    x, c = _matrix(some.column("v")), held.value[int(dim)]
                    own = nearest_centres(x, c, 1)[:, 0]
                    codes, length, fit = encode(x, c[own], rotation(int(dim)))
                    yield pa.RecordBatch.from_arrays([some.column("vid"), some.column("h"), some.column("dim"), pa.array(own.astype(np.int32)), pa.array(map(bytes, codes), pa.binary()), pa.array(length), pa.array(fit)], ["vid", "h", "dim", "list", "code", "length", "fit"])

        rows = self.store.select("vid", "h", "dim", "v").mapInArrow(code, "vid long, h long, dim int, list int, code binary, length double, fit double")
        self.codes = cut(rows.withColumn("shelf", F.floor(F.col("list") / SHELF).cast("int")))
        self.shelves = cut(self.codes.groupBy("dim", "shelf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))

    def asked(self, query_step: int, share: float) -> DataFrame:
        """qid, v, dim, shelf, lists, block and q_block: each distinct query once for every block of every shelf that it looks into."""
        held = self.held

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists: list = [None] * b.num_rows
                dims = np.asarray(b.column("dim"))
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    c = held.value[int(dim)]
                    m = min(len(c), max(LEAST_LISTS, math.ceil(share * len(c))))
                    for i, near in zip(at, nearest_centres(_matrix(b.column("v").take(pa.array(at))), c, m)):
                        lists[i] = near.tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], [*b.schema.names, "lists"])

        queries = self.good.where(F.col("vec_id") % query_step == 0).select("h", "v").distinct().join(self.store.select("h", "v", "vid", "dim"), ["h", "v"])
        dealt = queries.select(F.col("vid").alias("qid"), "dim", "v").mapInArrow(deal, "qid long, dim int, v array<double>, lists array<int>")
        shelf = lambda x: F.floor(x / SHELF).cast("int")
        dealt = dealt.withColumn("shelf", F.explode(F.array_distinct(F.transform("lists", shelf)))).withColumn("lists", F.filter("lists", lambda x: shelf(x) == F.col("shelf")))
        dealt = cut(dealt)
        sizes = dealt.groupBy("dim", "shelf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks")).join(self.shelves, ["dim", "shelf"])
        spread = dealt.join(sizes, ["dim", "shelf"]).withColumn("q_block", F.pmod(F.xxhash64("qid"), F.col("q_blocks")).cast("int"))
        return cut(spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def searched(self, asked: DataFrame, first: int | None, epsilon: float) -> DataFrame:
        """qid, vid, estimate. With first, each block's nearest by estimate; else all whose lower bound is not above the query's limit."""
        held = self.held
        keys = ["dim", "shelf", "block", "q_block"]

        def search(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            qid, vid, est = [], [], []
            if a.num_rows and b.num_rows:
                dim, shelf = key[0].as_py(), key[1].as_py()
                centres = held.value[dim][shelf * SHELF : (shelf + 1) * SHELF]
                own = np.asarray(a.column("list")) - shelf * SHELF
                packed = np.frombuffer(b"".join(a.column("code").to_pylist()), dtype=np.uint8).reshape(a.num_rows, -1)
                block = Codes(packed, np.asarray(a.column("length")), np.asarray(a.column("fit")), own, centres, rotation(dim))
                ids, names = np.asarray(a.column("vid")), np.asarray(b.column("qid"))
                queries, lists = _matrix(b.column("v").combine_chunks()), b.column("lists").to_pylist()
                limits = np.asarray(b.column("limit"))
                for i in range(0, len(queries), TOGETHER):
                    some = slice(i, i + TOGETHER)
                    seen = np.zeros((len(centres), len(names[some])), dtype=bool)
                    for j, ls in enumerate(lists[some]):
                        seen[np.array(ls) - shelf * SHELF, j] = True
                    middle, slack = block.estimate(queries[some])
                    middle[~seen[own]] = np.inf
                    if first is not None:
                        n = min(first, len(ids))
                        at, j = np.argpartition(middle, n - 1, axis=0)[:n].ravel(), np.tile(np.arange(middle.shape[1]), n)
                        keep = np.isfinite(middle[at, j])
                        at, j = at[keep], j[keep]
                    elif math.isinf(epsilon):
                        at, j = np.nonzero(np.isfinite(middle))
                    else:
                        at, j = np.nonzero(middle - middle.dtype.type(epsilon) * slack <= limits[some] ** 2 * (1 + 1e-5) + 1e-6 * np.abs(block.square[:, None]) + 1e-12)
                    qid.append(names[some][j])
                    vid.append(ids[at])
                    est.append(middle[at, j])
            cat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
            return pa.table({"qid": cat(qid, np.int64), "vid": cat(vid, np.int64), "estimate": cat(est, np.float64)})

        q_sizes = asked.select("dim", "shelf", "q_blocks").distinct()
        left = self.codes.join(self.shelves, ["dim", "shelf"]).join(q_sizes, ["dim", "shelf"]).withColumn("block", F.pmod("h", "blocks").cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        left = left.select(*keys, "vid", "list", "code", "length", "fit")
        return left.groupBy(*keys).cogroup(asked.select(*keys, "qid", "v", "lists", "limit").groupBy(*keys)).applyInArrow(search, "qid long, vid long, estimate double")

    def measured(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """qid, score, ids of pairs (qid, vid). queries: qid, q."""
        both = pairs.select("qid", "vid").join(self.store.select("vid", "v", "ids"), "vid").join(queries, "qid")
        return both.select("qid", _distance("v", "q").alias("score"), "ids")

    def survivors(self, query_step: int, share: float = SHARE, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
        """The pairs (qid, vid) that are to be measured, and the distinct queries (qid, q)."""
        asked = self.asked(query_step, share)
        queries = asked.select("qid", F.col("v").alias("q")).dropDuplicates(["qid"])
        near = self.searched(asked.withColumn("limit", F.lit(0.0)), FIRST, epsilon)
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("estimate", "vid"))).where(F.col("r") <= FIRST)
        each = self.measured(near, queries).select("qid", F.explode(F.transform("ids", lambda _: F.col("score"))).alias("score"))
        limit = F.get(F.array_sort(F.collect_list("score")), F.lit(self.k))
        limits = cut(each.groupBy("qid").agg(F.coalesce(limit, F.lit(1e150)).alias("limit")))
        return self.searched(asked.join(limits, "qid"), None, epsilon), queries


def nearest(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = K, share: float = SHARE, epsilon: float = EPSILON) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id, score for every row whose vec_id is divisible by query_step."""
    index = Index(vectors, k)
    pairs, queries = index.survivors(query_step, share, epsilon)
    found = index.measured(pairs, queries).select("qid", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("qid").orderBy("score", "vec_id")
    found = cut(found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).groupBy("qid").agg(F.collect_list(F.struct("score", "vec_id")).alias("best")))
    # A query's own row is not a candidate; the k + 1 nearest hold k others.
    asked = index.good.where(F.col("vec_id") % query_step == 0).join(index.store.select("h", "v", F.col("vid").alias("qid")), ["h", "v"])
    own = asked.select(F.col("vec_id").alias("query_id"), "qid").join(found, "qid")
    others = F.slice(F.array_sort(F.filter("best", lambda s: s["vec_id"] != F.col("query_id"))), 1, k)
    return own.select("query_id", F.posexplode(others).alias("pos", "s")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def op1_one_bit_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

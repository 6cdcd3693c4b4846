"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both of its sides.

The vocabulary is every word that the whole corpus holds often enough; it grows with the corpus (as does the count asked for, by the
root of its tokens). The network sees the classes of the WINDOW words before and after a place, not the place itself, and predicts the
place's class in two steps (a group, then a member), so a token costs twice the root of the number of classes. The commonest words are a
class each; the next ones, up to SYMBOLS, share classes and have their share of their class's tokens as the probability inside it; all others
share the last class, where a word has its discounted share of the tokens there, and what is left goes to words outside the vocabulary
by a model of characters that ends words too. So every token's own probability is summed, and those of all words add up to 1 at most.

The texts are read once for the counts and once for the words' numbers, which are written. After a short start on a bounded sample of documents, every
task trains on all of its own and the tasks' weights are averaged, by tokens, in a tree. A document's score is the sum of its tokens' conditional log-probabilities.

Defined results: a null or empty text has no tokens, sum 0 and mean null; a word of more than LONGEST characters is outside the vocabulary; with no words anywhere the network stays as it began.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimlake.llm.common import cut, text_of, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUPS = 32
MEMBERS = 32
CLASSES = GROUPS * MEMBERS
#: Classes of more than one word: the last for words without a symbol of their own, the others for symbols dealt over them in turn.
SHARED = 256
OWN = CLASSES - SHARED
#: Symbols: the commonest words, and the last one for all others.
SYMBOLS = 32 * CLASSES
OTHER = SYMBOLS - 1
#: A place's number holds its symbol in the low bits and, above them, the word's log-probability inside the symbol, in steps of 1 / STEPS.
LOW_BITS = 20
LOW = (1 << LOW_BITS) - 1
STEPS = 1 << 16
LEAST_INNER = -1e8
WINDOW = 3
WIDTH = 12
HIDDEN = 32
#: Places of a training step and of a scoring one; words whose symbols a worker keeps.
BATCH = 4096
SCORE_BATCH = 16384
KNOWN_WORDS = 500_000
START_DOCS = 200
START_ROUNDS = 3
RATE = 0.05
#: Longest word that can be a symbol of its own; distinct words that a task counts before it hands them on.
LONGEST = 64
COUNT_WORDS = 300_000
#: A word is in the vocabulary from a count of the root of all tokens over RARE (1 at least); what a counted word gives to unseen ones.
RARE = 300
DISCOUNT = 0.5
#: Counts that a character's following ones share by how common they are; code points.
PRIOR = 4.0
CODES = 0x110000
#: Rows averaged at once.
FAN = 32


def _counted(column: str, kind: Iterator[Counter]) -> Iterator[pa.RecordBatch]:
    """Counters as rows of a key, which may be null, and n."""
    for seen in kind:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], [column, "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts; all words over LONGEST count under null."""

    def counters() -> Iterator[Counter]:
        seen: Counter[str | None] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(w if len(w) <= LONGEST else None for w in WORD.findall(t))
            if len(seen) > COUNT_WORDS:
                yield seen
                seen = Counter()
        yield seen

    return _counted("word", counters())


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring characters of distinct words; a blank stands before and after a word."""

    def counters() -> Iterator[Counter]:
        seen: Counter[str] = Counter()
        for b in batches:
            for w in b.column("word").to_pylist():
                w = f" {w} "
                seen.update(map("".join, zip(w, w[1:])))
            if len(seen) > COUNT_WORDS:
                yield seen
                seen = Counter()
        yield seen

    return _counted("pair", counters())


class Characters:
    """Log-probabilities of words as runs of characters, each by the one before it, with a share for any character at all."""

    def __init__(self, pairs: dict[str, int]):
        follow: Counter[str] = Counter()
        lead: Counter[str] = Counter()
        for p, n in pairs.items():
            lead[p[0]] += n
            follow[p[1]] += n
        all_ = sum(follow.values())
        alone = {c: (n + 1 / CODES) / (all_ + 1) for c, n in follow.items()}
        rest = 1 / CODES / (all_ + 1)
        self.pair = {p: math.log((n + PRIOR * alone[p[1]]) / (lead[p[0]] + PRIOR)) for p, n in pairs.items()}
        self.back = {c: math.log(PRIOR / (n + PRIOR)) for c, n in lead.items()}
        self.alone, self.rest = {c: math.log(x) for c, x in alone.items()}, math.log(rest)

    def log_prob(self, word: str) -> float:
        pair, total = self.pair, 0.0
        w = f" {word} "
        for p in map("".join, zip(w, w[1:])):
            x = pair.get(p)
            total += self.back.get(p[0], 0.0) + self.alone.get(p[1], self.rest) if x is None else x
        return total


class Vocabulary(NamedTuple):
    """Words from the commonest on, ties by code point, their counts, the corpus's tokens, and its pairs of characters."""

    words: list[str]
    counts: np.ndarray
    tokens: int
    pairs: dict[str, int]

    def inner(self) -> tuple[np.ndarray, float]:
        """Log-probabilities, among the words without a symbol, of those in the vocabulary, and of being outside it."""
        given = self.counts[OTHER:] - DISCOUNT
        others = self.tokens - int(self.counts[:OTHER].sum()) + 1
        return np.log(given / others), math.log((others - given.sum()) / others)

    def shares(self) -> np.ndarray:
        """Log-probability of each symbol inside its class."""
        n = np.zeros(SYMBOLS)
        n[: min(len(self.counts), OTHER)] = self.counts[:OTHER]
        n = np.maximum(n, 0.01)
        return np.log(n / np.bincount(CLASS[:SYMBOLS], weights=n, minlength=CLASSES)[CLASS[:SYMBOLS]])


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The words of all documents that are common enough, and what is needed to score the others."""
    tune(docs.sparkSession)
    words = docs.select(text_of().alias("text")).mapInArrow(_word_counts, "word string, n long")
    words = cut(words.groupBy("word").agg(F.sum("n").alias("n")))
    tokens = words.agg(F.sum("n")).first()[0] or 0
    least = max(1, int(math.sqrt(tokens) / RARE))
    top = words.where(F.col("word").isNotNull() & (F.col("n") >= least)).toArrow()
    n, names = np.asarray(top.column("n"), dtype=np.int64), top.column("word").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
    pairs = words.where(F.col("word").isNotNull()).select("word").mapInArrow(_pair_counts, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = pairs.where(F.col("n") >= least).toArrow()
    return Vocabulary([names[i] for i in order], n[order], tokens, dict(zip(found.column("pair").to_pylist(), found.column("n").to_pylist())))


def _number(inner: float) -> int:
    """The number of a word without a symbol."""
    return OTHER + (round(max(inner, LEAST_INNER) * STEPS) << LOW_BITS)


class _Numbers(dict):
    """Numbers of words: those of the vocabulary, and each other word's from when it is first asked for."""

    def __init__(self, known: zip, characters: Characters, outside: float):
        super().__init__(known)
        self.characters, self.outside = characters, outside

    def __missing__(self, word: str) -> int:
        i = _number(self.outside + self.characters.log_prob(word))
        if len(word) <= LONGEST:
            self[word] = i
        return i


class Symbols:
    def __init__(self, words: Vocabulary):
        inner, outside = words.inner()
        self.words = words.words
        self.numbers = [*range(min(len(self.words), OTHER)), *map(_number, inner.tolist())]
        self.rest = Characters(words.pairs), outside
        self.of = _Numbers(zip(self.words, self.numbers), *self.rest)

    def ids(self, words: list[str]) -> list[int]:
        if len(self.of) > len(self.words) + KNOWN_WORDS:
            self.of = _Numbers(zip(self.words, self.numbers), *self.rest)
        return list(map(self.of.__getitem__, words))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_flat() of the texts' words."""
        return _flat([np.array(self.ids(WORD.findall(t)), dtype="<i8").tobytes() for t in texts])


#: Classes of symbols, and CLASSES for the blank.
CLASS = np.arange(SYMBOLS + 1)
CLASS[OWN:OTHER] = OWN + (CLASS[OWN:OTHER] - OWN) % (SHARED - 1)
CLASS[OTHER:] = CLASSES - 1, CLASSES
SHAPES = {"embed": (CLASSES + 1, WIDTH), "hidden": (2 * WINDOW * WIDTH, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, HIDDEN, MEMBERS), "member_bias": (GROUPS, MEMBERS), "share": (SYMBOLS,)}


class Network:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = weights or {k: (rng.standard_normal(s) * (0.0 if "bias" in k else 1 / np.sqrt(s[-2]) if k != "embed" else 0.3)).astype(np.float32) for k, s in SHAPES.items() if k != "share"}
        if "share" not in self.w:  # of each class in equal parts
            self.w["share"] = -np.log(np.bincount(CLASS[:SYMBOLS])[CLASS[:SYMBOLS]]).astype(np.float32)
        self.squares = {k: np.full(s, 1e-3, dtype=np.float32) for k, s in SHAPES.items()}

    def dump(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in SHAPES)

    @classmethod
    def load(cls, raw: bytes) -> Network:
        w, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            w[k] = np.frombuffer(raw, dtype="<f4", count=n, offset=at).reshape(s).astype(np.float32)
            at += 4 * n
        return cls(w)

    def _forward(self, classes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        context = classes.take(places[:, None] + AROUND)
        x = self.w["embed"].take(context, axis=0).reshape(len(places), -1)
        h = np.tanh(x @ self.w["hidden"] + self.w["bias"])
        return context, x, h, h @ self.w["group"] + self.w["group_bias"]

    def _members(self, h: np.ndarray, g: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """What the network says of the members of each row's group; rows are in order of groups."""
        z = np.empty((len(h), MEMBERS), np.float32)
        for k, a, b in edges:
            np.matmul(h[a:b], self.w["member"][k], out=z[a:b])
        z += self.w["member_bias"].take(g, axis=0)
        return z

    def log_probs(self, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probability of the word at each place, given those around it."""
        out = np.empty(len(places), dtype=np.float64)
        classes = _classes(flat)
        for i in range(0, len(places), SCORE_BATCH):
            at = places[i : i + SCORE_BATCH]
            order, g, m, edges = _by_group(classes[at])
            _, _, h, groups = self._forward(classes, at[order])
            part = _log_prob(groups, g) + _log_prob(self._members(h, g, edges), m)
            out[i + order] = part
        own = flat[places]
        return out + self.w["share"][own & LOW] + (own >> LOW_BITS) / STEPS

    def step(self, classes: np.ndarray, at: np.ndarray) -> None:
        """One Adagrad step on the mean log-loss of some places."""
        order, g, m, edges = _by_group(classes[at])
        context, x, h, groups = self._forward(classes, at[order])
        n = len(at)
        grad = {}
        d = _pull(groups, g, n)
        grad["group"], grad["group_bias"] = h.T @ d, d.sum(axis=0)
        e = _pull(self._members(h, g, edges), m, n)
        dh = np.empty_like(h)
        grad["member"], grad["member_bias"] = np.zeros(SHAPES["member"], np.float32), np.zeros(SHAPES["member_bias"], np.float32)
        for k, a, b in edges:
            np.matmul(h[a:b].T, e[a:b], out=grad["member"][k])
            np.matmul(e[a:b], self.w["member"][k].T, out=dh[a:b])
        grad["member_bias"][[k for k, _, _ in edges]] = np.add.reduceat(e, [a for _, a, _ in edges], axis=0)
        dh += d @ self.w["group"].T
        dh *= 1 - h * h
        grad["hidden"], grad["bias"] = x.T @ dh, dh.sum(axis=0)
        dx = np.ascontiguousarray((dh @ self.w["hidden"].T).reshape(-1, WIDTH).T, dtype=np.float64)
        where = context.ravel()
        grad["embed"] = np.stack([np.bincount(where, weights=row, minlength=CLASSES + 1) for row in dx], axis=1).astype(np.float32)
        for k, v in grad.items():
            self.squares[k] += v * v
            self.w[k] -= RATE * v / np.sqrt(self.squares[k])

    def train(self, flat: np.ndarray) -> int:
        """One pass over all tokens, in order of place within strides, so that a step sees many documents."""
        classes = _classes(flat)
        places = np.flatnonzero(classes < CLASSES)
        steps = max(1, -(-len(places) // BATCH))
        for k in range(steps if len(places) else 0):
            self.step(classes, places[k::steps])
        return len(places)


#: Offsets of the words that the network sees.
AROUND = np.array([k for k in range(-WINDOW, WINDOW + 1) if k])


def _classes(numbers: np.ndarray) -> np.ndarray:
    return CLASS.take(numbers & LOW)


def _by_group(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order by groups; in it, each class's group and member; and of each group that occurs, its number and where it begins and ends.

    Classes are dealt over the groups in turn, so that common words do not share one.
    """
    order = np.argsort(classes % GROUPS, kind="stable")
    m, g = np.divmod(classes[order], GROUPS)
    edges = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
    return order, g, m, [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums, of values far inside what 32 bits hold."""
    np.clip(z, -60, 60, out=z)
    e = np.exp(z)
    return e, e @ np.ones((z.shape[1], 1), np.float32)


def _log_prob(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one entry of each row."""
    _, total = _exp(z)
    return z[np.arange(len(z)), at].astype(np.float64) - np.log(total[:, 0].astype(np.float64))


def _pull(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The gradient of the mean log-loss over n rows, for some of them."""
    e, total = _exp(z)
    e /= total
    e[np.arange(len(z)), at] -= 1
    e /= n
    return e


def _mean(table: pa.Table) -> tuple[bytes, int]:
    """Weights averaged by tokens, and the tokens."""
    rows = sorted(zip(table.column("tokens").to_pylist(), table.column("weights").to_pylist()))
    total = sum(r[0] for r in rows)
    out = sum(np.frombuffer(r[1], dtype="<f4").astype(np.float64) * r[0] for r in rows) / total
    return out.astype("<f4").tobytes(), total


def numbered(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, and the numbers of the text's words as 64-bit integers."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(held.value)
        for b in batches:
            numbers = [np.array(known.ids(WORD.findall(t)), dtype="<i8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(numbers, pa.binary())], ["doc_id", "numbers"])

    return cut(docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, numbers binary"))


def _flat(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts' words, WINDOW blanks (number SYMBOLS) between and around them, and tokens of each text."""
    blank = np.full(WINDOW, SYMBOLS, dtype="<i8").tobytes()
    return np.frombuffer(blank + b"".join([x + blank for x in column]), dtype="<i8"), np.array([len(x) // 8 for x in column], dtype=np.int64)


def train(rows: DataFrame, words: Vocabulary) -> bytes:
    """The network's weights, trained on every row of numbered()."""
    rows = rows.where(F.length("numbers") > 0).select("numbers")
    # The start's bounded sample: the rows below a bound on their hash that so many are expected to keep.
    bound = int(min(1.0, START_DOCS / max(1, rows.count())) * (1 << 40))
    some = rows.where(F.pmod(F.xxhash64("numbers"), F.lit(1 << 40)) <= bound).limit(2 * START_DOCS).collect()
    net = Network()
    net.w["share"] = words.shares().astype(np.float32)
    first = _flat(sorted(r["numbers"] for r in some))[0]
    for _ in range(START_ROUNDS):
        net.train(first)
    held = rows.sparkSession.sparkContext.broadcast(net.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = Network.load(held.value), 0
        for b in batches:
            tokens += own.train(_flat(b.column("numbers").to_pylist())[0])
        if tokens:
            yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "tokens": [tokens], "weights": [own.dump()]})

    schema = "pid long, tokens long, weights binary"

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        weights, tokens = _mean(table)
        return pa.table({"pid": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([weights], pa.binary())})

    nets = cut(rows.mapInArrow(run, schema))
    while nets.count() > 1:
        nets = cut(nets.withColumn("up", F.floor(F.col("pid") / FAN)).drop("pid").withColumnRenamed("up", "pid").groupBy("pid").applyInArrow(mean, schema))
    last = nets.toArrow()
    return _mean(last)[0] if last.num_rows else net.dump()


def fit(docs: DataFrame) -> tuple[Vocabulary, bytes]:
    """The vocabulary and the network's weights, trained on every document."""
    words = vocabulary(docs)
    return words, train(numbered(docs, words), words)


def score_numbered(rows: DataFrame, weights: bytes) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities), mean_pll for every row of numbered()."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(held.value)
        for b in batches:
            flat, n = _flat(b.column("numbers").to_pylist())
            p = np.concatenate([[0.0], np.cumsum(net.log_probs(flat, np.flatnonzero(flat < SYMBOLS)))])
            ends = np.cumsum(n)
            total = p[ends] - p[ends - n]
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total), mean], ["doc_id", "n_tokens", "pll", "mean_pll"])

    return rows.select("doc_id", "numbers").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, pll double, mean_pll double")


def score(docs: DataFrame, words: Vocabulary, weights: bytes) -> DataFrame:
    """score_numbered() for documents."""
    return score_numbered(numbered(docs, words), weights)


def op9_masked_pll(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = vocabulary(docs)
    rows = numbered(docs, words)
    return score_numbered(rows, train(rows, words))

"""Near duplicates by order min-hash, verified by banded alignment.

A document is its sequence of words; its k-mers are runs of K words, each labelled with how often it occurred before. A sketch
takes the ROWS k-mers with the least hashes and hashes them in the order in which they stand in the text, so that it agrees
for texts at a small edit distance rather than for texts with the same k-mers in another order. Texts that agree in one of SKETCHES sketches are candidates;
candidates whose words align with at most 1 - SIMILARITY of the longer one's length in edits are linked. Classes are connected components.

The k-mers are short: with a fifth of the words replaced, texts share 0.2 of their five-word shingles, which no few sketches tell from texts
that share a passage, but nearly half of their pairs of words; ROWS of these in order then agree in one sketch of twenty.

Equal texts are one node from the start. Each node is first aligned with the leader that it shares most buckets with, then with its other leaders as far as
they are still in other components. Buckets that the links leave in several components are looked at again, in ROUNDS rounds: each component sends
one member to a round, and a new leader is drawn among these. So large groups of near copies become one component by work that is linear in them.
What is left are pairs of one bucket that lie in different components and have not met: all of them are compared, by counts of words in BINS bins of their hashes, which
bound the edits from below, and those that the bound leaves are aligned. So the classes are those of the alignment of all pairs in all buckets.
The comparisons grow with the square of the texts in a bucket that are not similar, but are dealt out in blocks of BLOCK_ROWS texts, and rows grow with BLOCK_ROWS times less.
Texts of up to HELD words are aligned where they are compared, by hashes of their words, and only links that join two components are given out; pairs of longer ones are given out and aligned by their texts.

Defined results: a null text counts as empty; texts without words are equal only to the same text; texts of fewer than K words are one
k-mer; a class's id is its least doc_id (null if all are null); repeated rows share their class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trimlake.llm.common import cut, fresh, mix64, text_of, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K = 2
ROWS = 4
SKETCHES = 64
SIMILARITY = 0.8
#: Rounds in which the components that share a bucket meet once more.
ROUNDS = 6
#: Hashes of a text that are looked at together; nodes up to which those wanted are broadcast (8 bytes each), beyond that they are shuffled.
BLOCK = 1 << 14
BROADCAST_NODES = 200_000
#: Rows of ids in a file of a written table: each file costs an executor two processes on a local disk (chmod), for a moment with all of its memory.
FILE_ROWS = 1 << 16
#: Bins of a text's words; texts of a bucket in a block; pairs compared at once; step from one class of lengths to the next (a little more than 1 / SIMILARITY).
BINS = 256
BLOCK_ROWS = 1024
PAIRS = 1 << 14
BAND = 1.26
#: Words up to which the hashes of a text's words go with it to the blocks (8 bytes each); bins of these, for pairs that BINS leave; such pairs looked at together.
HELD = 1024
FINER = 1024
FEW = 1 << 11
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def kmers(ids: np.ndarray) -> np.ndarray:
    """Hashes of a text's occurrence-labelled k-mers, in order."""
    n = len(ids) - K + 1
    if n <= 0:
        h = np.full(1, len(ids), dtype=np.uint64)
        for x in ids:
            h = mix64(h ^ x)
        return h if len(ids) else h[:0]
    h = np.full(n, K, dtype=np.uint64)
    for k in range(K):
        h = mix64(h ^ ids[k : n + k])
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.append(True, run[1:] != run[:-1])
    if not new.all():
        at = np.arange(n)
        seen = np.empty(n, dtype=np.uint64)
        seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        h = np.where(seen > 0, mix64(h + seen), h)
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """For each sketch the places of its ROWS least hashes, ascending. A sketch orders the hashes by their products with its odd number."""
    each = np.arange(SKETCHES)
    places, values = [], []
    for i in range(0, len(h), BLOCK):
        g = h[None, i : i + BLOCK] * _SEEDS[:, None]
        for _ in range(min(ROWS, g.shape[1])):
            at = g.argmin(axis=1)
            places.append(at + i)
            values.append(g[each, at])
            g[each, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.stack(places, axis=1)
    if at.shape[1] > ROWS:
        at = np.take_along_axis(at, np.argsort(np.stack(values, axis=1), axis=1, kind="stable")[:, :ROWS], 1)
    return np.sort(at, axis=1)


def sketch(ids: np.ndarray) -> np.ndarray:
    """The ordered sketches of a text. Texts of up to ROWS k-mers have but one, of all of them."""
    h = kmers(ids)
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= ROWS:
        picked, key = h[None, :], _SEEDS[:1].copy()
    else:
        picked, key = h[_least(h)], _SEEDS.copy()
    for k in range(picked.shape[1]):
        key = mix64(key ^ picked[:, k])
    return key.view(np.int64)


class Words:
    """64-bit hashes of words, kept between texts."""

    def __init__(self, most: int = 400_000):
        self.of: dict[str, int] = {}
        self.most = most

    def ids(self, text: str) -> np.ndarray:
        if len(self.of) > self.most:
            self.of.clear()
        words, of = WORD.findall(text), self.of
        for w in set(words).difference(of):
            of[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([of[w] for w in words], dtype=np.uint64)


def bins(ids: np.ndarray) -> np.ndarray:
    """How many of a text's words have each remainder of their hashes, up to 65535."""
    return np.minimum(np.bincount((ids & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 65535).astype("<u2")


def finer(ids: np.ndarray) -> np.ndarray:
    """The same by other bits of the hashes, for texts of up to HELD words."""
    return np.bincount((ids // np.uint64(BINS) & np.uint64(FINER - 1)).astype(np.int64), minlength=FINER).astype(np.uint16)


def _edits(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """A bound of the edits from below, for rows of counts and by how much those of a are more in all: an edit adds one word at most and removes one at most."""
    more = (np.maximum(a, b) - b).sum(axis=1, dtype=np.int64)
    return np.maximum(more, more - longer)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        ids = [words.ids(t) for t in b.column("text").to_pylist()]
        held = [bins(x).tobytes() for x in ids]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(map(len, ids), pa.int64()), pa.array(map(sketch, ids), pa.list_(pa.int64())), pa.array(held, pa.binary())], ["doc_id", "node", "n_words", "keys", "bins"])


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """Edits between two sequences, or limit + 1 if there are more.

    Bit-parallel along the band of diagonals that limit allows: the bits of VP and VN are the vertical steps up and down inside it.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    limit = min(limit, n)
    width = 2 * limit + 2
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    vp, vn = mask << (width - limit - 1) & mask, 0
    score, stop = limit, 2 * limit + m - n
    start = limit + 1 - width
    top, side = 1 << (width - 1), 1 << (width - 2)
    for j in range(m):
        x = where.get(b[j], 0)
        x = (x >> start if start >= 0 else x << -start) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j < n - limit:
            score += not d0 & top
        else:
            score += bool(hp & side) - bool(hn & side)
            side >>= 1
        if score > stop:
            return limit + 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        start += 1
    return min(score, limit + 1)


def similar(a: list[str], b: list[str], least: float = SIMILARITY) -> bool:
    """Whether the edits between two word sequences are at most 1 - least of the longer one's length."""
    longer = max(len(a), len(b))
    limit = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit or not longer:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    number: dict[str, int] = {}
    x, y = ([number.setdefault(w, len(number)) for w in s[low : len(s) - end]] for s in (a, b))
    # An edit removes one word at most and adds one at most: counts that differ by more are apart for certain.
    d = np.bincount(x, minlength=len(number)) - np.bincount(y, minlength=len(number)) if number else np.zeros(1, np.int64)
    if max(d[d > 0].sum(), -d[d < 0].sum()) > limit:
        return False
    for band in (16, 128, limit):
        if band >= limit:
            return banded_distance(x, y, limit) <= limit
        if banded_distance(x, y, band) <= band:
            return True
    return False


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and, for texts of up to HELD words, the hashes of all words."""
    words = Words()
    for b in batches:
        ids = [words.ids(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.astype("<u8").tobytes() if len(x) <= HELD else None for x in ids], pa.binary())], ["id", "words"])


class Joined:
    """Components that a task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, words = None, []
    for b in batches:
        ok = []
        for s, t in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
            if s != last:
                last, words = s, WORD.findall(s)
            ok.append(similar(words, WORD.findall(t)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _unmet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one cell, in different components, that lengths and bins leave. Rows come sorted by cell; those of side 2 meet all of it, others those of the other side.

    Pairs of texts that come with their words are aligned here (sure is true), and left out where links given out before already join their components.
    """
    names = ("cell", "key", "id", "comp", "n_words", "side")
    held, joined = None, Joined()
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        new.append(np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype="<u2").reshape(-1, BINS))
        keys = np.zeros((len(b), SKETCHES), dtype=np.int64)
        for row, k in zip(keys, b.column("keys").to_pylist()):
            row[: len(k)] = k
        new.append(keys)
        new.append(np.array([*b.column("words").to_pylist(), None], dtype=object)[:-1])
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        # The last cell may go on in the next batch.
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            yield from _pairs(*(x[:whole] for x in held), joined)
            held = [x[whole:] for x in held]
    if held is not None:
        yield from _pairs(*held, joined)


def _pairs(
    cell: np.ndarray, key: np.ndarray, ids: np.ndarray, comp: np.ndarray, n_words: np.ndarray, side: np.ndarray, counts: np.ndarray, keys: np.ndarray, words: np.ndarray | None = None, joined: Joined | None = None
) -> Iterator[pa.RecordBatch]:
    """A pair that shares several keys is given out for the first of them."""
    low, high, sure = [], [], []
    split: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def own(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in split:
            h = np.frombuffer(words[k], dtype="<u8")
            split[k] = h, finer(h)
        return split[k]

    def linked(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> Iterator[bool]:
        """For each pair, whether it joins two components that no pair before has joined."""
        for k in range(0, len(x), FEW):
            one, two = ([own(i) for i in z[k : k + FEW].tolist()] for z in (x, y))
            near = _edits(np.stack([w[1] for w in one]), np.stack([w[1] for w in two]), n_words[x[k : k + FEW]] - n_words[y[k : k + FEW]]) <= limit[k : k + FEW]
            for i, j, v, w, ok in zip(comp[x[k : k + FEW]].tolist(), comp[y[k : k + FEW]].tolist(), one, two, near.tolist()):
                ok = ok and (i := joined.root(i)) != (j := joined.root(j)) and similar(v[0].tolist(), w[0].tolist())
                if ok:
                    joined.join(i, j)
                yield ok

    total = counts.sum(axis=1, dtype=np.int64)
    brief = None if words is None else np.array([w is not None for w in words], dtype=bool)
    at = np.arange(len(cell))
    step = 0
    while len(at):
        step += 1
        at = at[at < len(cell) - step]
        at = at[cell[at] == cell[at + step]]
        i, j = at, at + step
        longer = np.maximum(n_words[i], n_words[j])
        limit = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
        ok = (comp[i] != comp[j]) & ((side[i] == 2) | (side[i] != side[j])) & (longer - np.minimum(n_words[i], n_words[j]) <= limit)
        i, j, limit = i[ok], j[ok], limit[ok]
        for k in range(0, len(i), PAIRS):
            x, y, most = i[k : k + PAIRS], j[k : k + PAIRS], limit[k : k + PAIRS]
            near = _edits(counts[x], counts[y], total[x] - total[y]) <= most
            x, y, most = x[near], y[near], most[near]
            first = (keys[x] == keys[y]).argmax(axis=1)
            here = keys[x, first] == key[x]
            x, y, most = x[here], y[here], most[here]
            told = np.zeros(len(x), dtype=bool)
            if words is not None:
                told = brief[x] & brief[y]
                left = ~told
                left[told] = list(linked(x[told], y[told], most[told]))
                x, y, told = x[left], y[left], told[left]
            low.append(np.minimum(ids[x], ids[y]))
            high.append(np.maximum(ids[x], ids[y]))
            sure.append(told)
    if low:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), pa.array(np.concatenate(sure))], ["a", "b", "sure"])


def _cells(rest: DataFrame) -> DataFrame:
    """rest: key, h, id, comp, n_words, bins, keys, words. The rows dealt out to cells, in which any two rows of one key that lengths may leave meet.

    A key with at most BLOCK_ROWS rows is one cell. Of others the rows of one class of lengths are cut into blocks; two blocks of one class, or of a class and the one below, are a cell.
    """
    rest = rest.withColumn("band", F.floor(F.log(BAND, F.col("n_words").cast("double"))).cast("int"))
    sizes = rest.groupBy("key", "band").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))  # one entry a class of lengths

    def blocks(step: int) -> Column:
        n = F.coalesce(F.try_element_at("blocks", F.col("band") + F.lit(step)), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def cell(band: Column, kind: int, one: Column, two: Column) -> Column:
        return F.xxhash64("key", band, F.lit(kind), one, two).alias("cell")

    own = F.pmod(F.xxhash64("h"), F.element_at("blocks", F.col("band"))).cast("int")
    rows = rest.join(sizes, "key").withColumn("own", own)
    one = F.col("own")
    same = F.transform(blocks(0), lambda t: F.struct(cell(F.col("band"), 0, F.least(one, t), F.greatest(one, t)), F.when(one == t, 2).otherwise((one > t).cast("int")).alias("side")))
    below = F.transform(blocks(-1), lambda t: F.struct(cell(F.col("band"), 1, one, t), F.lit(0).alias("side")))
    above = F.transform(blocks(1), lambda t: F.struct(cell(F.col("band") + 1, 1, t, one), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.xxhash64("key").alias("cell"), F.lit(2).alias("side")))
    dealt = rows.select(F.explode(F.when(F.col("n") <= BLOCK_ROWS, whole).otherwise(F.concat(same, below, above))).alias("at"), "key", "id", "comp", "n_words", "bins", "keys", "words")
    return dealt.select("at.cell", "key", "id", "comp", "n_words", "at.side", "bins", "keys", "words").repartition("cell").sortWithinPartitions("cell")


def with_node(docs: DataFrame) -> DataFrame:
    """doc_id, text, node: 16 bytes of the text's digest."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return text.withColumn("node", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))


def _few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in no more partitions than these need."""
    return df.coalesce(rows // FILE_ROWS + 1)


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node, root for every node of a link: the least node of its component.

    Each round hooks every node to its least neighbour, shortens the hooks once, and contracts the links.
    """
    most = n = links.count()
    links = cut(_few_files(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n))
    table = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(_few_files(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), 2 * n))
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("root"))
        hook = cut(_few_files(hook.join(far, "to").select("node", "root"), 2 * n))
        if table is None:
            table = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            table = cut(_few_files(table.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), 2 * most))
        for side in ("a", "b"):
            links = links.join(hook.select(F.col("node").alias(side), F.col("root").alias("r")), side).drop(side).withColumnRenamed("r", side)
        links = cut(_few_files(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n))
        n = links.count()
        if not n:
            return table


def _fits(n: str, m: str) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY) - F.lit(1e-9)


def _aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar. Only the texts of these pairs are shuffled, if their ids are few enough to be sent to all."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if 2 * pairs.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    own = texts.join(wanted, "id", "left_semi")
    full = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, class_node for every row of docs; class_node is the node of the class's least doc_id."""
    tune(docs.sparkSession)
    texts = with_node(docs)
    rows = cut(texts.select("doc_id", "node", "text").mapInArrow(_sketches, "doc_id long, node binary, n_words long, keys array<long>, bins binary"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("bins").alias("bins"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("node")))
    # A member, as leaders are chosen: by a hash of its text, so that they are the same whatever the ids.
    members = nodes.select(F.explode("keys").alias("key"), F.struct("h", "id", "n_words").alias("m"))
    buckets = members.groupBy("key").agg(F.min("m").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    pool = cut(members.join(buckets, "key").select("key", "m", "lead"))  # buckets of two or more
    n_nodes, n_pool = nodes.count(), pool.count()
    inside = nodes.select("id", "node").join(pool.select(F.col("m.id").alias("id")).distinct(), "id")
    known = cut(texts.groupBy("node").agg(F.first("text").alias("text")).join(inside, "node").select("id", "text"))
    # Each node with the leader that most of its buckets have, then with the others.
    votes = cut(_few_files(pool.where((F.col("lead.id") != F.col("m.id")) & _fits("m.n_words", "lead.n_words")).groupBy(F.col("m.id").alias("b"), "lead").agg(F.count("*").alias("n")), n_pool))
    best = votes.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("lead"))).alias("best"))
    tested = cut(_few_files(best.select(F.col("best.lead.id").alias("a"), "b"), n_nodes))
    links = _aligned(tested, known)
    comp = components(links)

    def component(side: str) -> DataFrame:
        return comp.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs that lie in different components."""
        both = pairs.join(component("a"), "a", "left").join(component("b"), "b", "left")
        return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    others = votes.select(F.col("lead.id").alias("a"), "b")
    more = cut(apart(others.join(tested, ["a", "b"], "left_anti")))
    links = cut(links.unionByName(_aligned(more, known)))
    comp = components(links)
    # Buckets of several components: of each, one member a round meets the one that leads the round.
    label = pool.select("key", "m", F.col("m.id").alias("b")).join(component("b"), "b", "left").select("key", "m", F.coalesce("root_b", "b").alias("comp"))
    mixed = label.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rounds = [f"r{k}" for k in range(ROUNDS)]
    sent = [F.min(F.struct(F.xxhash64("m.h", "key", F.lit(r)).alias("h"), F.col("m"), F.col("comp"))).alias(r) for r in rounds]
    label = cut(_few_files(label.join(mixed, "key"), n_pool))
    one = cut(_few_files(label.groupBy("key", "comp").agg(*sent).drop("comp"), n_pool))
    lead = one.groupBy("key").agg(*(F.min(r).alias(f"lead_{r}") for r in rounds))
    met = one.join(lead, "key").select(F.explode(F.array(*(F.struct(F.col(f"lead_{r}").alias("lead"), F.col(r).alias("sent")) for r in rounds))).alias("p")).select("p.*")
    met = met.where((F.col("lead.comp") != F.col("sent.comp")) & _fits("sent.m.n_words", "lead.m.n_words"))
    met = cut(_few_files(met.select(F.col("lead.m.id").alias("a"), F.col("sent.m.id").alias("b")).distinct().join(others, ["a", "b"], "left_anti"), ROUNDS * one.count()))
    if not met.isEmpty():
        links = cut(links.unionByName(_aligned(met, known)))
        comp = components(links)
    # What is still apart: all pairs of a bucket, but those that were aligned.
    label = label.select("key", "m.*", F.col("m.id").alias("b")).join(component("b"), "b", "left").select("key", "h", "id", "n_words", F.coalesce("root_b", "b").alias("comp"))
    mixed = label.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = cut(_few_files(label.join(mixed, "key"), n_pool))
    hashes = known.join(rest.select("id").distinct(), "id", "left_semi").mapInArrow(_hashes, "id long, words binary")
    rest = cut(rest.join(nodes.select("id", "bins", "keys").join(hashes, "id"), "id"))
    done = others.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = cut(_cells(rest).mapInArrow(_unmet, "a long, b long, sure boolean"))
    if not found.isEmpty():
        unsure = cut(found.where(~F.col("sure")).select("a", "b").join(done, ["a", "b"], "left_anti"))
        comp = components(links.unionByName(found.where("sure").select("a", "b")).unionByName(_aligned(unsure, known)))
    label = cut(nodes.select("id", "node", "first_id").join(comp.select(F.col("node").alias("id"), "root"), "id", "left").select("node", "first_id", F.coalesce("root", "id").alias("root")))
    heads = label.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("node"))).alias("head"))
    named = label.join(heads, "root").select(F.col("node"), F.col("head.first_id").alias("class_id"), F.col("head.node").alias("class_node"))
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id", "class_node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of docs with each class's id and text; of rows that are repeated whole, one."""
    heads = cut(classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).groupBy("doc_id", "node").agg(F.count("*").alias("n")))
    repeated = not heads.where("n > 1").isEmpty()
    tag, own, at = (fresh(docs, x) for x in ("tl_node", "tl_id", "tl_head"))
    tagged = docs.withColumn(tag, F.substring(F.unhex(F.sha2(text_of().cast("binary"), 256)), 1, 16)).withColumn(own, F.col("doc_id").cast("long"))
    head = heads.select(F.col("doc_id").alias(at), F.col("node").alias(f"{at}_n"))
    kept = tagged.join(head, F.col(own).eqNullSafe(F.col(at)) & (F.col(tag) == F.col(f"{at}_n")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates([own, tag])
    return kept.select(*docs.columns)


def op3_order_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id and class_id for all documents."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")

"""Mixing sources to target weights by entropy balancing.

Each document gets a rate. Among all rates that give every source its target number of words, the ones taken
are closest in relative entropy to taking every document once; they are exponential tilts exp(lambda_source),
where lambda minimises the convex dual  sum_s sum_d size_d * exp(lambda_s) - lambda_s * target_s.  The dual is solved
by damped Newton iterations: each sums the tilted words over all documents, partially before its shuffle, and they end when every
constraint holds. Rates are then rounded into whole
copies: the same threshold on a hash of the document for all of a source, set so that the words taken come as near the
target as whole documents allow.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are
taken 0 words; an empty table gives an empty result; identical rows with one id stand or fall together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimlake.llm.common import cut, fresh, per_text, tune, utf8_view, word_starts

#: Source weights by rank, repeating; share of all words that the mix takes; most times that a document is taken.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Share of a target that the tilted words may miss it by when the iterations end, and most iterations; bins of a level of the rounding's histogram (there are two levels).
CLOSE = 1e-10
STEPS = 60
BINS = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = utf8_view(b.column("text"))
        size = per_text(word_starts(data, at)[0], at)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("u"), pa.array(size)], ["doc_id", "source", "u", "size"])


def _chance() -> Column:
    """A number in [0, 1) that depends on a row's doc_id, text and source alone."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.col("source").cast("string")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and u, a number in [0, 1) that depends on the document alone."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", _chance().alias("u")).mapInArrow(_sizes, f"doc_id {kind}, source string, u double, size long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds each source's target to sources (source, source_size): shares of the total by weight, filled up to the caps.

    The level rises in rounds; a round is one small aggregation, and sources over their cap are held at it.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    rank = F.row_number().over(by) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = cut(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    level = None
    held = -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(full, 1).otherwise(0)).alias("held"), F.sum("source_size").alias("all"),
        ).first()
        if row["all"] is None or row["held"] == held or not row["open"]:
            break
        held, level = row["held"], (share * row["all"] - row["caps"]) / row["open"]
    return table.withColumn("target", F.least("cap", F.col("weight") * F.lit(level if level is not None else 0.0)))


def tilt(sized: DataFrame, targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """targets (source, target, ...) with tilt, the minimiser of the dual. Sources without words or target have none.

    A Newton step divides the gradient, tilted words less target, by the second derivative, the tilted words; steps beyond 1 are damped to 1.
    """
    wanted = targets.where("target > 0 AND source_size > 0").select(F.col("source").alias("s"), "target")
    state = cut(wanted.withColumn("tilt", F.lit(0.0)))
    words = sized.where("size > 0").select("source", "size")
    for _ in range(steps):
        tilted = words.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.col("size") * F.exp("tilt")).alias("mass"), F.first("target").alias("target"), F.first("tilt").alias("tilt"))
        tilted = cut(tilted.withColumn("miss", F.col("mass") - F.col("target")))
        worst = tilted.agg(F.max(F.abs("miss") / F.col("target"))).first()[0]
        if worst is None or worst <= CLOSE:
            break
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("miss") / F.col("mass")))
        state = tilted.select("s", "target", (F.col("tilt") + step).alias("tilt"))
    return targets.join(state.select("s", "tilt"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _cut_bins(rows: DataFrame, bin_of: Column, key: list[str]) -> DataFrame:
    """For each key: the bin in which the running words pass what is still wanted, the words below it, and its own."""
    sums = rows.groupBy(*key, bin_of.alias("bin")).agg(F.sum("size").alias("mass"), F.first("wanted").alias("wanted"))
    run = F.sum("mass").over(Window.partitionBy(*key).orderBy("bin"))
    sums = sums.withColumn("upto", run).where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("mass") <= F.col("wanted")))
    return sums.select(*key, F.col("bin"), (F.col("upto") - F.col("mass")).alias("below"), "mass")


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a source: source, source_size, target, rate, whole (copies of every document), edge (one more where u is below it).

    No task gathers a source: sums are partial before each shuffle, and a histogram has BINS rows a source.
    """
    rate = F.coalesce(F.exp("tilt"), F.lit(0.0))
    plan = tilt(sized, targets).select("source", "source_size", "target", rate.alias("rate"))
    whole = F.floor(F.col("rate") + 1e-9).cast("double")  # a rate within 1e-9 of a whole number is that number
    plan = cut(plan.withColumn("whole", whole).withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    want = plan.where("wanted > 0.5").select(F.col("source").alias("s"), "wanted")
    coarse = F.floor(F.col("u") * BINS)
    fine = F.floor(F.col("u") * (BINS * BINS)) - coarse * BINS
    rows = sized.where("size > 0").join(want, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    one = cut(_cut_bins(rows, coarse, ["source"]).select(F.col("source").alias("s1"), F.col("bin").alias("bin1"), F.col("below").alias("below1")))
    inner = rows.join(one, F.col("source").eqNullSafe(F.col("s1")) & (coarse == F.col("bin1"))).withColumn("wanted", F.col("wanted") - F.col("below1"))
    two = _cut_bins(inner, fine, ["source"]).select(F.col("source").alias("s2"), F.col("bin").alias("bin2"), "below", "mass")
    # The boundary of a fine bin that comes nearer to what is wanted.
    edges = plan.join(one, F.col("source").eqNullSafe(F.col("s1")), "left").join(two, F.col("source").eqNullSafe(F.col("s2")), "left")
    over = F.when((F.col("wanted") - F.col("below1") - F.col("below")) * 2 > F.col("mass"), 1).otherwise(0)
    place = (F.col("bin1") * BINS + F.coalesce("bin2", F.lit(0)) + F.coalesce(over, F.lit(0))) / F.lit(float(BINS * BINS))
    # Where no bin passes what is wanted, every document is wanted once more.
    edge = F.when(F.col("wanted") <= 0.5, 0.0).otherwise(F.coalesce(place, F.lit(1.0)))
    return cut(edges.select("source", "source_size", "target", "rate", "whole", edge.alias("edge")))


def _plan(docs: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    if not 0 < share <= most or math.ceil(most) != most:
        raise ValueError("share must lie above 0 and up to most, a whole number")
    sized = cut(word_sizes(docs))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, source_plan(sized, source_targets(sources, weights, share, most)).withColumnRenamed("source", "tl_source")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for every row of docs."""
    sized, plan = _plan(docs, weights, share, most)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("tl_source")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("u") < F.col("edge"), 1).otherwise(0)).otherwise(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def take(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it doesn't take are gone."""
    _, plan = _plan(docs, weights, share, most)
    names = {c: fresh(docs, f"tl_{c}") for c in ("whole", "edge", "n")}
    plan = plan.select(F.col("tl_source").alias(key := fresh(docs, "tl_source")), F.col("whole").alias(names["whole"]), F.col("edge").alias(names["edge"]))
    rows = docs.join(plan, F.col("source").cast("string").eqNullSafe(F.col(key)))
    copies = (F.col(names["whole"]) + F.when(_chance() < F.col(names["edge"]), 1).otherwise(0)).cast("int")
    some = rows.where(F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & (copies > 0))
    return some.withColumn(names["n"], F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op5_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")

"""The relational algebra inside the passes, over whole tables: duplicates, orphans, closures, best candidates, roll-ups.

The same operators serve the parts of one package (group by document) and a whole corpus (no document in the key).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimlake.session import shared_folder


def saved_table(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read back: what follows doesn't start from the beginning."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Steps of a closure between two written tables, and such tables that are read side by side.
MOST_STEPS = 4
MOST_TABLES = 16


def duplicate_groups(df: DataFrame, content: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Groups of rows with equal content: digest, size, canonical (the first by order), copies, raw bytes saved. Sums are partial before the shuffle."""
    data = F.col(content)
    keyed = df.where(data.isNotNull()).select(*within, F.sha2(data.cast("binary"), 256).alias("digest"), F.octet_length(data).cast("long").alias("size"), F.col(order).alias("ord"))
    grouped = keyed.groupBy(*within, "digest", "size").agg(F.min("ord").alias("canonical"), F.count("*").alias("copies"))
    return grouped.withColumn("bytes_saved", F.col("size") * (F.col("copies") - 1))


def duplicate_map(df: DataFrame, content: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Each row that goes, with the row that stays for it. Only digests are shuffled."""
    data = F.col(content)
    keyed = df.where(data.isNotNull()).select(*within, F.col(order).alias("duplicate"), F.sha2(data.cast("binary"), 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    first = keyed.groupBy(*within, "digest", "size").agg(F.min("duplicate").alias("canonical"))
    both = keyed.join(first, [*within, "digest", "size"])
    return both.where(F.col("duplicate") != F.col("canonical")).select(*within, "duplicate", "canonical", "size")


def orphans(rows: DataFrame, references: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that nothing refers to."""
    return rows.join(references.select(*on).distinct(), list(on), "left_anti")


def referenced(rows: DataFrame, references: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that something refers to."""
    return rows.join(references.select(*on).distinct(), list(on), "left_semi")


def reachable(edges: DataFrame, roots: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within, node) for all nodes that a root leads to. edges: within, src, dst; roots: within, node.

    A frontier of new nodes moves on until it is empty, by twice as many steps from table to table up to MOST_STEPS; what has been seen is
    an anti join, so cycles end. The tables of what has been seen become one every MOST_TABLES.
    """
    keys = [*within, "node"]
    seen = frontier = saved_table(roots.select(*keys).distinct())
    edge = edges.select(*within, F.col("src").alias("node"), "dst")
    steps, tables = 1, 1
    while not frontier.isEmpty():
        at, found = frontier, []
        for k in range(1, steps + 1):
            at = at.join(edge, keys).select(*within, F.col("dst").alias("node")).distinct().join(seen, keys, "left_anti")
            found.append(at.withColumn("step", F.lit(k)))
        new = saved_table(reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.min("step").alias("step")))
        frontier = new.where(F.col("step") == steps).select(*keys)
        seen, steps, tables = seen.unionByName(new.select(*keys)), min(2 * steps, MOST_STEPS), tables + 1
        if tables % MOST_TABLES == 0:
            seen = saved_table(seen)
    return seen


def best_candidate(df: DataFrame, key: Sequence[str], size: str, rank: str, valid: str, kept: Sequence[str]) -> DataFrame:
    """The smallest valid candidate of each key, the first of equals. One aggregation, partial before its shuffle."""
    best = F.min(F.when(F.col(valid), F.struct(F.col(size), F.col(rank), *(F.col(c) for c in kept if c not in (size, rank)))))
    return df.groupBy(*key).agg(best.alias("best")).select(*key, F.col(f"best.{size}").alias(size), F.col(f"best.{rank}").alias(rank), *(F.col(f"best.{c}").alias(c) for c in kept if c not in (size, rank)))


def renumbered(values: DataFrame, value: str, name: str = "new_id") -> DataFrame:
    """Distinct values with numbers from 0 without gaps, in byte order. Numbers of a range follow those of all earlier ranges."""
    spread = values.select(value).distinct().orderBy(value)
    spread = saved_table(spread.withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(value)) - 1
    return spread.join(before, "part").select(value, (own + F.col("before")).cast("long").alias(name))


def dominant_value(df: DataFrame, group: str, value: str, least: int = 10, share: float = 0.7) -> DataFrame:
    """The value that at least `least` rows and a share of a group's rows have."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("top"))
    top = total.select(group, F.col("top.v").alias(value), (-F.col("top.k")).alias("n"), "total")
    return top.where((F.col("n") >= least) & (F.col("n") >= F.col("total") * F.lit(share)))


def unanimous_value(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    """Groups of at least `least` rows that agree on a value."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias(value), F.max(value).alias("hi"), F.count(value).alias("known"))
    return by.where((F.col("n") >= least) & (F.col("known") == F.col("n")) & (F.col(value) == F.col("hi"))).select(group, value, "n")


def islands(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of neighbours with equal value: part, run, value, rows."""
    w = Window.partitionBy(*part).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*part, "run", value).agg(F.count("*").alias("n_rows"))


def used_once(edges: DataFrame) -> DataFrame:
    """Nodes with exactly one edge to them, and where it comes from."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select("dst", "src")


def positions(df: DataFrame, part: Sequence[str], order: Sequence[str], span: Column) -> DataFrame:
    """Each row's place in its row of spans: the sum of the spans before it."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("position", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("long"))


def rolled_up(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums and counts over all prefixes of the keys; grouping_id tells the levels apart."""
    return df.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_rows"), *(F.sum(c).cast("long").alias(f"sum_{c}") for c in sums))


def first_of_equals(df: DataFrame, content: str, order: str) -> DataFrame:
    """order, content: the first row of those with equal content. Rows meet by digest, one of each task's equals."""
    first = df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(order).alias(order), F.first(content).alias(content))
    return first.select(order, content)

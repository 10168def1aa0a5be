"""Ranks and quantiles over all rows without bringing them to one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut

#: Rows of a range are numbered in the lower bits of an id, ranges in the upper ones, as monotonically_increasing_id does.
BITS = 33


def ranked(t: DataFrame, *order: str) -> DataFrame:
    """Rows with rank (from 1, in the order of columns, nulls first), n (all rows) and range.

    Rows are dealt by ranges of all columns together, so that many rows with one value are split by the columns
    behind it, and sorted there; a rank is the place in its range plus the rows of the ranges before. What meets in one
    task is a range, and one row for each range.
    """
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(t.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = placed.withColumn("range", F.shiftright("_id", BITS).cast("int"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("_n"))
    before = sizes.select("range", (F.sum("_n").over(W.orderBy("range")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("n"))
    return rows.join(F.broadcast(before), "range").withColumn("rank", F.col("_id").bitwiseAND((1 << BITS) - 1) + 1 + F.col("_before")).drop("_id", "_before")


def quantiles(t: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """A row per group (one in all without keys, of nulls where there is no value) with the linear quantiles of a column's values that aren't null, under the names of `shares`.

    Exact: values are ranked in all of their group's order, and only the two rows beside each place are looked at.
    """
    rows = ranked(t.select(*keys, value).where(F.col(value).isNotNull()), *keys, value)
    size = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.min("rank").alias("_first"))
    near = rows.crossJoin(F.broadcast(size)) if not keys else rows.join(size, [*keys])
    place = F.col("rank") - F.col("_first")
    at = {name: (F.col("_size") - 1) * F.lit(share) for name, share in shares.items()}
    one = lambda a, bound: F.max(F.when(place == bound(a), F.col(value).cast("double")))
    picked = near.where(F.array_contains(F.array(*[b(a).cast("long") for a in at.values() for b in (F.floor, F.ceil)]), place))
    out = picked.groupBy(*keys).agg(F.first("_size").alias("_size"), *[one(a, b).alias(f"_{name}_{k}") for name, a in at.items() for k, b in (("low", F.floor), ("high", F.ceil))])
    mix = {name: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (a - F.floor(a)) for name, a in at.items()}
    return out.select(*keys, *[c.alias(name) for name, c in mix.items()])

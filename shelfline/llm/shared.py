"""What the operators of this subpackage share: batch sizes and connected components."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import cut, shared_dir

__all__ = ["components", "cut", "long_rows", "shared_dir"]


def long_rows(spark: SparkSession, most: int = 500) -> None:
    """Lets Arrow batches hold `most` rows at most: documents are long, and Spark counts a batch's rows and not its bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def components(links: DataFrame) -> DataFrame:
    """Columns node, root: each node of links (a, b) with the smallest node it is connected to. Roots are left out.

    Alternating stars: every node hooks its larger neighbours, then its smaller ones, to the
    least it knows, until nothing changes; the rounds grow with the logarithm of the diameter.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now

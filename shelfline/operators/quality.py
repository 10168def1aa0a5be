"""Checks of a table of lines: summary, quality report, contracts, reliability."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import revenue


def data_summary(tx: DataFrame) -> DataFrame:
    """One row: counts, revenue, mean basket size and value, first and last date."""
    n = F.countDistinct("transaction_id")
    return tx.agg(
        F.count("*").alias("n_lines"), n.alias("n_transactions"), F.countDistinct("customer_id").alias("n_customers"), F.countDistinct("stockcode").alias("n_products"), F.sum(revenue()).alias("total_revenue"),
        (F.sum("quantity") / n).alias("avg_basket_size"), (F.sum(revenue()) / n).alias("avg_basket_value"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def capabilities(tx: DataFrame) -> DataFrame:
    """One row of yes and no: which columns there are, and whether prices vary enough for pricing analyses."""
    p = tx.groupBy("stockcode").agg((F.stddev_samp("price") / F.avg("price")).alias("cv"), F.countDistinct("price").alias("k"))
    size = tx.agg(F.countDistinct("transaction_id").alias("t"), F.countDistinct("customer_id").alias("c"), F.count("*").alias("n"))
    flags = p.agg((F.max("cv") >= 0.05).alias("has_price_variation"), (F.max("k") >= 3).alias("has_distinct_prices")).crossJoin(size)
    present = {f"has_{c}": F.lit(c in tx.columns) for c in ("category", "brand", "size", "flavor", "variant", "promo_flag", "cost", "is_online", "channel", "customer_id")}
    return flags.select("has_price_variation", "has_distinct_prices", (F.col("t") >= 100).alias("enough_baskets"), (F.col("c") >= 50).alias("enough_customers"), (F.col("n") >= 1000).alias("enough_lines"), *[v.alias(k) for k, v in present.items()])


def quality_report(tx: DataFrame, min_product_lines: int = 50, percentile: float = 0.99) -> DataFrame:
    """One row: rare products, outlier baskets, incomplete and repeated lines, and a score from 0 to 1."""
    products = tx.groupBy("stockcode").agg(F.countDistinct("transaction_id").alias("n")).agg(F.count("*").alias("n_products"), F.count_if(F.col("n") < min_product_lines).alias("low_frequency_products"))
    sizes = tx.groupBy("transaction_id").agg(F.sum("quantity").alias("s"))
    edge = sizes.agg(F.percentile("s", percentile).alias("edge"))
    baskets = sizes.crossJoin(F.broadcast(edge)).agg(F.count("*").alias("n_baskets"), F.count_if(F.col("s") > F.col("edge")).alias("outlier_baskets"), F.max("edge").alias("basket_size_limit"))
    key = ["date", "transaction_id", "stockcode", "customer_id", "price", "quantity"]
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    lines = tx.withColumn("m", missing).groupBy(*key).agg(F.count("*").alias("k"), F.max("m").alias("m")).agg(F.sum("k").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("m"), F.col("k"))), F.lit(0)).alias("incomplete_lines"), F.sum(F.col("k") - 1).alias("duplicate_lines"))
    t = products.crossJoin(baskets).crossJoin(lines)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    score = 0.25 * F.least(F.lit(1.0), F.col("n_lines") / 1000) + 0.25 * (1 - share("low_frequency_products", "n_products")) + 0.15 * (1 - share("outlier_baskets", "n_baskets")) + 0.15 * (1 - share("incomplete_lines", "n_lines")) + 0.10 * (1 - share("duplicate_lines", "n_lines")) + 0.10
    return t.withColumn("quality_score", score)


def check_contract(df: DataFrame, columns: list[str], rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule in one pass: rule, violations. Missing columns raise; a null counts as a violation."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules])).alias("x")).select("x.*")


def referential_violations(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of child that parent lacks, with their rows."""
    return child.join(parent.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def filter_by_quality(tx: DataFrame, min_product_lines: int = 50, percentile: float = 0.99) -> DataFrame:
    """Lines without rare products and outlier baskets."""
    rare = tx.groupBy("stockcode").agg(F.countDistinct("transaction_id").alias("n")).where(F.col("n") < min_product_lines).select("stockcode")
    sizes = tx.groupBy("transaction_id").agg(F.sum("quantity").alias("s"))
    edge = sizes.agg(F.percentile("s", percentile).alias("edge"))
    large = sizes.crossJoin(F.broadcast(edge)).where("s > edge").select("transaction_id")
    return tx.join(rare, "stockcode", "left_anti").join(large, "transaction_id", "left_anti")


def reliability(n_obs: Column, width: Column, estimate: Column) -> Column:
    """high, medium, low or insufficient, by observations and the width of an interval relative to its estimate."""
    size = F.least(F.lit(1.0), n_obs / 100)
    tight = F.greatest(F.lit(0.0), 1 - width / (2 * F.greatest(F.abs(estimate), F.lit(1e-9))))
    s = 0.5 * size + 0.5 * tight
    return F.when(n_obs < 5, "insufficient").when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low")

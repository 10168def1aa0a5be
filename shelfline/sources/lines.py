"""Sales lines: reading them, normalising headers and types, and the benchmark tables as lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted headers, in any case, of the seven required and the optional columns.
ALIASES = {
    "date": ["date", "transaction_date", "dt", "order_date"],
    "transaction_id": ["transaction_id", "txn_id", "order_id", "order_no", "basket_id", "invoice_no"],
    "stockcode": ["stockcode", "item_code", "sku", "sku_code", "product_code", "stock_code"],
    "product": ["product", "product_name", "item_name", "item_desc", "description"],
    "customer_id": ["customer_id", "cust_id", "client_id", "user_id", "buyer", "customer"],
    "price": ["price", "unit_price", "amount", "sales_price"],
    "quantity": ["quantity", "qty", "units", "units_sold", "quantity_sold"],
}
OPTIONAL = {
    "category": ["category", "cat", "product_category", "category_name"],
    "brand": ["brand", "brand_name", "manufacturer"],
    "size": ["size", "package_size", "unit_size"],
    "flavor": ["flavor", "flavour", "variant", "flavor_name"],
    "variant": ["variant", "variant_name", "flavor"],
    "promo_flag": ["promo_flag", "promo", "is_promo", "on_promotion", "promotion"],
    "cost": ["cost", "unit_cost", "cost_price", "wholesale_price"],
    "is_online": ["is_online", "online", "channel_online", "ecommerce"],
    "channel": ["channel", "sales_channel", "channel_name", "store_type"],
}
KINDS = {"price": "double", "quantity": "double", "cost": "double", "promo_flag": "boolean", "is_online": "boolean"}


def detect_column_mapping(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Canonical name of each source header that is known, the first alias found winning."""
    lower = {c.strip().lower(): c for c in reversed(columns)}
    return {lower[a]: name for name, known in reversed(aliases.items()) for a in reversed(known) if a in lower}


def clean_id(c: Column | str) -> Column:
    """Trimmed, without a trailing .0; null for empty text and nan."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    bare = F.regexp_replace(text, r"\.0+$", "")
    return F.when((text == "") | (F.lower(text) == "nan"), None).otherwise(bare)


def normalise(raw: DataFrame, mapping: dict[str, str] | None = None, require_customer_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid lines, and the returns (negative price or quantity). Unreadable values become null and drop the line."""
    found = {v: k for k, v in (mapping or detect_column_mapping(raw.columns)).items()}
    missing = [c for c in ALIASES if c not in found and c != "product" and (c != "customer_id" or require_customer_id)]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    extra = {v: k for k, v in detect_column_mapping(raw.columns, OPTIONAL).items()}
    source = lambda c: F.col(f"`{c}`")
    columns = {
        "date": F.try_to_timestamp(source(found["date"]).cast("string")),
        "transaction_id": clean_id(source(found["transaction_id"])),
        "stockcode": clean_id(source(found["stockcode"])),
        "product": F.coalesce(source(found["product"]).cast("string"), clean_id(source(found["stockcode"]))) if "product" in found else clean_id(source(found["stockcode"])),
        "customer_id": clean_id(source(found["customer_id"])) if "customer_id" in found else F.lit(None).cast("string"),
        "price": source(found["price"]).cast("string").try_cast("double"),
        "quantity": source(found["quantity"]).cast("string").try_cast("double"),
    } | {c: source(h).cast("string").try_cast(KINDS.get(c, "string")) for c, h in extra.items()}
    lines = raw.select(*[e.alias(c) for c, e in columns.items()])
    ids = ["date", "transaction_id", "stockcode"] + ["customer_id"] * require_customer_id
    valid = lines.where((F.col("price") > 0) & (F.col("quantity") > 0)).dropna(subset=ids)
    return valid, lines.where((F.col("price") < 0) | (F.col("quantity") < 0))


def load_transactions(spark: SparkSession, path: str, kind: str = "csv", **how) -> DataFrame:
    """Valid lines of CSV files with a header, or of Parquet, ORC or JSON files."""
    raw = spark.read.csv(path, header=True) if kind == "csv" else spark.read.format(kind).load(path)
    return normalise(raw, **how)[0]


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, orders and part as sales lines: baskets are orders, products are part names."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: F.col(c).cast("string")
    return items.select(
        F.col("o_orderdate").cast("timestamp").alias("date"),
        text("l_orderkey").alias("transaction_id"),
        text("p_name").alias("stockcode"),
        text("p_name").alias("product"),
        text("o_custkey").alias("customer_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("quantity"),
        text("p_type").alias("category"),
        text("p_brand").alias("brand"),
        text("p_size").alias("size"),
        F.col("l_discount").cast("double").alias("discount"),
    )


STAR_SQL = """tx AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS date, CAST(l_orderkey AS VARCHAR) AS transaction_id, CAST(p_name AS VARCHAR) AS stockcode,
    CAST(p_name AS VARCHAR) AS product, CAST(o_custkey AS VARCHAR) AS customer_id, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS quantity,
    CAST(p_type AS VARCHAR) AS category, CAST(p_brand AS VARCHAR) AS brand, CAST(p_size AS VARCHAR) AS size, CAST(l_discount AS DOUBLE) AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

"""Thresholds as JSON files, and tables as CSV files for spreadsheets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_thresholds(spark: SparkSession, thresholds: dict[str, float], path: str) -> None:
    """One JSON object of numbers by name in a folder, in place of what is there. Values have to be numbers."""
    row = [{str(k): float(v) for k, v in sorted(thresholds.items())}]
    table = spark.createDataFrame([(r,) for r in row], T.StructType([T.StructField("t", T.MapType(T.StringType(), T.DoubleType()))]))
    table.select(F.to_json("t").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_thresholds(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> dict[str, float]:
    """Thresholds of a file or folder over the defaults. Text that is no JSON object of numbers raises; a name with null keeps its default."""
    kind = T.MapType(T.StringType(), T.DoubleType())
    rows = spark.read.text(path, wholetext=True).where(F.trim("value") != "").select("value", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("t")).collect()
    found: dict[str, float] = {}
    for r in rows:
        if r.t is None:
            raise ValueError(f"{path} holds no JSON object of numbers")
        found |= {k: v for k, v in r.t.items() if v is not None}
    return {**(defaults or {}), **found}


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files with header. Arrays and maps are written as JSON. one_file is for reports of a bounded size only."""
    plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
    out = df.select(*plain)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

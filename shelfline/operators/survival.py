"""Survival regression: how long customers stay, from censored durations and what they bought."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, AFTSurvivalRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import revenue
from ..functions.store import cut

FEATURES = ["log_frequency", "log_monetary", "avg_items", "n_products"]


def lifetimes(tx: DataFrame, window_days: int = 90) -> DataFrame:
    """Per customer with lines before the window at the end: duration (days from first to last of them, at least 1), event and FEATURES.

    event is 1 where the window has no line, so that the last one before it was the end; else the duration goes on and is censored.
    """
    end = F.broadcast(tx.agg((F.max("date") - F.expr(f"INTERVAL {int(window_days)} DAYS")).alias("_end")))
    t = tx.crossJoin(end).withColumn("_old", F.col("date") < F.col("_end"))
    old = lambda c: F.when(F.col("_old"), c)
    g = t.groupBy("customer_id").agg(
        F.datediff(F.max(old(F.col("date"))), F.min(old(F.col("date")))).alias("d"), F.max((~F.col("_old")).cast("int")).alias("back"), F.countDistinct(old(F.col("transaction_id"))).alias("f"), F.sum(old(revenue())).alias("m"),
        F.avg(old(F.col("quantity"))).alias("avg_items"), F.countDistinct(old(F.col("stockcode"))).cast("double").alias("n_products"),
    ).where("f > 0")
    return g.select("customer_id", F.greatest(F.col("d"), F.lit(1)).cast("double").alias("duration"), (1 - F.col("back")).cast("double").alias("event"), F.log1p("f").alias("log_frequency"), F.log1p(F.greatest("m", F.lit(0.0))).alias("log_monetary"), "avg_items", "n_products")


def fit_survival(rows: DataFrame, features: list[str]) -> AFTSurvivalRegressionModel:
    """A Weibull model of accelerated failure time: log duration is linear in features, plus scale x extreme value noise."""
    v = cut(VectorAssembler(inputCols=features, outputCol="_v").transform(rows.select("duration", "event", *features).dropna()))
    return AFTSurvivalRegression(featuresCol="_v", labelCol="duration", censorCol="event", maxIter=200, tol=1e-8).fit(v)


def survival_predictions(rows: DataFrame, model: AFTSurvivalRegressionModel, features: list[str], horizon_days: int = 90) -> DataFrame:
    """Per customer: expected and median lifetime, the chance to stay beyond the horizon from now, hazard and risk (high from 0.5 on)."""
    names = list(zip(features, model.coefficients.toArray().tolist(), strict=True))
    line = sum((F.col(c) * float(b) for c, b in names), F.lit(float(model.intercept)))
    s = float(model.scale)
    from math import gamma, log

    scale = F.exp(line)
    cumulative = lambda t: F.pow(t / F.col("_scale"), F.lit(1 / s))
    t = rows.withColumn("_scale", scale)
    stay = F.exp(cumulative(F.col("duration")) - cumulative(F.col("duration") + horizon_days))
    hazard = F.pow(F.col("duration") / F.col("_scale"), F.lit(1 / s - 1)) / (s * F.col("_scale"))
    out = t.select("customer_id", "duration", "event", (F.col("_scale") * gamma(1 + s)).alias("expected_lifetime"), (F.col("_scale") * log(2) ** s).alias("median_lifetime"), stay.alias("survival_prob"), hazard.alias("hazard"))
    return out.withColumn("risk", F.when(F.col("survival_prob") < 0.5, "high").when(F.col("survival_prob") < 0.8, "medium").otherwise("low"))


def survival_diagnostics(model: AFTSurvivalRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """term, value: coefficients, intercept, scale, customers and events."""
    n, events = rows.agg(F.count("*"), F.sum("event")).first()
    pairs = [*zip(features, model.coefficients.toArray().tolist(), strict=True), ("intercept", model.intercept), ("scale", model.scale), ("n_customers", float(n)), ("n_events", float(events or 0))]
    return rows.sparkSession.createDataFrame([(k, float(v)) for k, v in pairs], "term string, value double")

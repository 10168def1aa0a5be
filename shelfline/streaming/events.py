"""Streaming forms: windowed sales, sessions and running counts over events or lines."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_events(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events, users (approximate) and value per window and type; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.approx_count_distinct("user_id").alias("n_users"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "n_users", "value")


def sessions(events: DataFrame, gap: str = "7 days", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a gap longer than `gap`."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events", "value")


def drop_repeats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all there is and stops; the checkpoint lets the next run go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


TOTALS = "user_id long, n_events long, value double, last_ts timestamp"


def running_totals(events: DataFrame, idle_days: int | None = None, late: str = "1 day") -> DataFrame:
    """A stream of each user's totals so far, a row for each batch that has events of the user.

    State is a row per user. With idle_days it is dropped so long after a user's last event, by the watermark, and totals start anew.
    """
    limit = GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.EventTimeTimeout

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, value, last = state.get if state.exists else (0, 0.0, 0)
        for part in parts:
            n, value = n + len(part), value + float(part["value"].fillna(0.0).sum())
            last = max(last, int(part["ts"].max().timestamp() * 1e6)) if part["ts"].notna().any() else last
        state.update((n, value, last))
        if idle_days is not None:
            state.setTimeoutTimestamp(max(last // 1000 + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "value": [value], "last_ts": [pd.Timestamp(last, unit="us")]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(add, TOTALS, "n long, value double, last long", "append", limit)


def latest_totals(totals: DataFrame) -> DataFrame:
    """The last row of each user of what running_totals has written."""
    last = totals.groupBy("user_id").agg(F.max(F.struct("n_events", "value", "last_ts")).alias("x"))
    return last.select("user_id", "x.*")


def sliding_values(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Value per sliding window and type."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "value")


def control_limits(history: DataFrame, sigmas: float = 3.0, window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """event_type, centre, lower, upper: mean and deviations of past windows. A table of a row per type."""
    g = sliding_values(history, window, slide).groupBy("event_type").agg(F.avg("value").alias("centre"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    return g.select("event_type", "centre", (F.col("centre") - sigmas * F.col("_s")).alias("lower"), (F.col("centre") + sigmas * F.col("_s")).alias("upper"))


def outside_limits(events: DataFrame, limits: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding windows with their limits and whether they lie outside; types without limits never do. limits are joined as a table to a stream."""
    t = sliding_values(events, window, slide, late).join(limits, "event_type", "left")
    return t.withColumn("outside", F.coalesce((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.lit(False)))


def check_batches(stream: DataFrame, rules: dict[str, str], path: str, checkpoint: str) -> None:
    """Writes, for each batch of a stream, its rows and the violations of each rule (an SQL condition; null breaks it): batch_id, rule, n_rows, violations.

    A batch that runs again after a failure replaces what it had written. Processes all there is and stops.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        broken = [F.struct(F.lit(r).alias("rule"), F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias("violations")) for r, c in rules.items()]
        batch.agg(F.array(*broken).alias("x")).select(F.lit(batch_id).cast("long").alias("batch_id"), F.inline("x")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

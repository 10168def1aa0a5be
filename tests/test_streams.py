import datetime as dt
import random

from pyspark.sql import functions as F

from shelfline.operators.promo import mark_promo_lines
from shelfline.streaming import events as E

DAY0 = dt.datetime(2024, 1, 1)


def rows(n, first, seed):
    rng = random.Random(seed)
    return [(first + i, DAY0 + dt.timedelta(hours=6 * (first + i)), rng.randrange(5), rng.choice(["buy", "view"]), float(rng.randrange(1, 50)), None) for i in range(n)]


def feed(spark, folder, part):
    """Adds a file to the source."""
    spark.createDataFrame(part, E.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_running_totals_go_on_from_their_checkpoint(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    every = []
    for k in range(3):
        every += (part := rows(60, 60 * k, k))
        feed(spark, src, part)
        E.run_to_parquet(E.running_totals(source(spark, src)), out, mark)
        got = {r.user_id: (r.n_events, r.value, r.last_ts) for r in E.latest_totals(spark.read.parquet(out)).collect()}
        users = {r[2] for r in every}
        assert got == {u: (sum(r[2] == u for r in every), sum(r[4] for r in every if r[2] == u), max(r[1] for r in every if r[2] == u)) for u in users}


def test_idle_users_start_anew(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    at = lambda days, user, i: (i, DAY0 + dt.timedelta(days=days), user, "buy", 1.0, None)
    for part in ([at(0, 1, 0), at(0, 2, 1)], [at(50, 2, 2)], [at(51, 2, 3)], [at(52, 1, 4), at(53, 2, 5)]):
        feed(spark, src, part)
        E.run_to_parquet(E.running_totals(source(spark, src), idle_days=20), out, mark)
    last = {(r.user_id, r.last_ts): r.n_events for r in spark.read.parquet(out).collect()}
    assert last[1, DAY0 + dt.timedelta(days=52)] == 1


def test_windows_outside_their_limits(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    calm = [(i, DAY0 + dt.timedelta(hours=6 * i), 1, "buy", 10.0, None) for i in range(400)]
    limits = E.control_limits(spark.createDataFrame(calm, E.EVENTS)).withColumns({"lower": F.lit(200.0), "upper": F.lit(300.0)})
    every = [(*r[:4], 1000.0 if r[0] == 200 else r[4], r[5]) for r in calm] + [(999, DAY0 + dt.timedelta(days=400), 1, "other", 5.0, None)]
    for k in range(3):
        feed(spark, src, every[k * 134 : (k + 1) * 134])
        E.run_to_parquet(E.outside_limits(source(spark, src), limits), out, mark)
    got = {(r.window_start, r.event_type): (r.value, r.outside) for r in spark.read.parquet(out).collect()}
    batch = {(r.window_start, r.event_type): (r.value, r.outside) for r in E.outside_limits(spark.createDataFrame(every, E.EVENTS), limits).collect()}
    closed = {k: v for k, v in batch.items() if k[1] == "buy"}
    assert got == closed and sum(v[1] for k, v in got.items() if DAY0 + dt.timedelta(days=43) < k[0] < DAY0 + dt.timedelta(days=51)) == 7
    assert not any(v[1] for k, v in batch.items() if k[1] == "other")


def test_contracts_of_batches_and_promotion_flags(spark, tmp_path):
    src, out, mark, flags = (str(tmp_path / x) for x in ("in", "out", "mark", "flags"))
    for k in range(2):
        feed(spark, src, [*rows(10, 10 * k, k), (500 + k, DAY0, None, "buy", -1.0, None)])
        E.check_batches(source(spark, src), {"positive": "value > 0", "user": "user_id IS NOT NULL"}, out, mark)
    got = {(r.batch_id, r.rule): (r.n_rows, r.violations) for r in spark.read.parquet(out).collect()}
    assert got == {(b, r): (11, 1) for b in (0, 1) for r in ("positive", "user")}
    lines = source(spark, src).select(F.col("ts").alias("date"), F.col("event_type").alias("stockcode"), "event_id")
    promos = spark.createDataFrame([("buy", DAY0.date(), DAY0.date())], "stockcode string, start_date date, end_date date")
    E.run_to_parquet(mark_promo_lines(lines, promos), flags, str(tmp_path / "mark2"))
    marked = spark.read.parquet(flags)
    assert marked.count() == 22 and {r.event_id for r in marked.where("is_promo").collect()} == {r.event_id for r in marked.where("stockcode = 'buy' AND to_date(date) = DATE'2024-01-01'").collect()} != set()

"""What is written leaves no shuffle files behind."""

from pathlib import Path

from pyspark.sql import functions as F

from shelfline.functions import store


def shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name.split("_")[1] for d in folder for p in Path(d).rglob("shuffle_*.data")}


def left(spark, before):
    """Files go soon after the run, not within it."""
    import time

    for _ in range(50):
        if not (now := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return now


def test_shuffle_files_go_when_rows_are_written(spark):
    df = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    for keep in (store.cut, store.stored):
        before = shuffle_files(spark)
        out = keep(df)
        assert not left(spark, before)
        assert out.count() == 1000 and out.columns == df.columns
    assert spark.conf.get(store.CLEANUP) == "false" and store.is_stored(out) and not store.is_stored(df)
    before = shuffle_files(spark)
    assert df.collect() and shuffle_files(spark) - before


def test_near_broadcasts_by_rows(spark):
    assert "broadcast" in store.near(spark.range(10), 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in store.near(spark.range(11), 10)._jdf.queryExecution().toString().lower()


def test_stored_lines_are_not_written_again_for_promotion_prices(spark):
    from shelfline.plans import commercial as C
    from shelfline.sources.lines import star_lines

    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    count = lambda: len(list(folder.glob("stored-*")))
    plain, lines = star_lines(spark, "/root/testdata/sf0.001"), store.stored(star_lines(spark, "/root/testdata/sf0.001"))
    before = count()
    kept = C.prices(lines)
    assert count() == before and C.prices(lines) is kept
    C.periods(lines)
    assert store.known(lines, "periods") and not store.known(lines, "found") and count() == before
    rows = lambda df: sorted(map(str, df.select("transaction_id", "price").collect()))
    assert rows(C.prices(plain)) == rows(kept) and count() == before + 1

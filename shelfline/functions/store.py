"""Where intermediate tables go."""

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every machine sees. Where it is unset, a session on one machine takes a folder of its own; others raise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines see")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        _gone_at_exit(spark, found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
        _gone_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return found


#: Shuffle files of a query go when it has run. Spark reads this as a DataFrame is made, not as it runs.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffles(df: DataFrame) -> Iterator[DataFrame]:
    """df, to be written within; its shuffle files go with the run, as nothing reads them after what is written. Else they stay until the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        yield df.select("*")
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder until the driver ends."""
    shared_dir(df.sparkSession)
    with _without_shuffles(df) as own:
        return own.checkpoint()


_STORED: weakref.WeakSet = weakref.WeakSet()


def stored(df: DataFrame) -> DataFrame:
    """As cut, in columns, so that a later reader takes only those it needs: for tables of many rows that are used several times."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _without_shuffles(df) as own:
        own.write.parquet(path)
    _gone_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED.add(out)
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether it came from stored, so that what follows from its rows alone needs no copy."""
    return df in _STORED


def near(df: DataFrame, most: int = 200_000) -> DataFrame:
    """For joins with tables of many rows: df is broadcast if it has at most so many rows. df is counted, so it should be cut or made from what is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_KNOWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def once(tx: DataFrame, name: str, build: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """build(), computed once for each tx and name, however many parts of a query ask for it."""
    own = _KNOWN.setdefault(tx, {})
    if name not in own:
        own[name] = keep(build())
    return own[name]


def known(tx: DataFrame, name: str) -> bool:
    """Whether once has built it."""
    return name in _KNOWN.get(tx, {})

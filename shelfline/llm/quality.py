"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words, hashed to BUCKETS and weighted 1/sqrt(words), and
standardised statistics of its structure and metadata (length in bytes, words and
lines, shares of kinds of bytes, repetition). The score is the logistic of
w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs take linear time, as
half of sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

The model is fitted by Adam on at most MAX_ROWS labelled documents, those whose ids
hash lowest; that bound is a parameter.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .language import id_class
from .shared import long_rows

BUCKETS = 1 << 14
FACTORS = 8
MAX_ROWS = 6000
EPOCHS = 12
STEP = 1 << 19
STATISTICS = 14


@dataclass
class FactorMachine:
    bias: float
    weight: np.ndarray  # BUCKETS + STATISTICS
    factor: np.ndarray  # the same x FACTORS
    mean: np.ndarray
    spread: np.ndarray


def _share(flags: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]) / size


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, words before each value (n + 1), a word's weight in each value, and the statistics of each value."""
    raw, at = K.arrow_bytes(pc.cast(column, pa.large_string()))
    n_bytes = np.diff(at)
    size = np.maximum(n_bytes, 1)
    data, offsets = K.lines_of(column)
    start, end, words = K.words_of(data, offsets)
    name = K.word_hashes(data, start, end)
    n = np.diff(words)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(name), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    # different words, by buckets of a small table of each value
    seen = np.unique(doc * 4096 + (name >> np.uint64(52)).astype(np.int64)) // 4096 if len(name) else np.zeros(0, np.int64)
    line_end = data == 10
    stats = np.column_stack([
        np.log1p(n_bytes),
        np.log1p(n),
        np.log1p(np.diff(np.concatenate([[0], np.cumsum(line_end)])[offsets])),
        _share((raw >= 65) & (raw <= 90), at, size),
        _share((raw >= 48) & (raw <= 57), at, size),
        _share((raw == 32) | (raw == 10), at, size),
        _share((raw == 46) | (raw == 44), at, size),
        _share(((raw > 32) & (raw < 48) & (raw != 44) & (raw != 46)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127)), at, size),
        _share(raw >= 128, at, size),
        _share(raw == 33, at, size),
        np.diff(np.concatenate([[0], np.cumsum(end - start)])[words]) / some,
        np.diff(np.concatenate([[0], np.cumsum(same)])[words]) / some,
        np.bincount(seen, minlength=len(n)) / np.minimum(some, 4096),
        (n == 0).astype(float),
    ])
    return (name >> np.uint64(64 - 14)).astype(np.int64), words, 1 / np.sqrt(some), stats


def _sums(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sum of the values of each document's words."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[words[1:]] - total[words[:-1]]


def margin(m: FactorMachine, bucket: np.ndarray, words: np.ndarray, weight: np.ndarray, stats: np.ndarray):
    """Score before the logistic, and the factor sums that the gradient needs."""
    x = np.clip((stats - m.mean) / m.spread, -4, 4)
    w, v = m.weight[BUCKETS:], m.factor[BUCKETS:]
    linear = m.bias + _sums(m.weight[bucket], words) * weight + x @ w
    q = _sums(m.factor[bucket], words) * weight[:, None] + x @ v
    square = _sums((m.factor**2).sum(axis=1)[bucket], words) * weight**2 + (x**2) @ (v**2).sum(axis=1)
    return linear + 0.5 * ((q**2).sum(axis=1) - square), q, x


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorMachine:
    r = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    stats = np.array([s for _, s in rows]) if rows else np.zeros((1, STATISTICS))
    m = FactorMachine(0.0, np.zeros(size), r.normal(0, 0.02, (size, FACTORS)), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3))
    if not rows or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        m.bias, m.factor = float(np.log(p / (1 - p))), np.zeros((size, FACTORS))
        return m
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    state, step, rate = {k: [0.0, 0.0] for k in ("bias", "weight", "factor")}, 0, 0.02
    for _ in range(EPOCHS):
        order = r.permutation(len(rows))
        for some in np.array_split(order, max(1, len(order) // 128)):
            bucket = np.concatenate([rows[i][0] for i in some])
            n = np.array([len(rows[i][0]) for i in some])
            words, weight = np.concatenate([[0], np.cumsum(n)]), 1 / np.sqrt(np.maximum(n, 1))
            z, q, x = margin(m, bucket, words, weight, stats[some])
            e = (1 / (1 + np.exp(-z)) - labels[some]) / len(some)
            ew = np.repeat(e * weight, n)
            gw = np.concatenate([np.bincount(bucket, ew, BUCKETS), x.T @ e]) + 1e-5 * m.weight
            gv = np.empty_like(m.factor)
            ew2 = np.bincount(bucket, np.repeat(e * weight**2, n), BUCKETS)
            for f in range(FACTORS):
                gv[:BUCKETS, f] = np.bincount(bucket, np.repeat(e * weight * q[:, f], n), BUCKETS) - ew2 * m.factor[:BUCKETS, f]
            gv[BUCKETS:] = (x * e[:, None]).T @ q - ((x**2).T @ e)[:, None] * m.factor[BUCKETS:]
            gv += 1e-4 * m.factor
            step += 1
            for name, g in (("bias", e.sum()), ("weight", gw), ("factor", gv)):
                a, b = state[name]
                a, b = state[name] = [0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g]
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
                setattr(m, name, getattr(m, name) - move)
    return m


def _slices(column):
    for t in K.blocks(pa.table({"t": column}), pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), STEP):
        yield t["t"]


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> FactorMachine:
    """Fits on at most max_rows labelled ids, lowest hash first; the mean of an id's labels counts, null labels don't."""
    long_rows(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            at = 0
            for part in _slices(batch.column(0)):
                bucket, words, _, stats = features(part)
                listed = pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([listed, pa.array(list(stats), pa.list_(pa.float64())), pa.array(y[at : at + len(part)])], names=["bucket", "stats", "y"])
                at += len(part)

    got = rows.mapInArrow(extract, "bucket array<int>, stats array<double>, y double").orderBy(F.xxhash64("bucket", "stats", "y")).limit(max_rows).toArrow()
    data = [(np.array(b, dtype=np.int64), np.array(s)) for b, s in zip((x.values.to_numpy() for x in got["bucket"]), got["stats"].to_pylist(), strict=True)] if got.num_rows else []
    return _fit(data, got["y"].to_numpy() if got.num_rows else np.zeros(0))


def score(spark: SparkSession, model: FactorMachine, text: Column | str) -> Column:
    """Probability of label 1, from 0 to 1; null text counts as empty, and empty texts get a score too."""
    long_rows(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [1 / (1 + np.exp(-np.clip(margin(shared.value, *features(part))[0], -40, 40))) for part in _slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            K.release()

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_class("doc_id", 5) != 0)
    model = fit_quality(docs, labels)
    got = docs.select("doc_id", (id_class("doc_id", 5) == 0).alias("held_out"), score(spark, model, "text").alias("score"))
    return got.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))

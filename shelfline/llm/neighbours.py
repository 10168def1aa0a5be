"""Approximate nearest neighbours by multiprobe p-stable hashing.

Equal vectors form a class with its smallest ids. Vectors are mapped to the unit sphere so that the
largest inner product is the smallest distance (x/M with sqrt(1 - |x|^2/M^2) appended, M the largest
norm; queries are scaled to 1). A table hashes a vector by PROJECTIONS functions floor((a.x + b)/w),
a of the 2-stable normal distribution. For a query and a neighbour at inner product t, the neighbour's
projection is normal with mean t(a.q) and variance 1 - t^2; a bucket's chance is the product over the
functions. A query visits the buckets around its own in order of that chance until the chances add
up to TARGET, in each of TABLES tables; only the rows of these buckets are gathered and compared, and
the candidates of all tables are merged and reranked by their exact inner product in double
precision. t comes from SAMPLE queries scanned in full: the similarity of their k-th neighbour, at
the quantile CALIBRATION of the sample. The number of functions grows with the logarithm of the table.

Buckets that agree in their first functions make a part of the index; a part with many rows, be it
of one bucket, is cut into slices. A slice is read once and keeps its buckets in order, and the
queries that visit one of its buckets stream past it, so a task's memory is bounded by a slice, and
each vector is sent once a table.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

TABLES, WIDTH = 2, 1.6
#: Rows of a bucket, about, and functions at most.
BUCKET_ROWS, MOST_PROJECTIONS = 64, 24
#: Buckets per function that count; the outermost are open.
CELLS = 3
TARGET = 0.88
#: Chance below which a bucket is not followed up.
LEAST = 1e-5
SAMPLE, CALIBRATION = 64, 0.1
SLICE_ROWS, QUERY_ROWS = 16384, 256
K = 20
EVERY = 20


@dataclass
class Index:
    """Projections of each table, offsets, and the similarity that probing aims at."""

    a: np.ndarray  # table x projection x dimension + 1
    b: np.ndarray
    norm: float
    t: float

    @property
    def functions(self) -> int:
        return self.a.shape[1]

    @property
    def powers(self) -> np.ndarray:
        """The first function has the largest weight in a bucket's code."""
        return CELLS ** np.arange(self.functions - 1, -1, -1)


def _matrix(column, dim: int) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64)
    return flat.reshape(-1, dim)


def _cells(index: Index, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each vector along each function, in units of the width, and its cell."""
    p = (x @ index.a[table].T + index.b[table]) / WIDTH
    return p, np.clip(np.floor(p) + CELLS // 2, 0, CELLS - 1).astype(np.int64)


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))], axis=1)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """By the logistic-like form of Page (error under 2e-4), enough to order buckets."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -40, 40)))


def probes(index: Index, q: np.ndarray, table: int) -> Iterator[np.ndarray]:
    """For each query the buckets to visit, likeliest first."""
    mean = index.t * (q @ index.a[table].T) + index.b[table]
    spread = np.sqrt(max(1e-6, 1 - index.t**2))
    edges = (np.arange(1, CELLS) - CELLS // 2) * WIDTH
    below = _normal_cdf((edges[None, None, :] - mean[:, :, None]) / spread)
    chance = np.diff(np.concatenate([np.zeros((*mean.shape, 1)), below, np.ones((*mean.shape, 1))], axis=2), axis=2)
    for c in chance:
        p, code = np.ones(1), np.zeros(1, np.int64)
        for f in range(index.functions):
            p = (p[:, None] * c[f][None, :]).ravel()
            code = (code[:, None] * CELLS + np.arange(CELLS)[None, :]).ravel()
            some = p >= LEAST
            p, code = p[some], code[some]
        order = np.argsort(-p, kind="stable")
        stop = int(np.searchsorted(np.cumsum(p[order]), TARGET)) + 1
        yield code[order[:stop]]


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, vector (array of double) and key (equal for equal vectors) of the rows that take part."""
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    own = rows.where(F.col(vec_id).isNotNull()).where(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    return own.select("id", "vector", F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")).alias("key"))


def classes(own: DataFrame, keep: int) -> DataFrame:
    """key, rep, vector, ids (the `keep` smallest) of each class of equal vectors.

    In two steps, so that a class with many rows is dealt out before its ids meet.
    """
    least = lambda ids: F.slice(F.array_sort(ids), 1, keep)
    some = own.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least(F.collect_set("id")).alias("ids"), F.min_by("vector", "id").alias("vector"))
    whole = some.groupBy("key").agg(least(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.min_by("vector", F.col("ids")[0]).alias("vector"))
    return whole.select("key", F.col("ids")[0].alias("rep"), "vector", "ids")


def _best(x: np.ndarray, q: np.ndarray, score: np.ndarray, at: np.ndarray, ids: list, k: int) -> list[dict]:
    """The k best ids of the classes x[at] for one query, ties to the smaller id; score is near enough to choose by."""
    if len(at) > k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        at = at[score >= bound - 1e-9 * (1 + abs(bound))]
    exact = (x[at] * q).sum(axis=1)
    return [{"minus": m, "vec_id": v} for m, v in sorted((-e, v) for e, i in zip(exact.tolist(), at.tolist(), strict=True) for v in ids[i])[:k]]


TOP = "array<struct<minus:double,vec_id:long>>"
_TOP = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))


def fit_index(found: DataFrame, n: int, dim: int, k: int, seed: int = 11) -> Index:
    """Random projections, the largest norm, and the aimed similarity from SAMPLE queries that scan every class."""
    r = np.random.default_rng(seed)
    norm = found.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, v: t + v * v)))).first()[0] or 1.0
    sample = found.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "vector").toArrow()
    q, own = _matrix(sample["vector"], dim), sample["rep"].to_pylist()
    size = np.sqrt((q**2).sum(axis=1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [[] for _ in own]
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            s = q @ x.T
            ids = batch.column(2).to_pylist()
            for i, o in enumerate(own):
                new = _best(x, q[i], s[i], np.arange(len(ids)), ids, k + 1)
                top[i] = sorted([*top[i], *((y["minus"], y["vec_id"]) for y in new if y["vec_id"] != o)])[:k]
        yield pa.RecordBatch.from_pylist([{"i": i, "minus": m, "vec_id": v} for i, x in enumerate(top) for m, v in x], schema=pa.schema([("i", pa.int64()), ("minus", pa.float64()), ("vec_id", pa.int64())]))

    near = found.select("rep", "vector", "ids").mapInArrow(scan, "i long, minus double, vec_id long").groupBy("i").agg(F.slice(F.array_sort(F.collect_list("minus")), 1, k).alias("m")).collect()
    sims = [-x.m[-1] / (size[x.i] * norm) for x in near if x.m]
    t = float(np.clip(np.quantile(sims, CALIBRATION), 0.0, 0.999)) if sims else 0.5
    functions = int(np.clip(round(np.log(max(n, 1) / BUCKET_ROWS) / np.log(CELLS)), 1, MOST_PROJECTIONS))
    return Index(r.normal(size=(TABLES, functions, dim + 1)), r.random((TABLES, functions)) * WIDTH - WIDTH / 2, float(norm), t)


class Slice:
    """Rows of some buckets, in order of bucket, with a directory of where each bucket begins and ends."""

    def __init__(self, code: np.ndarray, x: np.ndarray, ids: list):
        order = np.argsort(code, kind="stable")
        self.x, self.ids = x[order], [ids[i] for i in order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.stop = np.append(self.first[1:], len(order))

    def search(self, q: np.ndarray, buckets: list[np.ndarray], k: int) -> Iterator[tuple[list[dict], int]]:
        """For each query its k best rows of the buckets it visits, and how many rows it was compared with."""
        asked = np.concatenate(buckets)
        who = np.repeat(np.arange(len(q)), [len(b) for b in buckets])
        at = np.minimum(np.searchsorted(self.code, asked), len(self.code) - 1)
        here = self.code[at] == asked
        at, who = at[here], who[here]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        some, begin = np.unique(at, return_index=True)
        found, rows, scores, seen = [], [], [], np.zeros(len(q), np.int64)
        for b, w in zip(some.tolist(), np.split(who, begin[1:]) if len(some) else [], strict=True):
            lo, hi = self.first[b], self.stop[b]
            s = q[w] @ self.x[lo:hi].T
            seen[w] += hi - lo
            bound = np.partition(s, hi - lo - k, axis=1)[:, [hi - lo - k]] if hi - lo > k else np.full((len(w), 1), -np.inf)
            i, j = np.nonzero(s >= bound - 1e-9 * (1 + np.abs(bound)) if hi - lo > k else np.ones_like(s, bool))
            found.append(w[i])
            rows.append(lo + j)
            scores.append(s[i, j])
        if not found:
            return (([], 0) for _ in range(len(q)))
        found, rows, scores = np.concatenate(found), np.concatenate(rows), np.concatenate(scores)
        order = np.argsort(found, kind="stable")
        cuts = np.searchsorted(found[order], np.arange(1, len(q)))
        own = zip(np.split(rows[order], cuts), np.split(scores[order], cuts), strict=True)
        return ((_best(self.x, q[i], s, r, self.ids, k) if len(r) else [], int(seen[i])) for i, (r, s) in enumerate(own))


DEALT = "part long, asks int, id long, vector array<double>, bucket long, ids array<long>, buckets array<long>"
_DEALT = pa.schema([("part", pa.int64()), ("asks", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("bucket", pa.int64()), ("ids", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int64()))])


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score, compared: for each query its k nearest rows found, the query's own row left out.

    compared is the number of rows that the query was compared with, over all tables; rows with equal vectors count once.
    queries has the same columns as rows, and ids from it. Null, empty and zero vectors, vectors with null or
    non-finite components or with a dimension other than the first usable one's, and rows with a null id take no part.
    Rows that share an id and vector count once; rows that share an id and differ are rows of their own, of which a
    result names an id once, with its best score. Other columns are not read.
    """
    spark = rows.sparkSession
    every = cut(classes(usable(rows, vec_id, vector), k + 1))
    one = every.orderBy("rep").limit(1).select(F.size("vector")).first()
    dim = one[0] if one else 1
    every = every.where(F.size("vector") == dim)
    asking = usable(queries, vec_id, vector).where(F.size("vector") == dim)
    asked = classes(asking, 1)
    n = every.count()
    index = fit_index(every, n, dim, k)
    shared = spark.sparkContext.broadcast(index)
    # parts are ranges of bucket codes: buckets that agree in their first functions
    codes = CELLS**index.functions
    parts = int(max(1, min(codes, -(-n // SLICE_ROWS))))

    def part_of(code: np.ndarray) -> np.ndarray:
        return np.minimum((code / codes * parts).astype(np.int64), parts - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lift(_matrix(batch.column(1), dim), shared.value.norm)
            for table in range(TABLES):
                code = _cells(shared.value, x, table)[1] @ shared.value.powers
                blank = pa.nulls(len(code), pa.list_(pa.int64()))
                columns = [pa.array(table * parts + part_of(code)), pa.array(np.zeros(len(code), np.int32)), batch.column(0), batch.column(1), pa.array(code), batch.column(2), blank]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _DEALT, strict=True)], schema=_DEALT)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), dim)
            unit = np.concatenate([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)
            for table in range(TABLES):
                visits = [(table * parts + p, i, codes_[own == p]) for i, codes_ in enumerate(probes(shared.value, unit, table)) for own in [part_of(codes_)] for p in np.unique(own)]
                at = pa.array([i for _, i, _ in visits], pa.int64())
                none = pa.nulls(len(visits), pa.int64())
                columns = [pa.array([p for p, _, _ in visits], pa.int64()), pa.array(np.ones(len(visits), np.int32)), batch.column(0).take(at), batch.column(1).take(at), none, pa.nulls(len(visits), pa.list_(pa.int64())), pa.array([c for _, _, c in visits], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _DEALT, strict=True)], schema=_DEALT)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, those of the index first; queries stream past the slice of their part."""
        part, held, own = None, [], None
        for whole in batches:
            for begin in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(begin, QUERY_ROWS)
                key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows_ = batch.slice(a, b - a)
                    if key[0, a] != part:
                        part, held, own = key[0, a], [], None
                    if not key[1, a]:
                        held.append(rows_)
                        continue
                    if held:
                        t = pa.Table.from_batches(held)
                        own, held = Slice(t["bucket"].to_numpy(), _matrix(t["vector"], dim), t["ids"].to_pylist()), []
                    if own:
                        buckets = [x.values.to_numpy() for x in rows_.column(6)]
                        got = [{"query": i, "top": top, "compared": seen} for i, (top, seen) in zip(rows_.column(2).to_pylist(), own.search(_matrix(rows_.column(3), dim), buckets, k + 1), strict=True)]
                        yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("query", pa.int64()), ("top", _TOP), ("compared", pa.int64())]))

    placed = every.select("rep", "vector", "ids").mapInArrow(place, DEALT)
    slices = placed.groupBy("part").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))
    placed = placed.join(slices, "part").withColumn("slice", F.pmod(F.xxhash64("id"), "slices"))
    sent = asked.select("rep", "vector").mapInArrow(ask, DEALT).join(slices, "part").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    dealt = placed.unionByName(sent).withColumn("part", F.shiftleft("part", 24) + F.col("slice")).select(*_DEALT.names)
    tops = dealt.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(rerank, f"query long, top {TOP}, compared long")
    merged = tops.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("top"))).alias("every"), F.sum("compared").alias("compared"))
    # what two tables found, or an id with several vectors, stands several times: the best one counts
    best = F.transform(F.array_distinct(F.transform("every", lambda x: x["vec_id"])), lambda v: F.get(F.filter("every", lambda x: x["vec_id"] == v), F.lit(0)))
    merged = merged.select("query", F.slice(F.array_sort(best), 1, k + 1).alias("top"), "compared")
    ids = asking.select("id", "key").distinct().join(asked.select("key", "rep"), "key").join(merged, F.col("rep") == F.col("query"))
    own = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return ids.select(F.col("id").alias("query_id"), "compared", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"), "compared")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))

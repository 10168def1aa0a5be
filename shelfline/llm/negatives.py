"""Hard negatives: high-scoring rows of other labels, with scores bounded by segment summaries first.

A vector is cut into segments; each keeps its mean and deviation. Over a segment of length m two
vectors' product lies in m x (product of means +- product of deviations), so the sums over segments bound a
score. Pairs that bounds over PARTS[0] segments leave open are bounded again over PARTS[1], and
what is still open is scored exactly, in integers.

Anchors are dealt into groups and rows into slices; a task holds one group and streams one slice past it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: Segments of the first and of the second bound.
PARTS = (4, 16)
#: Anchors of a group, rows that meet them at once, and rows of a slice. Fewer where vectors are very wide.
ANCHORS, ROWS, SLICE = 1024, 1024, 16_384
VALUES = 1 << 22
#: With a larger share of open pairs one product of whole matrices takes the place of pair by pair.
DENSE = 0.05
#: Relative and absolute slack of bounds, for rounding.
SLACK = (1e-9, 1e-6)
MOST = (1 << 63) - 1


class Side:
    """Vectors with their ids, labels, lengths and summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray):
        self.ids, self.labels, self.whole, self.x = ids, labels, whole, whole.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.sums = []
        for parts in PARTS:
            cells = self.x.reshape(len(ids), parts, -1)
            root, mean = np.sqrt(cells.shape[2]), cells.mean(axis=2)
            self.sums.append((mean * root, np.sqrt(((cells - mean[:, :, None]) ** 2).mean(axis=2)) * root))


def open_pairs(a: Side, r: Side, allowed: np.ndarray, need: np.ndarray, most: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of all allowed pairs with need <= score <= most of the anchor; exact: doubles hold every score."""
    (am, ad), (rm, rd) = a.sums[0], r.sums[0]
    middle, spread = am @ rm.T, ad @ rd.T + (SLACK[0] * np.outer(a.norm, r.norm) + SLACK[1])
    keep = allowed & (np.maximum(middle + spread, -MOST) >= need[:, None]) & (np.minimum(middle - spread, MOST) <= most[:, None])
    if exact and keep.mean() > DENSE:
        score = a.x @ r.x.T
        i, j = np.nonzero(keep & (score >= need[:, None]) & (score <= most[:, None]))
        return i, j, score[i, j].astype(np.int64)
    i, j = np.nonzero(keep)
    (am, ad), (rm, rd) = a.sums[1], r.sums[1]
    middle = np.einsum("ij,ij->i", am[i], rm[j])
    spread = np.einsum("ij,ij->i", ad[i], rd[j]) + SLACK[0] * a.norm[i] * r.norm[j] + SLACK[1]
    keep = (np.maximum(middle + spread, -MOST) >= need[i]) & (np.minimum(middle - spread, MOST) <= most[i])
    i, j = i[keep], j[keep]
    if exact:
        score = np.einsum("ij,ij->i", a.x[i], r.x[j]).astype(np.int64)
    else:
        score = np.array([max(-MOST, min(MOST, sum(int(u) * int(v) for u, v in zip(a.whole[p], r.whole[q], strict=True)))) for p, q in zip(i, j, strict=True)], dtype=np.int64)
    keep = (score >= need[i]) & (score <= most[i])
    return i[keep], j[keep], score[keep]


class Tops:
    """The k best (largest score, then smallest id) of each of several units, kept as rows come."""

    def __init__(self, units: int, k: int):
        self.k, self.own = k, np.zeros((3, 0), np.int64)
        self.score, self.id = np.full(units, -MOST - 1), np.full(units, MOST)

    def add(self, unit: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[unit]) | ((score == self.score[unit]) & (ids < self.id[unit]))
        rows = np.concatenate([self.own, np.stack([unit[better], score[better], ids[better]])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, bool)
        place = np.arange(rows.shape[1]) - np.maximum.accumulate(np.where(first, np.arange(rows.shape[1]), 0))
        self.own, last = rows[:, place < self.k], place == self.k - 1
        self.score[rows[0, last]], self.id[rows[0, last]] = rows[1, last], rows[2, last]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, behind their end 0."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(rows: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v: rows that take part, an id once, vectors as integers."""
    x = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).where(~F.exists(x, bad))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _search(rows: DataFrame, anchors: DataFrame, n: int, asked: int, width: int, exact: bool, k: int, low: int, high: int) -> DataFrame:
    """Bests of each group and slice. Anchors have `wanted`, their (score, vec_id) positives, null in the search for positives."""
    wide = max(1, VALUES // width)
    group, batch_rows, slice_rows = min(ANCHORS, wide), min(ROWS, wide), min(SLICE, 16 * wide)
    groups, slices = max(1, -(-asked // group)), max(1, -(-n // slice_rows))
    slice_of, group_of = F.pmod(F.xxhash64("vec_id"), F.lit(slices)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))
    many = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = anchors.select(group_of.alias("g"), many(slices).alias("s"), F.lit(0).alias("side"), "vec_id", "label", "v", "wanted")
    right = rows.select(many(groups).alias("g"), slice_of.alias("s"), F.lit(1).alias("side"), "vec_id", "label", "v", F.lit(None).cast("array<struct<score: long, vec_id: long>>").alias("wanted"))
    dealt = left.unionByName(right).repartition(min(groups * slices, 20_000), "g", "s").sortWithinPartitions("g", "s", "side")
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "found_id", "score")])

    def result(a: Side, units: list, tops: Tops) -> pa.RecordBatch:
        unit, score, found = tops.own
        own = np.array(units, np.int64).reshape(-1, 5)[unit]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a.ids[own[:, 0]], own[:, 1], own[:, 2], found, score)], schema=schema)

    def compare(a: Side, r: Side, units: np.ndarray, tops: Tops, negatives: bool) -> None:
        at = units[:, 0]
        if not negatives:
            i, j, score = open_pairs(a, r, (a.labels[:, None] == r.labels) & (a.ids[:, None] != r.ids), tops.score, np.full(len(a.ids), MOST), exact)
            tops.add(i, score, r.ids[j])
            return
        floor = np.maximum(units[:, 3], tops.score)
        need, most = np.full(len(a.ids), MOST), np.full(len(a.ids), -MOST)
        np.minimum.at(need, at, floor)
        np.maximum.at(most, at, units[:, 4])
        i, j, score = open_pairs(a, r, a.labels[:, None] != r.labels, need, most, exact)
        first, count = np.searchsorted(at, np.arange(len(a.ids))), np.bincount(at, minlength=len(a.ids))
        for nth in range(int(count.max(initial=0))):
            has = count[i] > nth
            unit = first[i[has]] + nth
            fits = (score[has] >= units[unit, 3]) & (score[has] <= units[unit, 4])
            tops.add(unit[fits], score[has][fits], r.ids[j[has][fits]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, a, units, tops, negatives = None, [], None, None, None, False
        for whole in batches:
            names = {name: k for k, name in enumerate(whole.schema.names)}
            keys = np.stack([whole.column(names[c]).to_numpy().astype(np.int64) for c in ("g", "s", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), whole.num_rows]
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                if b == e:
                    continue
                if (keys[0, b], keys[1, b]) != key:
                    if a is not None:
                        yield result(a, units, tops)
                    key, held, a = (keys[0, b], keys[1, b]), [], None
                if keys[2, b] == 0:
                    held.append(whole.slice(b, e - b))
                    continue
                if a is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    a = Side(t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"].combine_chunks(), width))
                    wanted, held = t["wanted"].to_pylist(), []
                    negatives = any(w is not None for w in wanted)
                    if negatives:
                        units = [(p, w["vec_id"], w["score"], -(-low * w["score"] // 100), high * w["score"] // 100) for p, ws in enumerate(wanted) for w in ws]
                    else:
                        units = [(p, -1, 0, 0, 0) for p in range(len(a.ids))]
                    # the bounds of a score outside 64 bits are never met or always, as those at its ends
                    units = np.array([[max(-MOST, min(MOST, x)) for x in u] for u in units], np.int64).reshape(-1, 5)
                    tops = Tops(len(units), k)
                if a is None:
                    continue
                for start in range(b, e, batch_rows):
                    some = whole.slice(start, min(batch_rows, e - start))
                    r = Side(some.column(names["vec_id"]).to_numpy(), some.column(names["label"]).to_numpy(), _matrix(some.column(names["v"]), width))
                    compare(a, r, units, tops, negatives)
        if a is not None:
            yield result(a, units, tops)

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, found_id long, score long")


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows for which the SQL condition is_anchor on vec_id and label holds. An anchor's positives are its best
    `positives` other rows of the same label; its negatives for one of them the best `negatives` of other labels whose score is
    `low` to `high` per cent of the positive's (none for a negative score, only 0 for 0). Scores are inner
    products of components floored after `scale`-fold; ties go to the smaller id.

    Rows with a null id, label or vector or a null or non-finite component take no part. Rows that share an id count once, with the
    smallest label, then vector. Shorter vectors count as filled up with 0, empty ones too. Components and scores beyond
    64 bits count as the largest such. Other columns are not read. No anchors, labels of one row and labels without others give no rows.
    """
    every = cut(usable(rows, scale, vec_id, vector, label))
    n, width, large, asked = every.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.count(F.when(F.expr(is_anchor), 1))).first()
    step = max(PARTS)
    width = -(-max(width or 1, 1) // step) * step
    exact = width * (large or 0.0) ** 2 < 2.0**53
    anchors = every.where(is_anchor)
    none = anchors.withColumn("wanted", F.lit(None).cast("array<struct<score: long, vec_id: long>>"))
    shape = (n, asked, width, exact)
    place = lambda *own: F.row_number().over(W.partitionBy(*own).orderBy(F.col("score").desc(), "found_id"))
    first = _search(every, none, *shape, positives, low, high).withColumn("rank", place("anchor_id")).where(F.col("rank") <= positives)
    # at most `positives` entries an anchor
    wanted = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("score", F.col("found_id").alias("vec_id"))).alias("wanted"))
    found = _search(every, cut(anchors.join(wanted, "vec_id")), *shape, negatives, low, high)
    found = found.withColumn("rank", place("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "vec_id % 50 = 0")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a, p.b, p.score AS ps, s.b AS nb, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""

"""Near-duplicate documents by improved consistent weighted sampling.

Words are runs of letters and digits, lower-cased; a document's features are its
shingles of five words (a shorter text is one shingle), weighted by term frequency
times (1 + IDF_GAIN x idf), idf = ln((N+1)/(df+1)) / ln(N+1) between 0 and 1. The gain is
small on purpose: with plain idf a large group of near copies makes what they share
cheap and their edits dear, and true copies fall below the threshold as the group grows.

1. Texts with the same words form one class, whose smallest id stands for it.
2. Blocks of documents send each class's shingles and its number of documents to shards, which
   add them up over the corpus and answer with the document frequencies.
3. Each class is sampled BANDS x ROWS times; a shingle's chance is in proportion to its
   weight, so two samples agree with the probability of the weighted Jaccard similarity.
   Classes that agree on a band share a bucket.
4. Each bucket's members are compared with one of them, by the exact weighted Jaccard
   similarity, and what is linked becomes a part (connected components). Then, in each
   bucket with several parts, the members outside the largest part are compared with all
   of the bucket, so that every pair that shares a bucket is either compared or already
   connected. Components of all links are the groups, the same as from all pairs.

A bucket is split into cells of CELL shingles: the few members outside the largest part go
to every cell, the others to one. With every_link all members count as outside, and a bucket
of m members sends m times its number of cells.

The chance that a pair of similarity 0.8 shares no bucket, and so can be missed, is under 0.001.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, cut, long_rows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
IDF_GAIN = 0.1
#: Text of one block, and of the blocks whose shingles one shard could hold.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
STEP = 1 << 19
#: Shingles of a cell, about, so that two cells fit in a task; a document adds OWN for its row.
CELL, OWN = 1 << 17, 1 << 7
#: Shingles that are sampled at once, so that the work stays in the processor's cache.
TILE = 1 << 15
_r = np.random.default_rng(20240229)
_R = _r.gamma(2.0, 1.0, 1 << 16)
_BETA = _r.random(1 << 16)
_C = _r.gamma(2.0, 1.0, 1 << 16)
R = _R.astype(np.float32)
R_INVERSE = (1 / _R).astype(np.float32)
BETA = _BETA.astype(np.float32)
D = (np.log(_C) - _R + _R * _BETA).astype(np.float32)
ODD = _r.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column, counted: bool = True):
    """For slices of a column: hash and count of each value's different shingles, values' bounds (n + 1), and two arrays of content keys.

    Uncounted, shingles stay in the order of the text, repeats included, for uses that want the keys only.
    """
    for table in K.blocks(pa.table({"t": column}), K.sizes(column), STEP):
        data, offsets = K.lines_of(table["t"])
        start, end, words = K.words_of(data, offsets)
        s = K.prefix_hashes(data)
        name = K.span_hash(s, start, end)
        # a shingle's hash from its words' hashes, by powers of an odd number
        chain, down = K.powers(len(name) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(name * chain[: len(name)])])
        n = np.diff(words)
        has = n > 0
        size = np.minimum(n, SHINGLE)
        many = np.where(has, n - size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(many)])
        first = np.arange(bounds[-1]) + np.repeat(words[:-1] - bounds[:-1], many)
        width = np.repeat(size, many)
        h = K.mix((total[first + width] - total[first]) * down[first] + width.astype(np.uint64))
        del first, width
        key = np.where(has, K.mix((total[words[1:]] - total[words[:-1]]) * down[words[:-1]]), K.span_hash(s, offsets[:-1], offsets[1:]))
        least = np.zeros(len(n), np.uint64)
        if len(h):
            least[has] = np.minimum.reduceat(h, bounds[:-1][has])
        second = np.where(has, n.astype(np.uint64) << np.uint64(20) ^ least >> np.uint64(8), ~np.uint64(0))
        counts = np.ones(len(h), np.int64)
        if counted and len(h):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                h[a:b].sort()
            new = np.concatenate([[True], h[1:] != h[:-1]])
            new[bounds[:-1][has]] = True
            at = np.flatnonzero(new)
            h, counts, bounds = h[at], np.diff(at, append=len(h)), np.searchsorted(at, bounds)
        yield h, counts, bounds, (key, second)


def samples(h: np.ndarray, log_w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: a 32-bit name for each value (all with shingles) and each of BANDS x ROWS."""
    out = np.empty((len(bounds) - 1, len(ODD)), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    d = 0
    while d < len(bounds) - 1:
        e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + TILE, side="right")) - 1)
        a, b = bounds[d], bounds[e]
        x, w, first = h[a:b], log_w[a:b], bounds[d:e] - a
        # every step writes into the same few arrays, which stay in the cache
        z, name, i, sign = np.empty_like(x), np.empty_like(x), np.empty(b - a, np.intp), np.empty(b - a, np.int32)
        t, v = np.empty_like(w), np.empty_like(w)
        for k, odd in enumerate(ODD):
            np.multiply(x, odd, out=z)
            np.right_shift(z, np.uint64(48), out=i.view(np.uint64))
            np.take(R_INVERSE, i, out=t, mode="clip")
            np.multiply(t, w, out=t)
            t += np.take(BETA, i, out=v, mode="clip")
            np.floor(t, out=t)
            np.copyto(name.view(np.int64), t, casting="unsafe")
            name *= K.BASE
            z >>= np.uint64(16)
            name ^= z
            name &= low
            np.take(R, i, out=v, mode="clip")
            t *= v
            np.subtract(np.take(D, i, out=v, mode="clip"), t, out=v)
            # floats in order as whole numbers: a negative one has its lower bits turned over
            bits = v.view(np.int32)
            np.right_shift(bits, 31, out=sign)
            sign &= 0x7FFFFFFF
            bits ^= sign
            np.copyto(z.view(np.int64), bits)
            z <<= np.uint64(32)
            z |= name
            out[d:e, k] = np.minimum.reduceat(z.view(np.int64), first).view(np.uint64) & low
        d = e
    return out


def band_keys(names: np.ndarray) -> np.ndarray:
    """One hash per band."""
    key = np.zeros((len(names), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * K.BASE
    for r in range(ROWS):
        key = K.mix(key ^ names[:, r::ROWS][:, :BANDS] * K.BASE)
    return key


def weights(counts: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    idf = np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 1) if n > 1 else np.zeros(len(df))
    return counts * (1 + IDF_GAIN * idf)


class _Block:
    """Shingles of the documents of a block that stand for a class, and what goes to each shard."""

    def __init__(self, table: pa.Table, mail: pa.Table, shards: int):
        order = {"sort_keys": [("doc_id", "ascending"), ("text", "ascending")]}
        table = table.sort_by(order["sort_keys"])
        kinds = mail["kind"].to_numpy()
        ids = mail["doc_id"].to_numpy(zero_copy_only=False)
        mine = table["doc_id"].to_numpy(zero_copy_only=False)
        chosen = np.isin(mine, ids[kinds == 0])
        chosen[1:] &= mine[1:] != mine[:-1]  # of rows that share an id, the first
        self.table = table.filter(pa.array(chosen))
        parts = list(shingles(self.table["text"]))
        cat = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
        self.h, self.counts = cat(0, np.uint64), cat(1, np.int64)
        size = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.table["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.wanted = np.isin(self.ids, ids[kinds == 2])
        named, many = ids[kinds == 0], mail["copies"].to_numpy(zero_copy_only=False)[kinds == 0]
        by_id = np.argsort(named, kind="stable")
        self.copies = np.repeat(many[by_id][np.searchsorted(named[by_id], self.ids)].astype(np.uint32), size)
        where = ((self.h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(where, kind="stable")
        self.cuts = np.searchsorted(where[self.order], np.arange(shards + 1))
        self.low = (K.mix(self.h.copy()) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.df = np.ones(len(self.h))
        for kind, shard, data in zip(kinds.tolist(), mail["shard"].to_pylist(), mail["data"].to_pylist(), strict=True):
            if kind == 1:
                self.df[self.order[self.cuts[shard] : self.cuts[shard + 1]]] = 2 ** (np.frombuffer(zlib.decompress(data), np.uint8) / 8)


MAIL = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("data", pa.binary())])
MAIL_SQL = "block long, kind int, shard long, doc_id long, copies long, data binary"


def similar(vectors: list, left: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) with at least this weighted Jaccard similarity: of all vectors if left is 0, or else of one of the first `left` and one of the others.

    A vector is sorted 32-bit names, then as many 32-bit weights.
    """
    size = np.array([len(v) // 8 for v in vectors])
    bounds = np.concatenate([[0], np.cumsum(size)])
    w = np.concatenate([np.frombuffer(v, np.float32, k, 4 * k) for v, k in zip(vectors, size.tolist(), strict=True)])
    names, at = np.unique(np.concatenate([np.frombuffer(v, np.uint32, k) for v, k in zip(vectors, size.tolist(), strict=True)]), return_inverse=True)
    total = np.add.reduceat(w, bounds[:-1], dtype=np.float64)
    own = np.zeros(len(names), np.float32)
    out = []
    for i in range(left or len(size) - 1):
        j, mine = left or i + 1, slice(bounds[i], bounds[i + 1])
        own[at[mine]] = w[mine]
        common = np.add.reduceat(np.minimum(own[at[bounds[j] :]], w[bounds[j] :]), bounds[j:-1] - bounds[j], dtype=np.float64)
        own[at[mine]] = 0
        got = common / (total[i] + total[j:] - common)
        hit = np.flatnonzero(got >= threshold)
        out.append((np.full(len(hit), i), hit + j, got[hit]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _compare(threshold: float, every: bool):
    """A function over rows (x, i, j, right, part, doc_id, vector), in that order, that compares the members left and right of each (x, i, j): links (a, b, similarity).

    Unless every link is asked for, a member gives one link to each part on the right.
    """

    def pairs(right: np.ndarray, part: np.ndarray, ids: np.ndarray, vectors: list) -> list[np.ndarray]:
        left = int((right == 0).sum())
        if left in (0, len(ids)):
            return []
        i, j, s = similar(vectors, left, threshold)
        some = np.flatnonzero((ids[i] != ids[j]) & (every | (part[i] != part[j])))
        if not every:
            _, first = np.unique(np.stack([i[some], part[j[some]]]), axis=1, return_index=True)
            some = some[first]
        a, b = ids[i[some]], ids[j[some]]
        return [np.minimum(a, b), np.maximum(a, b), s[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, columns, vectors = None, [], []

        def done():
            got = pairs(*np.concatenate(columns, axis=1), vectors) if key else []
            if got and len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=("a", "b", "similarity"))

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            rest = np.stack([batch.column(k).to_numpy() for k in range(3, 6)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key != tuple(keys[:, a].tolist()):
                    yield from done()
                    key, columns, vectors = tuple(keys[:, a].tolist()), [], []
                columns.append(rest[:, a:b])
                vectors.extend(v.as_buffer() for v in batch.column(6).slice(a, b - a))
        yield from done()
        K.release()

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups (doc_id, group_id, copy_of), and verified links between class representatives (a, b, similarity) that join the groups.

    group_id is the smallest id of the group, copy_of the smallest id with the same words. With
    every_link the links are all there are, and groups have n_links, the number of those of that text.
    Null text is empty. Texts without
    words are copies only of texts with the same bytes. Of rows that share an id the first text in
    byte order counts and one row comes out; rows with a null id get none.
    Other columns are not read. An empty table gives empty results.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    long_rows(docs.sparkSession)
    bytes_, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-int(bytes_ or 0) // block_bytes))
    shards = max(1, -(-int(bytes_ or 0) // max(SHARD_BYTES, block_bytes)))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    rows = rows.withColumn("block", block_of("doc_id")).repartition(n, "block")
    grouped = rows.groupBy("block")

    def name(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        table = table.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)]))
        keys = [part[3] for part in shingles(table["text"], counted=False)]
        k1, k2 = (np.concatenate([np.zeros(0, np.uint64), *(k[x] for k in keys)]).view(np.int64) for x in (0, 1))
        K.release()
        return pa.table({"doc_id": table["doc_id"], "k1": pa.array(k1), "k2": pa.array(k2)})

    def send(key, table, mail):
        b = _Block(table, mail, shards)
        low, copies = b.low[b.order], b.copies[b.order]
        K.release()
        out = [(k, low[x:y].tobytes(), zlib.compress(copies[x:y].tobytes(), 1)) for k, (x, y) in enumerate(zip(b.cuts[:-1], b.cuts[1:], strict=True)) if y > x]
        return pa.table({"shard": pa.array([k for k, _, _ in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "data": pa.array([x for _, x, _ in out], pa.binary()), "copies": pa.array([c for _, _, c in out], pa.binary())})

    def count_shard(key, table):
        blocks_, packed = table["block"].to_pylist(), table["data"].to_pylist()
        each = [np.frombuffer(x, np.uint32) for x in packed]
        _, inverse = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(zlib.decompress(c), np.uint32) for c in table["copies"].to_pylist()]))
        code = np.minimum(np.round(8 * np.log2(total)), 255).astype(np.uint8)[inverse]
        parts = np.split(code, np.cumsum([len(x) for x in each])[:-1])
        del each, inverse, total
        K.release()
        return pa.table([pa.array(blocks_, pa.int64()), pa.array([1] * len(parts), pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], schema=MAIL)

    def sample(key, table, mail):
        b = _Block(table, mail, shards)
        has = np.diff(b.bounds) > 0
        bounds = np.append(b.bounds[:-1][has], b.bounds[-1])
        log_w = np.log(weights(b.counts, b.df, count)).astype(np.float32)
        keys = band_keys(samples(b.h, log_w, bounds)).view(np.int64)
        ids = b.ids[has]
        K.release()
        return pa.table({"doc_id": pa.array(np.repeat(ids, BANDS), pa.int64()), "size": pa.array(np.repeat(np.diff(bounds), BANDS), pa.int64()), "bucket": pa.array(keys.ravel(), pa.int64())})

    def vectors(key, table, mail):
        b = _Block(table, mail, shards)
        w = weights(b.counts, b.df, count).astype(np.float32)
        out = []
        for d in np.flatnonzero(b.wanted):
            x, y = b.bounds[d], b.bounds[d + 1]
            o = np.argsort(b.low[x:y], kind="stable")
            out.append(b.low[x:y][o].tobytes() + w[x:y][o].tobytes())
        K.release()
        return pa.table({"doc_id": pa.array(b.ids[b.wanted], pa.int64()), "vector": pa.array(out, pa.binary())})

    keys = grouped.applyInArrow(name, "doc_id long, k1 long, k2 long")
    classes = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"))
    letter = lambda kind, df, c, copies: df.select(block_of(c).alias("block"), F.lit(kind).cast("int").alias("kind"), F.lit(None).cast("long").alias("shard"), F.col(c).alias("doc_id"), copies.cast("long").alias("copies"), F.lit(None).cast("binary").alias("data"))
    leaders = letter(0, classes, "copy_of", F.col("copies"))
    replies = grouped.cogroup(leaders.groupBy("block")).applyInArrow(send, "shard long, block long, data binary, copies binary").groupBy("shard").applyInArrow(count_shard, MAIL_SQL)
    known = leaders.unionByName(replies)
    bands = grouped.cogroup(known.groupBy("block")).applyInArrow(sample, "doc_id long, size long, bucket long")
    bucket = Window.partitionBy("bucket")
    met = bands.withColumn("members", F.count("*").over(bucket)).withColumn("weight", F.sum(F.col("size") + OWN).over(bucket))
    met = met.where("members > 1 AND weight > 0")  # names both, so that all uses share one exchange of samples
    wanted = letter(2, met.select("doc_id").distinct(), "doc_id", F.lit(None))
    found = grouped.cogroup(known.unionByName(wanted).groupBy("block")).applyInArrow(vectors, "doc_id long, vector binary")
    # one job computes all three, so that the texts are shuffled once
    copies = keys.join(classes, ["k1", "k2"]).select("doc_id", "copy_of")
    facts = cut(copies.select("doc_id", "copy_of").unionByName(met.drop("weight"), allowMissingColumns=True).unionByName(found, allowMissingColumns=True))
    copies = facts.where("copy_of IS NOT NULL").select("doc_id", "copy_of")
    met = facts.where("bucket IS NOT NULL").select("doc_id", "size", "bucket", "members")
    found = facts.where("vector IS NOT NULL").select("doc_id", "vector")

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        """Links between members left and right of the same (x, i, j)."""
        names = ("x", "i", "j", "right", "part", "doc_id")
        sent = left.withColumn("right", F.lit(0)).unionByName(right.withColumn("right", F.lit(1))).distinct().join(found, "doc_id")
        dealt = sent.select(*[F.col(c).cast("long") for c in names], "vector").repartition("x", "i", "j").sortWithinPartitions(*names)
        return cut(dealt.mapInArrow(_compare(threshold, every_link), "a long, b long, similarity double"))

    zero = F.lit(0).cast("long")
    part_of = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    upto = lambda n: F.explode(F.sequence(zero, n - 1))
    if every_link:
        star, own = None, met.withColumn("part", F.col("doc_id"))
    else:
        known_by = met.groupBy("doc_id").agg(F.sum("members").alias("known"))
        chosen = met.join(known_by, "doc_id").groupBy("bucket").agg(F.max(F.struct("known", (-F.col("doc_id")).alias("minus"))).alias("best"), F.count("*").alias("n"), F.sum(F.col("size") + OWN).alias("weight"))
        chosen = chosen.select("bucket", (-F.col("best.minus")).alias("x"), F.ceil(F.col("weight") / CELL).alias("cells"))
        stars = met.join(chosen, "bucket").groupBy("x", "doc_id").agg(F.max("cells").alias("cells")).where("x <> doc_id")
        stars = stars.select("x", part_of(F.col("cells")).alias("i"), zero.alias("j"), F.col("doc_id").alias("part"), "doc_id")
        heads = stars.select("x", "i", "j").distinct().withColumns({"part": F.col("x"), "doc_id": F.col("x")})
        star = compared(heads, stars)
        own = met.join(components(star).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("root", "doc_id"))
    weigh = F.sum(F.col("size") + OWN).alias("weight")
    parts = own.groupBy("bucket", "part").agg(weigh, F.count("*").alias("n"))
    largest = F.max(F.struct("n", "part", "weight"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("weight").alias("weight"), largest.alias("most")).where("parts > 1")
    rest = F.lit(0) if every_link else F.col("most.weight")
    mixed = mixed.select("bucket", F.col("most.part").alias("major"), F.ceil(F.col("weight") / CELL).alias("n_i"), F.ceil((F.col("weight") - rest) / CELL).alias("n_j"))
    own = own.join(mixed, "bucket").select(F.col("bucket").alias("x"), "part", "doc_id", "major", "n_i", "n_j")
    minor = own if every_link else own.where("part <> major")
    left = minor.select("x", upto(F.col("n_i")).alias("i"), part_of(F.col("n_j")).alias("j"), "part", "doc_id")
    right = own.select("x", part_of(F.col("n_i")).alias("i"), upto(F.col("n_j")).alias("j"), "part", "doc_id")
    links = compared(left, right)
    links = (links.unionByName(star) if star else links).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    roots = components(links).withColumnRenamed("node", "copy_of")
    groups = copies.join(roots, "copy_of", "left").select("doc_id", F.coalesce("root", "copy_of").alias("group_id"), "copy_of")
    if every_link:
        degree = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count("*").alias("n_links"))
        groups = groups.join(degree, "copy_of", "left").select("doc_id", "group_id", "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return groups, links


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]

"""Suffix-array dedup of long byte strings with a logarithmic family of indexes.

A byte is removed if a string of `length` bytes that covers it also starts in a
document with a smaller id. Every such string holds a k-mer that is least among
its k-mers (by hash, leftmost on ties), so equal strings agree on that anchor, and
neighbouring strings with one anchor form a run. The anchor deals the work to shards.

1. Beside its anchor a string holds half of what remains of its length on one side.
   Each block of documents sends the hashes of anchors with such a side to the shard
   of the anchor, which answers those that other blocks have too. This only chooses
   candidates; nothing is removed for a hash.
2. Blocks send the texts of their candidates to the shards. A shard takes them in order
   of id, in batches. A batch gets a suffix array: the starts of its strings in
   order of content, compared on `length` bytes (more cannot matter), and equal
   neighbours are repeats. It is then merge-scanned against the levels of the family,
   which are suffix arrays too: both are walked in order, and bytes are compared. What
   is new becomes a level, and levels of like size merge.
3. The shards answer with the spans to cut, and each block cuts them.

A block sends equal candidates once, after comparing their bytes, so a group of copies,
however large, costs a shard one entry a block. There are never more messages than runs.
Blocks come from a hash of id and text. A shard's memory is bounded by its share of the
text; scans and merges of levels go in slices.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import long_rows

LENGTH = 50
KMER = 16
#: Text of one block and of one shard, and string positions that are worked on at once.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
STEP = 1 << 19
#: Strings of a batch at least (and a sixteenth of the shard's), and of a slice of a level.
BATCH, SLICE = 1 << 16, 1 << 18
LAST_ID = np.iinfo(np.int64).max


def windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes from each start; they compare byte by byte."""
    every = np.lib.stride_tricks.as_strided(text, (max(0, len(text) - length + 1), length), (1, 1))
    return np.ascontiguousarray(every[starts]).view(f"S{length}").ravel()


def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a == b if len(a) else np.zeros(0, bool)


class SuffixArray:
    """Starts of strings in a text, in order of their first `length` bytes, each content once, with its smallest document."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int):
        self.text, self.starts, self.ids, self.length = text, starts, ids, length

    def __len__(self) -> int:
        return len(self.starts)

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(self), SLICE):
            yield at, windows(self.text, self.starts[at : at + SLICE], self.length)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: where each of some ordered strings comes in this order, and whether it is there."""
        place, there = np.full(len(keys), len(self)), np.zeros(len(keys), bool)
        done = 0
        for at, own in self.slices():
            # strings up to the last of the slice; both sides go forward only
            stop = done + int(np.searchsorted(keys[done:], own[-1], side="right"))
            found = np.searchsorted(own, keys[done:stop])
            place[done:stop] = at + found
            there[done:stop] = equal(own[found], keys[done:stop])
            done = stop
        return place, there

    def merged(self, other: "SuffixArray") -> "SuffixArray":
        place = np.concatenate([self.places(k)[0] for _, k in other.slices()])
        at = place + np.arange(len(place))
        starts, ids = (np.empty(len(self) + len(other), x.dtype) for x in (self.starts, self.ids))
        mine = np.ones(len(starts), bool)
        mine[at] = False
        starts[at], ids[at] = other.starts + len(self.text), other.ids
        starts[mine], ids[mine] = self.starts, self.ids
        return SuffixArray(np.concatenate([self.text, other.text]), starts, ids, self.length)


class SuffixFamily:
    """Suffix arrays whose sizes fall at least by half from one to the next."""

    def __init__(self, length: int):
        self.levels: list[SuffixArray] = []
        self.length = length

    def take(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Adds a batch, strings in order of id; returns which of them a smaller id of this or an older batch has."""
        keys = windows(text, starts, self.length)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = ~equal(keys[1:], keys[:-1])
        group = np.cumsum(first) - 1
        least, keys = ids[order][first], keys[first]
        old = np.zeros(len(keys), bool)
        for level in self.levels:
            place, there = level.places(keys)
            old |= there
            least[there] = np.minimum(least[there], level.ids[place[there]])
        found = np.empty(len(starts), bool)
        found[order] = ids[order] > least[group]
        new = SuffixArray(text, starts[order][first][~old], least[~old], self.length)
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return found


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Runs:
    """The runs of a block: first and last string, document, anchor, its hash, and hashes of both sides (0 if no string holds half there)."""

    def __init__(self, table: pa.Table, length: int, kmer: int):
        self.data, self.offsets = K.arrow_bytes(table["text"])
        self.ids = table["doc_id"].fill_null(LAST_ID).to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        n_docs = len(self.offsets) - 1
        lo, hi, tag, left, right, anchors = [], [], [], [], [], []
        n, width, half = len(self.data), length - kmer + 1, (length - kmer) // 2
        for at in range(0, n - length + 1, STEP):
            part = self.data[at : at + STEP + length - 1]
            s = K.prefix_hashes(part)
            _, down = K.powers(len(s))
            grams = K.mix((s[kmer:] - s[:-kmer]) * down[: len(s) - kmer])
            low = np.uint64((1 << 24) - 1)
            packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            anchor = (_sliding_min(packed, width) & low).astype(np.int64)
            here = np.arange(len(anchor))
            d = np.searchsorted(self.offsets, [at, at + len(anchor) - 1], side="right") - 1
            stops = np.minimum(self.offsets[d[0] + 1 : min(d[1] + 2, n_docs + 1)], at + len(anchor))
            end = np.repeat(self.offsets[d[0] + 1 : d[0] + 1 + len(stops)], np.diff(np.concatenate([[at], stops])))
            fits = here + at + length <= end
            same = np.zeros(len(anchor), dtype=bool)
            same[1:] = fits[1:] & fits[:-1] & (anchor[1:] == anchor[:-1])
            first = np.flatnonzero(fits & ~same)
            ends = np.flatnonzero(fits & ~np.append(same[1:], False))
            a = anchor[first]
            tag.append((grams[a] >> np.uint64(32)).astype(np.uint32))
            name = lambda hashes, bit: ((hashes >> np.uint64(32)).astype(np.uint32) & ~np.uint32(1)) | np.uint32(bit)
            right.append(np.where(a - ends <= half, name(K.span_hash(s, a, np.minimum(a + kmer + half, len(part))), 1), np.uint32(0)))
            left.append(np.where(a - first > half, name(K.span_hash(s, np.maximum(a - half, 0), a + kmer), 0), np.uint32(0)))
            anchors.append(a + at)
            lo.append(first + at)
            hi.append(ends + at)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.lo, self.hi, self.anchor = cat(lo, np.int64), cat(hi, np.int64), cat(anchors, np.int64)
        self.tag, self.left, self.right = (cat(x, np.uint32) for x in (tag, left, right))
        self.doc = np.searchsorted(self.offsets, self.lo, side="right") - 1

    def shard(self, shards: int) -> np.ndarray:
        return (K.mix(self.tag.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _sides(runs: Runs, shards: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard the different side hashes of a block, in order, and which of them it has more than once."""
    value = np.concatenate([runs.left, runs.right])
    shard = np.tile(runs.shard(shards), 2)
    both = (shard.astype(np.uint64) << np.uint64(32) | value)[value > 0]
    both, count = np.unique(both, return_counts=True)
    where = (both >> np.uint64(32)).astype(np.int64)
    some, first = np.unique(where, return_index=True)
    stop = np.append(first[1:], len(both))[: len(first)]
    return [(int(k), both[a:b].astype(np.uint32), count[a:b] > 1) for k, a, b in zip(some, first, stop, strict=True)]


def _candidates(runs: Runs, replies: pa.Table, shards: int, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first and last string, and document of the parts of runs on a side that occurs more than once."""
    bits = dict(zip(replies["shard"].to_pylist(), replies["data"].to_pylist(), strict=True))
    known = []
    for k, values, own in _sides(runs, shards):
        also = np.unpackbits(np.frombuffer(zlib.decompress(bits[k]), np.uint8), count=len(values)).astype(bool) if k in bits else False
        known.append(np.uint64(k) << np.uint64(32) | values[own | also].astype(np.uint64))
    known = np.concatenate(known) if known else np.zeros(0, np.uint64)
    shard = runs.shard(shards)

    def among(value: np.ndarray) -> np.ndarray:
        both = shard.astype(np.uint64) << np.uint64(32) | value
        return (known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both) & (value > 0) if len(known) else np.zeros(len(value), bool)

    left, right = among(runs.left), among(runs.right)
    turn = runs.anchor - (length - kmer) // 2  # strings that start here or later hold the right side
    lo = np.where(left, runs.lo, np.maximum(runs.lo, turn))
    hi = np.where(right, runs.hi, np.minimum(runs.hi, turn - 1))
    keep = (left | right) & (lo <= hi)
    return shard[keep], lo[keep], hi[keep], runs.doc[keep]


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans of data, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _spans(start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans, merged where they overlap, as pairs of 64-bit integers."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
    return zlib.compress(np.stack([start[new], end[last]], axis=1).astype(np.int64).tobytes(), 1)


MESSAGE = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("head", pa.binary()), ("data", pa.binary())])
MESSAGE_SQL = "shard long, block long, head binary, data binary"


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, MESSAGE, strict=True)], schema=MESSAGE)


def _send_strings(block: int, runs: Runs, found: tuple, length: int) -> pa.Table:
    """A message per shard: its different candidates with id and number of strings, where each stands in the block, and their texts.

    Candidates that a smaller document of the block has go to a message that the shards pass on as it is.
    """
    shard, lo, hi, doc = found
    size = hi - lo + length
    ids = runs.ids[doc]
    name = np.empty(len(lo), np.uint64)
    for at in range(0, len(runs.data), STEP):
        a, b = np.searchsorted(lo, [at, at + STEP])
        if a < b:
            s = K.prefix_hashes(runs.data[at : at + STEP + 3 * length])
            name[a:b] = K.span_hash(s, lo[a:b] - at, lo[a:b] - at + size[a:b])
    order = np.lexsort((size, name, shard))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (size[order][1:] != size[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # equal names are compared byte by byte; one that differs stands for itself
    again = np.flatnonzero(first != np.arange(len(first)))
    for at in range(0, len(again), STEP // 64):
        some = again[at : at + STEP // 64]
        odd = _gathered(runs.data, lo[some], size[some]) != _gathered(runs.data, lo[first[some]], size[some])
        bad = np.add.reduceat(odd, np.cumsum(size[some]) - size[some]) > 0
        first[some[bad]] = some[bad]
    gone = ids > ids[first]
    rows = [(-1 - block, block, b"", _spans(lo[gone], hi[gone] + length))] if gone.any() else []
    left = np.flatnonzero(~gone)
    left = left[np.argsort(shard[left], kind="stable")]
    some, cut = np.unique(shard[left], return_index=True)
    for k, at in zip(some.tolist(), np.split(left, cut[1:]) if len(left) else [], strict=True):
        own = at[first[at] == at]
        place = np.searchsorted(own, first[at])
        head = b"".join(np.asarray(x, t).tobytes() for x, t in ((ids[own], np.int64), (hi[own] - lo[own] + 1, np.int64), (place, np.int64), (lo[at], np.int64)))
        rows.append((k, block, len(own).to_bytes(4, "little") + zlib.compress(head, 1), zlib.compress(_gathered(runs.data, lo[own], size[own]).tobytes(), 1)))
    return _messages(rows)


def _count_sides(key, table):
    """One shard: which hashes of each block other blocks have too."""
    packed = [np.frombuffer(x, np.uint32) for x in table["data"].to_pylist()]
    value, count = np.unique(np.concatenate(packed), return_counts=True)
    value = value[count > 1]
    among = lambda x: value[np.minimum(np.searchsorted(value, x), len(value) - 1)] == x if len(value) else np.zeros(len(x), bool)
    out = _messages([(key[0].as_py(), b, b"", zlib.compress(np.packbits(among(x)).tobytes(), 1)) for b, x in zip(table["block"].to_pylist(), packed, strict=True)])
    K.release()
    return out


def _scan_strings(key, table: pa.Table, length: int) -> pa.Table:
    """One shard: candidates in order of id, batch by batch, against the family; the spans to cut of each block."""
    if key[0].as_py() < 0:
        return table.select(MESSAGE.names).cast(MESSAGE)
    blocks, ids, count, texts, places, starts = [], [], [], [], [], []
    for block, head, data in zip(*(table[c].to_pylist() for c in ("block", "head", "data")), strict=True):
        n, numbers = int.from_bytes(head[:4], "little"), np.frombuffer(zlib.decompress(head[4:]), np.int64)
        m = (len(numbers) - 2 * n) // 2
        for to, x in zip((ids, count, places, starts), np.split(numbers, [n, 2 * n, 2 * n + m]), strict=True):
            to.append(x)
        blocks.append(block)
        texts.append(np.frombuffer(zlib.decompress(data), np.uint8))
    entries = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    ids, count, text = np.concatenate(ids), np.concatenate(count), np.concatenate(texts)
    del texts
    size = count + length - 1
    begin = np.cumsum(size) - size
    order = np.argsort(ids, kind="stable")
    total = np.cumsum(count[order])
    family = SuffixFamily(length)
    string = np.cumsum(count) - count  # each entry's first string
    found = np.zeros(int(total[-1]), bool)
    at, most = 0, max(BATCH, int(total[-1]) // 16)
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        own = order[at:to]
        n = count[own]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        got = family.take(_gathered(text, begin[own], size[own]), np.repeat(np.cumsum(size[own]) - size[own], n) + inner, np.repeat(ids[own], n))
        found[np.repeat(string[own], n) + inner] = got
        at = to
    # stretches of found strings of an entry, then the same at each of its places
    entry = np.repeat(np.arange(len(ids)), count)
    joined = np.zeros(len(found), bool)
    joined[1:] = found[1:] & found[:-1] & (entry[1:] == entry[:-1])
    first, last = np.flatnonzero(found & ~joined), np.flatnonzero(found & ~np.append(joined[1:], False))
    which = entry[first]
    rows = []
    for k, block in enumerate(blocks):
        a, b = np.searchsorted(which, [entries[k], entries[k + 1]])
        if a == b:
            continue
        e = which[a:b] - entries[k]
        lo, hi = np.searchsorted(e, places[k]), np.searchsorted(e, places[k], side="right")
        n = hi - lo
        pick = a + np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        base = np.repeat(starts[k], n) - string[which[pick]]
        if len(pick):
            rows.append((key[0].as_py(), block, b"", _spans(base + first[pick], base + last[pick] + length)))
    K.release()
    return _messages(rows)


def _sorted_block(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _cut(table: pa.Table, spans: pa.Table, as_text: bool) -> pa.Table:
    table = _sorted_block(table)
    data, offsets = K.arrow_bytes(table["text"])
    step = np.zeros(len(data) + 1, dtype=np.int32)
    for packed in spans["data"].to_pylist():
        pairs = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1], -1)
    gone = np.cumsum(step[:-1], dtype=np.int32) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(gone)]
    opens[inner] = gone[inner]
    count = lambda flags: np.diff(np.searchsorted(np.flatnonzero(flags), offsets))
    removed, runs = count(gone), count(opens)
    left = data[~gone]
    bounds = offsets - np.concatenate([[0], np.cumsum(removed)])
    digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    kept = pa.Array.from_buffers(pa.large_binary(), len(digest), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(left)])
    if as_text:
        kept = pa.array([x.as_buffer().to_pybytes().decode("utf-8", "ignore") for x in kept], pa.string())
    carry = table["carry"].cast(pa.struct([f.with_nullable(True) for f in table["carry"].type]))
    numbers = [pa.array(x, pa.int64()) for x in (np.diff(offsets), removed, runs)]
    return pa.table([table["doc_id"], *numbers, kept if as_text else kept.cast(pa.binary()), pa.array(digest, pa.string()), carry], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "carry"])


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256, and the columns of `carry`.

    With as_text, kept is a string, without the bytes of characters that were cut in two.
    Null text is empty. Texts shorter than `length` lose nothing. Rows with equal ids,
    or with a null id (which comes after all others), never remove each other's bytes.
    Other columns are not read. An empty table gives an empty result.
    """
    carry = carry or []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.struct(F.lit(None).cast("int").alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carry"))
    long_rows(docs.sparkSession)
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "block")

    def send_sides(key, table):
        out = [(k, key[0].as_py(), b"", values.tobytes()) for k, values, _ in _sides(Runs(_sorted_block(table), length, kmer), shards)]
        K.release()
        return _messages(out)

    def send_strings(key, table, replies):
        runs = Runs(_sorted_block(table), length, kmer)
        out = _send_strings(key[0].as_py(), runs, _candidates(runs, replies, shards, length, kmer), length)
        K.release()
        return out

    def cut(key, table, spans):
        out = _cut(table, spans, as_text)
        K.release()
        return out

    grouped = rows.groupBy("block")
    repeated = grouped.applyInArrow(send_sides, MESSAGE_SQL).groupBy("shard").applyInArrow(_count_sides, MESSAGE_SQL)
    strings = grouped.cogroup(repeated.groupBy("block")).applyInArrow(send_strings, MESSAGE_SQL)
    spans = strings.groupBy("shard").applyInArrow(lambda key, table: _scan_strings(key, table, length), MESSAGE_SQL)
    kind = rows.schema["carry"].dataType.simpleString()
    out = grouped.cogroup(spans.groupBy("block")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string, carry {kind}")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)])


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")

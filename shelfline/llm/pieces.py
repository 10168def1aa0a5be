"""SentencePiece encoding and decoding with N-best segmentations.

A model file gives pieces and scores; a segmentation's score is the sum of its
pieces' scores. Over the lattice of all pieces in a stretch of text, a forward
Viterbi pass keeps the best score from the start to each position. Backward A*
search from the end then takes these as exact heuristics, so that complete
segmentations come out in order of score. White space bounds every piece, so a
text is a chain of such stretches, and its N best segmentations differ from the
best one in at most N - 1 of them: those with the smallest loss. The Viterbi
passes run over all different stretches of a batch at once; the search then runs
over the stretches that can matter.

Encoding follows the model file: a leading space is added, spaces become U+2581,
and characters without a piece become byte pieces. A U+2581 in a text becomes
byte pieces too, so that decoding gives every text back exactly.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import long_rows

SPACE = "▁"
SWAP = str.maketrans({" ": SPACE, SPACE: " "})
#: Like the library's unigram lattice: characters without a piece cost this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Characters of text that are encoded at once.
STEP = 1 << 18
N_BEST = 4


@dataclass
class PieceModel:
    """Pieces by text, plain data that a broadcast carries to the workers."""

    texts: list[str]
    scores: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown_score: float
    longest: int
    cuts_at_space: bool
    dummy_prefix: bool


def load_model(path: str) -> PieceModel:
    """The pieces of a .model file with byte fallback."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = proto.ModelProto()
    spec.ParseFromString(sp.serialized_model_proto())
    texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in range(len(texts)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {texts[i]: (i, float(sp.get_score(i))) for i in plain}
    worst = min((s for _, s in scores.values() if s > -1e8), default=0.0)
    inner = any(SPACE in t.lstrip(SPACE) for t in scores if t.lstrip(SPACE)) or any("\n" in t for t in scores)
    return PieceModel(texts, scores, byte_ids, worst - UNKNOWN_PENALTY, max(map(len, scores), default=1), not inner, spec.normalizer_spec.add_dummy_prefix)


def n_best(model: PieceModel, s: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of one stretch, best first; equal scores: the one found first."""
    scores, longest, unknown = model.scores, model.longest, model.unknown_score
    size = len(s)
    best = [0.0] * (size + 1)
    for end in range(1, size + 1):
        top = best[end - 1] + unknown if s[end - 1] not in scores else -1e300
        for start in range(max(0, end - longest), end):
            hit = scores.get(s[start:end])
            if hit is not None and best[start] + hit[1] > top:
                top = best[start] + hit[1]
        best[end] = top
    # each entry stands for different segmentations and its score is that of the best of them, so n entries suffice
    agenda, done = [(-best[size], size, 0.0, None)], []
    while agenda and len(done) < n:
        _, end, behind, path = agenda.pop(0)
        if end == 0:
            ids = []
            while path is not None:
                ids += path[0]
                path = path[1]
            done.append((behind, ids))
            continue
        for start in range(max(0, end - longest), end):
            hit = scores.get(s[start:end])
            if hit is not None:
                g = behind + hit[1]
                agenda.append((-(g + best[start]), start, g, ([hit[0]], path)))
        if s[end - 1] not in scores:
            raw = (SPACE if s[end - 1] == " " else s[end - 1]).encode()
            g = behind + unknown
            agenda.append((-(g + best[end - 1]), end - 1, g, ([model.byte_ids[b] for b in raw], path)))
        agenda.sort(key=lambda x: (x[0], x[1]))
        del agenda[n - len(done) :]
    return done


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


class _Table:
    """Pieces and their prefixes by hash, for looking up many substrings at once."""

    def __init__(self, model: PieceModel):
        prefixes = {t[:k] for t in model.scores for k in range(1, len(t) + 1)}
        self.texts = sorted(prefixes)
        self.ids = np.array([model.scores.get(t, (-1, 0.0))[0] for t in self.texts], dtype=np.int32)
        self.score = np.array([model.scores.get(t, (-1, -np.inf))[1] for t in self.texts], dtype=np.float32)
        lengths = np.array([len(t) for t in self.texts])
        end = np.cumsum(lengths)
        sums = code_sums(_codes(self.texts))
        self.key = K.span_hash(sums, end - lengths, end)
        first = (self.key >> np.uint64(42)).astype(np.int64)
        self.one = np.zeros(1 << 22, dtype=np.int32)
        self.one[first] = np.arange(len(self.texts))
        rest = np.flatnonzero(self.one[first] != np.arange(len(self.texts)))
        for bits in range(16, 24):  # those whose place was taken have a smaller table to themselves
            second = (self.key[rest] & np.uint64((1 << bits) - 1)).astype(np.int64)
            if len(np.unique(second)) == len(rest):
                break
        self.mask, self.two = np.uint64((1 << bits) - 1), np.zeros(1 << bits, dtype=np.int32)
        self.two[second] = rest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it is neither a piece nor a prefix of one."""
        at = self.one[(h >> np.uint64(42)).astype(np.int64)]
        miss = np.flatnonzero(self.key[at] != h)
        if len(miss):
            other = self.two[(h[miss] & self.mask).astype(np.int64)]
            at[miss] = np.where(self.key[other] == h[miss], other, -1)
        return at


def code_sums(codes: np.ndarray) -> np.ndarray:
    """As kernels.prefix_hashes, over code points."""
    up, _ = K.powers(len(codes) + 1)
    s = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(K.mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=s[1:])
    return s


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same for the next."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Encoder:
    """Encodes batches of texts: the Viterbi pass runs over all different stretches of a batch at once."""

    def __init__(self, model: PieceModel, n: int):
        self.model, self.n, self.table = model, n, _Table(model)

    def _stretches(self, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """First position of each stretch."""
        if not self.model.cuts_at_space:
            return text_start
        space, line = codes == ord(SPACE), codes == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[text_start] = True
        return np.flatnonzero(cut)

    def _edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and table row of the piece of each length that starts at each position within its stretch."""
        n, longest = len(codes), self.model.longest
        score = np.full((n, longest), -np.inf, dtype=np.float32)
        row = np.full((n, longest), -1, dtype=np.int32)
        sums = code_sums(codes)
        alive = np.arange(n)
        for k in range(1, longest + 1):
            alive = alive[alive + k <= end[alive]]
            found = self.table.find(K.span_hash(sums, alive, alive + k))
            alive, found = alive[found >= 0], found[found >= 0]
            score[alive, k - 1] = self.table.score[found]
            row[alive, k - 1] = found
        unknown = np.isneginf(score[:, 0])
        score[unknown, 0] = self.model.unknown_score
        row[unknown, 0] = -1
        return score, row

    def _viterbi(self, base: np.ndarray, size: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score up to each position of each stretch (base are places in arrays with one place more per stretch), and the last piece's length.

        Stretches come longest first, so those still running are a prefix."""
        f = np.full(int(size.sum()) + len(size), -np.inf)
        last = np.zeros(len(f), dtype=np.int8 if self.model.longest < 128 else np.int32)
        f[base] = 0.0
        char = base - np.arange(len(base))  # place of the first character in score
        running = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
        for p, m in enumerate(running.tolist(), 1):
            b, c = base[:m], char[:m]
            top, best = np.full(m, -np.inf), np.ones(m, dtype=last.dtype)
            for k in range(1, min(self.model.longest, p) + 1):
                way = f[b + (p - k)] + score[c + (p - k), k - 1]
                better = way > top
                top = np.where(better, way, top)
                best[better] = k
            f[b + p] = top
            last[b + p] = best
        return f, last

    def _losses(self, base, size, score, f, first, k) -> np.ndarray:
        """What the second-best segmentation of each stretch costs: the least loss of an edge off the best path.

        first and k are the places and lengths of the best path's pieces."""
        longest = self.model.longest
        g = np.full(len(f) + longest, -np.inf)
        stop = base + size
        g[stop] = 0.0
        char = base - np.arange(len(base))
        running = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        for p, m in enumerate(running.tolist(), 1):
            b, c = stop[:m] - p, char[:m] + size[:m] - p
            top = np.full(m, -np.inf)
            for j in range(1, min(longest, p) + 1):
                np.maximum(top, score[c, j - 1] + g[b + j], out=top)
            g[b] = top
        at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)  # place of each character in f
        most = np.full(len(at), -np.inf)
        for j in range(1, longest + 1):
            way = score[:, j - 1] + g[at + j]
            way[first[k == j]] = -np.inf
            np.maximum(most, way, out=most)
        return f[stop] - np.maximum.reduceat(most + f[at], char)


    def encode(self, texts: list[str | None]):
        """Per text: ids of the best segmentation, its score, and the others as (score, edits)."""
        prefix = SPACE if self.model.dummy_prefix else ""
        swapped = [prefix + (t.translate(SWAP) if SPACE in t else t.replace(" ", SPACE)) if t else "" for t in texts]
        codes = _codes(swapped)
        sizes = np.array([len(t) for t in swapped], dtype=np.int64)
        ends = np.cumsum(sizes)
        if not len(codes):
            yield from (([], 0.0, []) for _ in texts)
            return
        start = self._stretches(codes, (ends - sizes)[sizes > 0])
        length = np.diff(np.append(start, len(codes)))
        _, index, which = np.unique(K.span_hash(code_sums(codes), start, start + length), return_index=True, return_inverse=True)
        order = np.argsort(-length[index], kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        which, size = place[which], length[index][order]
        own = codes[_ranges(start[index][order], size)]
        char = np.cumsum(size) - size
        score, row = self._edges(own, np.repeat(char + size, size))
        base = char + np.arange(len(size))
        f, last = self._viterbi(base, size, score)
        total = f[base + size]
        # walk back: pieces of all stretches, from their ends
        at, todo, walked = size.copy(), np.arange(len(size)), []
        while len(todo):
            k = last[base[todo] + at[todo]].astype(np.int64)
            at[todo] -= k
            walked.append((todo, char[todo] + at[todo], k))
            todo = todo[at[todo] > 0]
        owner, first, k = (np.concatenate(x) for x in zip(*walked, strict=True))
        order = np.argsort(first, kind="stable")
        owner, first, k = owner[order], first[order], k[order]
        piece = row[first, k - 1]
        ids = np.where(piece >= 0, self.table.ids[piece], -1)
        lost = np.flatnonzero(piece < 0)
        if len(lost):  # characters without a piece: their bytes
            chars = own[first[lost]]
            raw = [(SPACE if c == 32 else chr(c)).encode() for c in chars.tolist()]
            count = np.ones(len(ids), dtype=np.int64)
            count[lost] = [len(r) for r in raw]
            begin = np.cumsum(count) - count
            grown = np.repeat(ids, count)
            grown[_ranges(begin[lost], count[lost])] = np.array(self.model.byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
            ids, owner = grown, np.repeat(owner, count)
        n_ids = np.bincount(owner, minlength=len(size))
        id_start = np.cumsum(n_ids) - n_ids
        out_ids = ids[_ranges(id_start[which], n_ids[which])].astype(np.int32)
        out_count = n_ids[which]
        first_stretch = np.searchsorted(start, ends - sizes)
        last_stretch = np.searchsorted(start, ends)
        id_ends = np.concatenate([[0], np.cumsum(out_count)])
        sums = np.concatenate([[0.0], np.cumsum(total[which])])
        losses = self._losses(base, size, score, f, first, k)[which] if self.n > 1 else None
        for d in range(len(texts)):
            a, b = first_stretch[d], last_stretch[d]
            if a == b or not sizes[d]:
                yield [], 0.0, []
                continue
            got, whole = out_ids[id_ends[a] : id_ends[b]], float(sums[b] - sums[a])
            yield got, whole, self._others(a, b, whole, losses, which, length, start, codes, out_ids, id_ends) if self.n > 1 else []

    def _others(self, a, b, whole, losses, which, length, start, codes, out_ids, id_ends):
        """The next best segmentations of a text, from those of the stretches that lose least."""
        own = losses[a:b]
        few = self.n - 1
        bound = np.partition(own, few - 1)[few - 1] if len(own) > few else np.inf
        near = np.flatnonzero((own <= bound) & np.isfinite(own))
        near = sorted(nsmallest(few, near.tolist(), key=lambda i: (own[i], i)))
        ways, options = [(0.0, ())], {}
        for i in near:
            k = a + i
            best = out_ids[id_ends[k] : id_ends[k + 1]].tolist()
            s = codes[start[k] : start[k] + length[k]].tobytes().decode("utf-32-le")
            found = n_best(self.model, s, self.n)
            top = found[0][0]
            options[i] = [(top, best), *[x for x in found if x[1] != best][:few]]
            ways = nsmallest(self.n, [(w + top - o[0], path + ((i, j),) if j else path) for w, path in ways for j, o in enumerate(options[i])])
        at = id_ends[a]
        return [(whole - w, [(int(id_ends[a + i] - at), int(id_ends[a + i + 1] - id_ends[a + i]), options[i][j][1]) for i, j in path]) for w, path in ways if path][:few]


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, model: PieceModel):
        raw = [b""] * (len(model.texts) + 1)
        for t, (i, _) in model.scores.items():
            raw[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(model.byte_ids):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.size) - self.size
        self.store = np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8)
        self.prefix = model.dummy_prefix

    def text(self, ids: np.ndarray) -> str:
        none = len(self.size) - 1
        ids = np.where((ids < 0) | (ids >= none), none, ids).astype(np.int64)
        text = self.store[_ranges(self.start[ids], self.size[ids])].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


EDITS = "array<struct<at:int,length:int,ids:array<int>>>"
ENCODED = f"struct<ids:array<int>,score:double,others:array<struct<score:double,edits:{EDITS}>>,round_trip:boolean>"
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("others", pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))), ("round_trip", pa.bool_())])
_encoders: dict = {}


def encode(spark: SparkSession, model: PieceModel, text: Column | str, n: int = N_BEST) -> Column:
    """Column of struct (ids, score, others, round_trip): the best segmentation and up to n - 1 more, best first.

    round_trip tells whether decoding the ids gave the text back.

    Each of `others` lists its differences from ids: at, length and the ids that stand there instead.
    Null and empty texts have no ids, score 0 and no others.
    """
    long_rows(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (shared.value.unknown_score, len(shared.value.texts), n)
        encoder, decoder = _encoders.get(key) or _encoders.setdefault(key, (Encoder(shared.value, n), Decoder(shared.value)))
        for column in batches:
            # parts of a batch go back one by one; Spark counts rows, not batches
            for part in K.blocks(pa.table({"t": column}), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64), STEP):
                ids, offsets, scores, others, back = [], [0], [], [], []
                texts = part["t"].to_pylist()
                for text, (got, score, rest) in zip(texts, encoder.encode(texts), strict=True):
                    ids.append(np.asarray(got, dtype=np.int32))
                    back.append(decoder.text(ids[-1]) == text)
                    offsets.append(offsets[-1] + len(got))
                    scores.append(score)
                    others.append([{"score": s, "edits": [{"at": a, "length": k, "ids": i} for a, k, i in e]} for s, e in rest])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.StructArray.from_arrays([listed, pa.array(scores, pa.float64()), pa.array(others, _ARROW.field("others").type), pa.array(back, pa.bool_())], fields=list(_ARROW))
            K.release()

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def decode(spark: SparkSession, model: PieceModel, ids: Column | str) -> Column:
    """Text of a column of ids; null for null. Ids outside the vocabulary and control pieces stand for nothing."""
    long_rows(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for column in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            flat = column.flatten()
            own = np.split(np.asarray(flat.fill_null(-1) if flat.null_count else flat), ends[:-1]) if len(ends) else []
            yield pa.array([decoder.text(x) if ok else None for x, ok in zip(own, column.is_valid().to_pylist(), strict=True)], pa.string())

    return run(ids)


def model_path() -> str:
    """The model file in the folder of public tokenizers."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded again: ids, scores of the N best, and whether the text came back."""
    model = load_model(path or model_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = docs.withColumn("e", encode(spark, model, "text"))
    return got.select(
        "doc_id",
        F.size("e.ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("e.ids", " "), 256).alias("ids_sha256"),
        F.concat(F.array("e.score"), F.transform("e.others", lambda o: o["score"])).alias("scores"),
        F.expr("transform(e.others, o -> transform(o.edits, d -> struct(d.at AS at, d.length AS length, d.ids AS ids)))").alias("edits"),
        F.col("e.round_trip").alias("round_trip"),
    )

"""Language identification as a mixture of languages.

Training counts hashed byte trigrams of the words of each language. A document is
taken as words drawn from several languages: the likelihood of a word under a
language is the product over its trigrams, and expectation-maximisation estimates
the document's share of each language. Starting from all languages, the one with
the smallest share is dropped again and again; of the sets met on the way, the one
with the largest likelihood less a penalty of ln(words)/2 for each free share is
kept. The largest share names the document's language.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import long_rows

BUCKETS = 1 << 16
SMOOTHING = 0.5
STEP = 1 << 18
#: EM rounds over all languages, and after each drop, when the shares are nearly right already.
ROUNDS, AGAIN = 8, 4
PENALTY = 0.5
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters, the apostrophe and bytes of longer characters make up words here; digits and signs part them.
_WORD = np.array([chr(b).isalpha() or b >= 128 or b == 39 for b in range(256)])


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def _trigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte of each word; first byte of each word; words before each value."""
    data, offsets = K.lines_of(column)
    inside = _WORD[data]
    clean = np.where(inside, data, 32).astype(np.uint32)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.concatenate([[np.uint32(32)], clean[:-1]])
    code = (before[at] << 16) | (clean[at] << 8) | clean[at + 1]  # a newline ends the data
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first, np.searchsorted(at[first], offsets)


def _pieces(column):
    """Slices of about STEP bytes, so that memory does not follow the batch."""
    for t in K.blocks(pa.table({"t": column}), pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), STEP):
        yield t["t"]


def fit_languages(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram counts of every row with a language, in a single pass; what comes back is languages x BUCKETS at most.

    Rows with null text or language teach nothing; without any such row the model knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for part, own in _named(batch.column(0), names):
                gram, first, words = _trigrams(part)
                value = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(gram))[words]))
                kinds, code = np.unique(own, return_inverse=True)
                n = np.bincount(code[value] * BUCKETS + gram, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
                for k, x in zip(kinds, n, strict=True):
                    totals[str(k)] = totals.get(str(k), 0) + x
        for k, x in totals.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "bucket", "n"])

    def _named(column, names):
        at = 0
        for part in _pieces(column):
            yield part, np.array(names[at : at + len(part)], dtype=object).astype(str)
            at += len(part)

    long_rows(rows.sparkSession)
    known = rows.select(F.col(text).cast("string"), F.col(lang).cast("string")).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    got = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    n = np.zeros((len(languages), BUCKETS))
    n[np.searchsorted(languages, got["lang"]) if len(got) else [], got["bucket"]] = got["n"]
    p = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return LanguageModel(languages, np.ascontiguousarray(np.log(p).T.astype(np.float32)))


def _em(p: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and each document's log-likelihood under the shares before the last."""
    n = np.diff(np.append(first, len(p)))[:, None]
    for _ in range(rounds):
        r = p * share[doc]
        total = r.sum(axis=1, keepdims=True)
        np.maximum(total, 1e-30, out=total)
        r /= total
        share = np.add.reduceat(r, first, axis=0) / n
    return share, np.add.reduceat(np.log(total[:, 0]), first)


def shares(model: LanguageModel, column) -> tuple[np.ndarray, np.ndarray]:
    """Language shares per value of a column, and whether it has a letter; values without one have shares of 0."""
    out = np.zeros((len(column), len(model.languages)), dtype=np.float32)
    gram, first, words = _trigrams(column)
    has = np.diff(words) > 0
    if not has.any() or not model.languages:
        return out, has
    log_p = np.add.reduceat(model.log_p[gram], first, axis=0)
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    n = np.diff(words)[has]
    begin, doc = words[:-1][has], np.repeat(np.arange(len(n)), n)
    share, like = _em(p, doc, begin, np.full((len(n), p.shape[1]), 1 / p.shape[1], np.float32), ROUNDS)
    cost = PENALTY * np.log(np.maximum(n, 2))
    best, best_value = share, like - cost * (p.shape[1] - 1)
    for size in range(p.shape[1] - 1, 0, -1):
        share = share.copy()
        in_play = np.where(share > 0, share, np.inf)
        over = (share > 0).sum(axis=1) > size
        # of equal shares the last one goes, so that ties end at the name that sorts first
        smallest = in_play.shape[1] - 1 - in_play[:, ::-1].argmin(axis=1)
        share[np.flatnonzero(over), smallest[over]] = 0
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
        share, like = _em(p, doc, begin, share, AGAIN if size > 1 else 1)
        value = like - cost * (size - 1)
        better = value > best_value
        best = np.where(better[:, None], share, best)
        best_value = np.where(better, value, best_value)
    out[has] = best
    return out, has


def identify(spark: SparkSession, model: LanguageModel, text: Column | str) -> Column:
    """Struct (lang, score, languages): the main language, its share from 0 to 1, and every language kept with its share.

    Null text and text without a letter are `und` with score 0 and no languages. Ties go to the name that sorts first.
    """
    long_rows(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    @F.arrow_udf("struct<lang:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            rows = []
            for part in _pieces(column):
                got, has = shares(m, part)
                for s, ok, i in zip(got, has.tolist(), range(len(part)), strict=True):
                    if not ok or not m.languages or not _LETTER.search(part[i].as_py()):
                        rows.append({"lang": UNDETERMINED, "score": 0.0, "languages": []})
                        continue
                    k = int(s.argmax())
                    rows.append({"lang": m.languages[k], "score": min(1.0, float(s[k])), "languages": [{"lang": m.languages[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0]})
            yield pa.array(rows, kind)
            K.release()

    # marked so that a filter on the result is not pushed below it, where every text would be judged twice
    return run.asNondeterministic()(F.col(text).cast("string") if isinstance(text, str) else text)


def id_class(doc_id: str, classes: int) -> Column:
    """crc32 of an id as text, modulo classes; null as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % classes


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(id_class("doc_id", 4) != 2))
    got = docs.select("doc_id", (id_class("doc_id", 4) == 2).alias("held_out"), identify(spark, model, "text").alias("found"))
    return got.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.languages").alias("languages"))

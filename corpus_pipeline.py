"""Corpus pipeline: five stages from raw documents to token ids."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.decontaminate import contamination
from shelfline.llm.language import UNDETERMINED, fit_languages, identify
from shelfline.llm.minhash import near_duplicates
from shelfline.llm.pieces import encode, load_model, model_path
from shelfline.llm.shared import cut
from shelfline.llm.suffix_dedup import suffix_dedup

#: Ids that are broadcast to the documents at most; more of them are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among some; null ids stay."""
    ids = cut(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language that explains them go; lang becomes the one with the largest share.

    If no document has a language to learn from, all stay as they are.
    """
    model = fit_languages(docs)
    if not model.languages:
        return docs
    own = _free(docs, "_found")
    kept = docs.withColumn(own, identify(spark, model, "text")).where(F.col(f"{own}.lang") != UNDETERMINED)
    return kept.withColumn("lang", F.col(f"{own}.lang")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays."""
    groups, _ = near_duplicates(docs)
    return _without(docs, groups.where("doc_id <> group_id"))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document has go; documents left with nothing but white space go too.

    Bytes of characters that were cut in two are dropped.
    """
    # under names of their own, so that they don't clash with the result's
    others = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(own) for c, own in others.items()])
    out = suffix_dedup(rows, carry=list(others.values()), as_text=True)
    out = out.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    found = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long"), **{c: F.col(own) for c, own in others.items()}}
    return out.select(*[found[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, lang, source, n_pieces, ids, scores of the N best, the others' edits, round_trip."""
    model = load_model(model_path())
    got = docs.select("doc_id", "lang", "source", encode(spark, model, "text").alias("_e"))
    scores = F.concat(F.array("_e.score"), F.transform("_e.others", lambda o: o["score"]))
    edits = F.transform("_e.others", lambda o: o["edits"])
    return got.select(
        "doc_id", "lang", "source", F.size("_e.ids").cast("long").alias("n_pieces"), F.col("_e.ids").alias("ids"), scores.alias("scores"), edits.alias("edits"), F.col("_e.round_trip").alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokenize),
]
#: The stages' rows can't be had from SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

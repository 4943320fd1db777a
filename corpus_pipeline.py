"""The training-corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's docs.

Quality first, as it needs no other document; then whole near copies, then passages, so that fewer texts are compared;
credentials are masked in what stays, and that is packed. Every stage returns the columns of `documents` but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.llm import minhash, packing, quality, secrets, substring
from gridwx.llm.common import collecting, discard, stage, table
from gridwx.llm.queries import public_path


def _shield(place: int) -> str:
    return f"own_column_{place}"


def _shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but doc_id and text under names that no operator uses, and what gives them back."""
    names = {c: c if c in ("doc_id", "text") else _shield(i) for i, c in enumerate(docs.columns)}
    shielded = docs.select(*[F.col(f"`{c}`").alias(own) for c, own in names.items()])
    return shielded, lambda df: df.select(*[F.col(own).alias(c) for c, own in names.items()])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be of quality 0 go.

    Null and empty texts are scored like any; without labels nothing goes; repeated rows are judged alike.
    """
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    shielded, restore = _shielded(docs)
    return restore(quality.score_documents(shielded, machine).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, similarity 0.8 or more, the smallest doc_id.

    Rows that share a doc_id are told apart: each is in the group of its own text, and of equal rows one stays. Rows
    without words, or with a null doc_id, all stay.
    """
    shielded, restore = _shielded(docs)
    keyed = stage(shielded.withColumn("near_copy_row", F.monotonically_increasing_id()), "keyed")
    found = minhash.near_duplicates(keyed, words=5, percent=80, key="near_copy_row")
    return restore(keyed.join(found.where("NOT kept").select("near_copy_row"), "near_copy_row", "left_anti"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document with the smallest doc_id; documents left without words go.

    Null, empty and short texts pass as they are, and so do rows with a null doc_id.
    """
    shielded, restore = _shielded(docs)
    cut = substring.remove_repeats(shielded)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cut = cut.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        own = _shield(docs.columns.index("n_chars"))
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(own))
        cut = cut.withColumn(own, n_chars.cast(docs.schema["n_chars"].dataType))
    return restore(cut)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every credential span is masked in its text. All rows stay; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 token ids, lexical neighbours together. A null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: No SQL expresses the trained classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed windows of documents. The tables that a stage leaves are deleted once its rows are written; those of the
    last stage stay, as its rows are read from them. A stage called by itself deletes nothing."""
    docs, own = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        with collecting() as left:
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, [*own, *left[:-1]])
        own = left[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

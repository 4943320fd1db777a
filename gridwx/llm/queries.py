"""The registered query of each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwx.llm import align, bpe, fingerprint, hnsw, html, minhash, oracles, packing, phrases, quality, secrets, sharding, substring, warc
from gridwx.llm.common import staged_path, table


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages")))
    records = warc.read_archives(warc.save_archives(archives, staged_path(spark, "warc"))).where("item = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
    return found.select("query_id", "rank", "vec_id", "score")


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, machine)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OPERATORS = (
    op1_retrieval_packing, op2_secret_scan, op3_byte_bpe, op4_warc_salvage, op5_bottom_k, op6_improbable_features, op7_substring_dedup,
    op8_hnsw, op9_factorisation_machine, op10_differencing_shards, op11_main_text, op12_token_alignment, op13_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": oracles.SECRETS,
        "op4_warc_salvage": oracles.WARC,
        "op5_bottom_k": oracles.NEAR,
        "op7_substring_dedup": oracles.PASSAGES,
        "op11_main_text": oracles.MAIN_TEXT,
        "op13_collocations": oracles.COLLOCATIONS,
    }

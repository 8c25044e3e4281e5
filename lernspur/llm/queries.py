"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lernspur.llm import fingerprint, html_blocks, langid, licenses, merkle, mixing, neardup, packing, quality, token_files, url_rules, warc, whitening
from lernspur.llm.common import table


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = quality.score_quality(docs, with_text=False)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select("row.doc_id", *counts, "base_failed", "kept")


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    return records.withColumn("record_length", F.length(warc.record_bytes()).cast("long"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return mixed.select("row.doc_id", "row.source", "size", "source_size", "target", "taken")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op6_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), with_ids=False)


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return found.select("row.doc_id", "held_out", "lang_pred", "score")


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.match_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op9_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("row.doc_id", "class_id", "class_docs", "class_texts")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"tampered": merkle.tampered_leaf()})
    checked = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rule_table(spark))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("row.vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")).alias("c"), "identity_error")
    return each.select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_source_mix": op2_source_mix,
    "op3_adaptive_quality": op3_adaptive_quality,
    "op4_minhash_fingerprints": op4_minhash_fingerprints,
    "op5_html_main_text": op5_html_main_text,
    "op6_huffman_token_files": op6_huffman_token_files,
    "op7_nnls_packing": op7_nnls_packing,
    "op8_language_id": op8_language_id,
    "op9_license_digests": op9_license_digests,
    "op9_license_passages": op9_license_passages,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_rules": op12_url_rules,
    "op13_feast_whitening": op13_feast_whitening,
}

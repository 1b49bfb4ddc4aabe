"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from . import alignment, exact_dedup, fingerprints, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, rules, secrets, whitening


def op1_packing(spark, sf_dir):
    import public_tokenizers

    rows, _ = packing.places(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark, sf_dir):
    """A source is an owner; its documents in one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, F.struct("source", "lang"), F.col("source"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    """Two batches, so the second one meets the index of the first."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), batches=2)


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_removed", "text")


def op8_license_scan(spark, sf_dir):
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    rows = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op11_quality_rules(spark, sf_dir):
    """A stratum is a language."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang")).drop("failed_rules")


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_near_dedup": op6_near_dedup, "op4_html_text": op4_html_text, "op9_fingerprints": op9_fingerprints, "op10_quality": op10_quality, "op1_packing": op1_packing, "op2_secret_scan": op2_secret_scan, "op7_line_dedup": op7_line_dedup, "op8_license_scan": op8_license_scan, "op3_mixing": op3_mixing, "op5_exact_dedup": op5_exact_dedup, "op11_quality_rules": op11_quality_rules, "op12_whitening": op12_whitening, "op13_alignment": op13_alignment}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op5_exact_dedup": f"""
        with d as (select doc_id, sha256({_ASCII_LOWER}) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
    """,
}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkmill.llm import op1_lz_fingerprint, op2_html, op3_decontaminate, op4_warc, op5_secrets, op6_tokens, op7_mixing, op8_minhash, op9_suffix_dedup, op10_language, op11_embedding_dedup, op12_vector_codes, op13_spelling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lz_fingerprint": op1_lz_fingerprint.op1_lz_fingerprint,
        "op2_html": op2_html.op2_html,
        "op3_decontaminate": op3_decontaminate.op3_decontaminate,
        "op4_warc": op4_warc.op4_warc,
        "op5_secrets": op5_secrets.op5_secrets,
        "op6_token_output": op6_tokens.op6_token_output,
        "op7_mixing": op7_mixing.op7_mixing,
        "op8_minhash": op8_minhash.op8_minhash,
        "op9_suffix_dedup": op9_suffix_dedup.op9_suffix_dedup,
        "op10_language": op10_language.op10_language,
        "op11_embedding_dedup": op11_embedding_dedup.op11_embedding_dedup,
        "op12_vector_codes": op12_vector_codes.op12_vector_codes,
        "op13_spelling": op13_spelling.op13_spelling,
        "mixing_targets": op7_mixing.mixing_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": op3_decontaminate.SQL,
        "op4_warc": op4_warc.SQL,
        "op8_minhash": op8_minhash.SQL,
        "op9_suffix_dedup": op9_suffix_dedup.SQL,
        "op11_embedding_dedup": op11_embedding_dedup.SQL,
        "op12_vector_codes": op12_vector_codes.SQL,
        "op13_spelling": op13_spelling.SQL,
        "mixing_targets": op7_mixing.TARGETS_SQL,
    }

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontam, line_dedup, media, quality, secrets_scan, sharding, simhash, suffix_dedup, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_secrets": secrets_scan.op2_secrets,
        "op3_histogram_shards": sharding.op3_histogram_shards,
        "op4_line_spread": line_dedup.op4_line_spread,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_decontaminate": decontam.op7_decontaminate,
        "op8_simhash": simhash.op8_simhash,
        "op9_bpe": bpe.op9_bpe,
        "op10_audio": media.op10_audio,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op4_line_spread": line_dedup.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

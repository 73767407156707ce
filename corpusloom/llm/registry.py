"""Queries of the llm subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, lattice, linededup, media, minhash, mixing, pii, quality, toxicity, urlfilter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_embedding_near_dedup": lattice.op1_embedding_near_dedup,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
        "op5_pii_sanitisation": pii.op5_pii_sanitisation,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_flac_media": media.op7_flac_media,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_url_filters": urlfilter.op9_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.SQL, "op4_line_dedup": linededup.SQL, "op9_url_filters": urlfilter.SQL}

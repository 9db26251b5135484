"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, hmm, langid, linededup, merkle, mixing, mtree, omh, paragraphs, simhash, tokenbin, warc, whitening
from quire.llm.util import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": lambda spark, sf: bpe.op1_bpe_round_trip(documents(spark, sf)),
        "op2_mtree_top_k": lambda spark, sf: mtree.op2_top_k(spark.read.parquet(f"{sf}/embeddings.parquet")),
        "op3_token_files": lambda spark, sf: tokenbin.op3_token_files(documents(spark, sf)),
        "op4_language_id": lambda spark, sf: langid.op4_language_id(documents(spark, sf)),
        "op5_warc_archives": lambda spark, sf: warc.op5_warc_archives(spark.read.parquet(f"{sf}/pages.parquet")),
        "op6_paragraph_dedup": lambda spark, sf: paragraphs.op6_paragraph_dedup(documents(spark, sf)),
        "op7_simhash_fingerprints": lambda spark, sf: simhash.op7_fingerprints(documents(spark, sf)),
        "op8_near_duplicates": lambda spark, sf: omh.op8_near_duplicates(documents(spark, sf)),
        "op9_mix_sources": lambda spark, sf: mixing.op9_mix_sources(documents(spark, sf)),
        "op10_line_dedup": lambda spark, sf: linededup.op10_line_dedup(documents(spark, sf)),
        "op11_merkle_manifest": lambda spark, sf: merkle.op11_merkle_manifest(documents(spark, sf)),
        "op12_embedding_whitening": lambda spark, sf: whitening.op12_embedding_whitening(spark.read.parquet(f"{sf}/embeddings.parquet")),
        "op13_language_model_scores": lambda spark, sf: hmm.op13_language_model_scores(documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree_top_k": mtree.ORACLE, "op9_mix_sources": mixing.ORACLE, "op10_line_dedup": linededup.ORACLE, "op11_merkle_manifest": merkle.ORACLE}

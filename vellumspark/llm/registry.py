"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, embedding_dedup, exact_dedup, langid, license_digest, lm_score, mixing, quality, quotations, revisits, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": revisits.op1_warc_revisits,
    "op2_ctw_score": lm_score.op2_ctw_score,
    "op3_quotation_linking": quotations.op3_quotation_linking,
    "op4_mix_min_cost_flow": mixing.op4_mix_min_cost_flow,
    "op5_quality_ftrl": quality.op5_quality_ftrl,
    "op6_license_digest": license_digest.op6_license_digest,
    "op7_decontaminate_cgk": decontaminate.op7_decontaminate_cgk,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash_anchor": simhash.op9_simhash_anchor,
    "op10_langid_ftrl": langid.op10_langid_ftrl,
    "op11_collocations": collocations.op11_collocations,
    "op12_embedding_tiles": embedding_dedup.op12_embedding_tiles,
}

ORACLES: dict[str, str] = {
    "op1_warc_revisits": revisits.ORACLE,
    "op6_license_digest": license_digest.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_embedding_tiles": embedding_dedup.ORACLE,
}

"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, flac, licenses, linededup, maxent, negatives, ngramjoin, packing, sharding, tokenfiles, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1,
    "op2_line_dedup": linededup.op2,
    "op3_toxicity": toxicity.op3,
    "op4_license_scan": licenses.op4,
    "op5_flac": flac.op5,
    "op6_stratified_interleave": sharding.op6,
    "op7_ngram_jaccard_join": ngramjoin.op7,
    "op8_maxent_lm": maxent.op8,
    "op9_swap_packing": packing.op9,
    "op10_feistel_token_files": tokenfiles.op10,
    "op11_pivot_negatives": negatives.op11,
    "op12_tsqr_whitening": whitening.op12,
    "op13_boosted_extraction": extract.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op11_pivot_negatives": negatives.ORACLE_SQL,
}

"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillfen.llm import (
    bpe,
    decontamination,
    hardnegatives,
    licenses,
    multiindex,
    packing,
    pages,
    periodic,
    privacy,
    rans,
    sharding,
    simhash,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.query,
    "op2_licenses": licenses.query,
    "op3_privacy": privacy.query,
    "op4_byte_bpe": bpe.query,
    "op5_simhash": simhash.query,
    "op6_multi_index": multiindex.query,
    "op7_toxicity": toxicity.query,
    "op8_decontamination": decontamination.query,
    "op9_rans": rans.query,
    "op10_main_text": pages.query,
    "op11_packing": packing.query,
    "op12_hard_negatives": hardnegatives.query,
    "op13_periodic_runs": periodic.query,
}

ORACLES: dict[str, str] = {"op1_sharding": sharding.SQL}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, cdc, hnsw, licenses, linededup, omh, packing, quality, secretscan, toxicity


def queries() -> dict:
    return {
        "op1_substring_dedup": cdc.op1,
        "op2_hnsw": hnsw.op2,
        "op3_quality_rules": quality.op3,
        "op4_license_scan": licenses.op4,
        "op5_secret_scan": secretscan.op5,
        "op6_bestfit_packing": packing.op6,
        "op7_line_dedup": linededup.op7,
        "op8_bpe": bpe.op8,
        "op9_order_minhash": omh.op9,
        "op10_toxicity": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.op3_sql(), "op7_line_dedup": linededup.op7_sql()}

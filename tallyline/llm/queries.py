"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, embedding_dedup, importance, jaccard_join, license_scan, line_dedup, packing, pii, quality_crf, quality_rules, secret_scan, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_bpe": bpe.op3_bpe,
        "op4_quality": quality_crf.op4_quality,
        "op5_packing": packing.op5_packing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_pii": pii.op7_pii,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_centroids": centroids.op12_centroids,
        "op13_secret_scan": secret_scan.op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op8_embedding_dedup": embedding_dedup.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_importance_resampling": importance.OP11_SQL,
        "op12_centroids": centroids.OP12_SQL,
    }

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from finsieve.llm import (
    exact_dedup,
    language_id,
    language_model,
    lexical_search,
    license_scan,
    near_dedup,
    packing,
    pieces,
    quality_model,
    quality_rules,
    resampling,
    substring_dedup,
    token_counts,
)
from finsieve.session import configure

_RUNS = (
    exact_dedup.op1_exact_dedup,
    language_model.op2_lm_scoring,
    pieces.op3_sentencepiece,
    token_counts.op4_token_counts,
    license_scan.op5_license_scan,
    quality_rules.op6_quality_rules,
    quality_model.op7_quality_classifier,
    packing.op8_best_fit_packing,
    substring_dedup.op9_substring_dedup,
    near_dedup.op10_minhash_near_dedup,
    resampling.op11_importance_resampling,
    language_id.op12_language_id,
    lexical_search.op13_lexical_search,
)

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_license_scan": license_scan.OP5_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}


def _configured(run):
    return lambda spark, sf_dir: run(configure(spark), sf_dir)


QUERIES = {run.__name__: _configured(run) for run in _RUNS}

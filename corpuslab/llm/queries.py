"""Queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import (
    decontamination,
    divergence,
    lines,
    minhash,
    mixing,
    overlap,
    periods,
    personal,
    quality,
    scoring,
    secrets,
    toxicity,
    urls,
)

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filters": urls.op3_url_filters,
    "op4_personal_data": personal.op4_personal_data,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm_scoring": scoring.op7_lm_scoring,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_ngram_join": overlap.op11_ngram_join,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_source_divergence": divergence.op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_url_filters": urls.OP3_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}

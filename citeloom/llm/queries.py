"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, fingerprint, language_id, mixing, near_dup, ppm, quality, spans, suffixes, token_file

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_language_model": ppm.op3_language_model,
    "op4_token_file": token_file.op4_token_file,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": language_id.op7_language_id,
    "op8_sentence_spans": spans.op8_sentence_spans,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op6_mixing": mixing.ORACLE,
}

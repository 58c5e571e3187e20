"""The registered queries of this package: name -> (builder, SQL or None)."""

from __future__ import annotations

from . import brown, decontam, langid, lines, middle, mixing, multi_index, ngram_join, quality, resample, secrets, suffixes, toxicity

QUERIES = {
    "op1_language_id": (langid.op1_language_id, None),
    "op2_toxicity_grammar": (toxicity.op2_toxicity_grammar, None),
    "op3_secret_ownership": (secrets.op3_secret_ownership, secrets.SQL),
    "op10_winnowing": (decontam.op10_winnowing, decontam.SQL),
    "op4_brown_classes": (brown.op4_brown_classes, None),
    "op5_multi_index": (multi_index.op5_multi_index, multi_index.SQL),
    "op6_mix_sources": (mixing.op6_mix_sources, mixing.SQL),
    "op7_line_dedup": (lines.op7_line_dedup, lines.SQL),
    "op8_ngram_jaccard": (ngram_join.op8_ngram_jaccard, ngram_join.SQL),
    "op9_bucket_pointers": (suffixes.op9_bucket_pointers, suffixes.SQL),
    "op11_rank_index_middle": (middle.op11_rank_index_middle, middle.SQL),
    "op12_target_resampling": (resample.op12_target_resampling, resample.SQL),
    "op13_positive_unlabelled": (quality.op13_positive_unlabelled, None),
}

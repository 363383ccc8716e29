"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import complement, decontaminate, langid, linerules, merkle, minmax, mixing, packing, ppm, pseudonyms, repair, suffix, superkmer

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_hyperdimensional_langid": langid.op1_hyperdimensional_langid,
    "op2_flow_mixing": mixing.op2_flow_mixing,
    "op3_feistel_pseudonyms": pseudonyms.op3_feistel_pseudonyms,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_ppm_scores": ppm.op5_ppm_scores,
    "op6_line_rules": linerules.op6_line_rules,
    "op7_superkmer_dedup": superkmer.op7_superkmer_dedup,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_minmax_near_dedup": minmax.op9_minmax_near_dedup,
    "op10_prefix_decontaminate": decontaminate.op10_prefix_decontaminate,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_survivor_repair": repair.op12_survivor_repair,
    "op13_complement_packing": complement.op13_complement_packing,
}

ORACLES = {
    "op6_line_rules": linerules.ORACLE_SQL,
    "op7_superkmer_dedup": superkmer.ORACLE_SQL,
    "op9_minmax_near_dedup": minmax.ORACLE_SQL,
    "op10_prefix_decontaminate": decontaminate.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_survivor_repair": repair.ORACLE_SQL,
}

"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from graphloom.llm import fingerprint, language, mixing, neardup, packing, quality, rules, sharding, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_language": language.op8_language,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES = {"op4_warc": warc.OP4_SQL, "op6_mixing": mixing.OP6_SQL}

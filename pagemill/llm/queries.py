"""The queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from . import dedup, language, merkle, packing, quality, secrets, topk, toxicity, warc, word_bpe

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_warc": warc.op5_warc,
    "op6_language_id": language.op6_language_id,
    "op7_near_duplicates": dedup.op7_near_duplicates,
    "op8_packing": packing.op8_packing,
    "op9_word_bpe": word_bpe.op9_word_bpe,
    "op10_fingerprints": merkle.op10_fingerprints,
}

ORACLES = {"op3_topk": topk.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL}

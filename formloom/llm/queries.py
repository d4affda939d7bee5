"""The operators' registered queries and their SQL, for the driver contract."""

from __future__ import annotations

from . import exact, lengths, lm, minhash, mixing, neighbours, pieces, quality, quotes, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            pieces.op1_sentencepiece, minhash.op2_minhash_near_dedup, quotes.op3_quotation_linking, mixing.op4_mixing, toxicity.op5_toxicity,
            quality.op6_quality_classifier, lengths.op7_token_counts, lm.op8_lm_scoring, neighbours.op9_ann_search, exact.op10_exact_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op10_exact_dedup": exact.ORACLE}

"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, gif, licenses, mixing, ppm, quality, sharding, simhash, suffix, topk


def queries() -> dict:
    return {
        "op1_gif": gif.op1,
        "op2_topk": topk.op2,
        "op3_ppm": ppm.op3,
        "op4_simhash": simhash.op4,
        "op5_licenses": licenses.op5,
        "op6_suffix_dedup": suffix.op6,
        "op7_quality": quality.op7,
        "op8_mix_sources": mixing.op8,
        "op9_shard": sharding.op9,
        "op10_bpe": bpe.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.OP2_SQL, "op5_licenses": licenses.OP5_SQL, "op8_mix_sources": mixing.OP8_SQL}

"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from . import decontam, divergence, language_id, line_dedup, near_dedup, packing, quality, sharding, spot_signatures, token_store, vector_dedup, warc, whitening

QUERIES = {
    "op1_near_dedup": near_dedup.op1,
    "op2_token_store": token_store.op2,
    "op3_vector_dedup": vector_dedup.op3,
    "op4_language_id": language_id.op4,
    "op5_quality": quality.op5,
    "op6_warc": warc.op6,
    "op7_sharding": sharding.op7,
    "op8_packing": packing.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_decontam": decontam.op10,
    "op11_spot_signatures": spot_signatures.op11,
    "op12_whitening": whitening.op12,
    "op13_divergence": divergence.op13,
}

ORACLES: dict[str, str] = {"op1_near_dedup": near_dedup.OP1_SQL, "op6_warc": warc.OP6_SQL, "op3_vector_dedup": vector_dedup.OP3_SQL, "op10_decontam": decontam.OP10_SQL, "op13_divergence": divergence.OP13_SQL}

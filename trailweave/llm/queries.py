"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from trailweave.llm import chat, exact_dedup, media, mixing, near_dedup, packing, quality, token_codes, toxicity, warc

QUERIES = {
    "op1_token_codes": token_codes.op1,
    "op2_mixing": mixing.op2,
    "op3_near_dedup": near_dedup.op3,
    "op4_media_chunks": media.op4,
    "op5_quality": quality.op5,
    "op6_warc": warc.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_chat_format": chat.op9,
    "op10_packing": packing.op10,
}

SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}

"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from skein.llm import bpe_codec, chat_format, hnsw, license_scan, media, near_dedup, packing, quality, substring_dedup, token_counts

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_hnsw": hnsw.op4_hnsw,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_bpe_codec": bpe_codec.op9_bpe_codec,
    "op10_media": media.op10_media,
}

ORACLE: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
}

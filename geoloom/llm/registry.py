"""The queries opN_<name>; each applies its operator to its whole table."""

from __future__ import annotations

from geoloom.llm import bpe_codec, jaccard_join, line_frequency, media_sniff, mixture_packing, pii_weak, recompression, secret_scan, toxicity_knn, warc_derivatives


def queries() -> dict:
    return {
        "op1_media_sniff": media_sniff.op1_media_sniff,
        "op2_mixture_packing": mixture_packing.op2_mixture_packing,
        "op3_byte_bpe": bpe_codec.op3_byte_bpe,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_pii_weak": pii_weak.op5_pii_weak,
        "op6_line_frequency": line_frequency.op6_line_frequency,
        "op7_recompression": recompression.op7_recompression,
        "op8_toxicity_knn": toxicity_knn.op8_toxicity_knn,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_warc_derivatives": warc_derivatives.op10_warc_derivatives,
    }


def oracle_sql() -> dict:
    return {"op6_line_frequency": line_frequency.SQL}

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import collocations, fingerprints, langid, lines, media, mixing, quantizer, segmentation, simhash, tokens, topk, toxicity, warc

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_segmentation": segmentation.op5_segmentation,
    "op6_warc": warc.op6_warc,
    "op7_media": media.op7_media,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_language_id": langid.op9_language_id,
    "op10_simhash": simhash.op10_simhash,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_collocations": collocations.op12_collocations,
    "op13_vector_codes": quantizer.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_top_k": topk.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op6_warc": warc.OP6_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_vector_codes": quantizer.OP13_SQL,
}

"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from paperloom.llm import byte_spans, exact_dedup, fingerprints, licences, mixing, near_dup, packing, quality, sentence_spans, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_near_copies": near_dup.op6_near_copies,
    "op7_warc": warc.op7_warc,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_byte_spans": byte_spans.op9_byte_spans,
    "op10_sentence_spans": sentence_spans.op10_sentence_spans,
}

ORACLE_SQL = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL}

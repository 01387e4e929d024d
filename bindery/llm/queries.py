"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from bindery.llm import bpe, codes, decontaminate, exact, langid, lines, quality, secrets, simhash, toxicity, urls, vectors, whiten

QUERIES = {
    "op1_line_dedup": lines.op1,
    "op2_language_id": langid.op2,
    "op3_embedding_dedup": vectors.op3,
    "op4_quality": quality.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_secrets": secrets.op7,
    "op8_simhash": simhash.op8,
    "op9_toxicity": toxicity.op9,
    "op10_url_filter": urls.op10,
    "op11_vector_codes": codes.op11,
    "op12_exact_dedup": exact.op12,
    "op13_whitening": whiten.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.OP1_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op12_exact_dedup": exact.OP12_SQL,
}

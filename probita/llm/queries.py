"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, licenses, mixing, packing, passages, pii, quality, simhash, suffixes, tokencount, topk, trie

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_substrings": suffixes.op2_substrings,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_topk": topk.op5_topk,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_passages": passages.op8_passages,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_bpe": bpe.op11_bpe,
    "op12_trie": trie.op12_trie,
    "op13_audit": audit.op13_audit,
}
SQL: dict[str, str] = {"op5_topk": topk.OP5_SQL, "op12_trie": trie.OP12_SQL, "op13_audit": audit.OP13_SQL}

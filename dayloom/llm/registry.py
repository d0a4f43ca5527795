"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import backoff, chunks, decontaminate, divergence, fingerprint, language, lines, mixing, neardup, secrets, sitetree, suffix, vectorcodes

QUERIES = {
    "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_language_id": language.op3_language_id,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_multiset_fingerprint": fingerprint.op6_multiset_fingerprint,
    "op7_site_style_tree": sitetree.op7_site_style_tree,
    "op8_run_length_index": suffix.op8_run_length_index,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_content_defined_chunks": chunks.op10_content_defined_chunks,
    "op11_backoff_automaton": backoff.op11_backoff_automaton,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_laesa_vector_codes": vectorcodes.op13_laesa_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_laesa_vector_codes": vectorcodes.OP13_SQL,
}

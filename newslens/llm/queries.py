"""Queries of this subpackage with their SQL checks, by the name under which they are registered."""

from __future__ import annotations

from newslens.llm import arrow_tokens, bpe_pairs, credential_links, decontamination, filter_audit, host_paths, language_id, minhash, nn_descent, pii, token_alignment, token_counts, toxicity

QUERIES = {
    "op1_language_codes": language_id.op1_query,
    "op2_credential_links": credential_links.op2_query,
    "op3_toxicity": toxicity.op3_query,
    "op4_bpe_pairs": bpe_pairs.op4_query,
    "op5_nn_descent": nn_descent.op5_query,
    "op6_arrow_tokens": arrow_tokens.op6_query,
    "op7_token_counts": token_counts.op7_query,
    "op8_minhash": minhash.op8_query,
    "op9_pii": pii.op9_query,
    "op10_decontamination": decontamination.op10_query,
    "op11_host_paths": host_paths.op11_query,
    "op12_removal_ranks": filter_audit.op12_query,
    "op13_fragment_alignment": token_alignment.op13_query,
}

ORACLE: dict[str, str] = {
    "op2_credential_links": credential_links.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op12_removal_ranks": filter_audit.ORACLE,
}

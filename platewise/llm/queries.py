"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from platewise.llm.conversations import OP13_SQL, op13_repair_conversations
from platewise.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from platewise.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from platewise.llm.language_id import op4_language_id
from platewise.llm.mixing import OP10_SQL, op10_mix_sources
from platewise.llm.packing import op8_best_fit_packing
from platewise.llm.pii import op5_pii_surrogates
from platewise.llm.secrets import op6_secret_scan
from platewise.llm.simhash import op2_simhash_near_dedup
from platewise.llm.spotsigs import OP12_SQL, op12_document_fingerprints
from platewise.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from platewise.llm.url_filter import OP9_SQL, op9_url_filter
from platewise.llm.vector_search import OP7_SQL, op7_top_k_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_simhash_near_dedup,
        op3_substring_dedup,
        op4_language_id,
        op5_pii_surrogates,
        op6_secret_scan,
        op7_top_k_search,
        op8_best_fit_packing,
        op9_url_filter,
        op10_mix_sources,
        op11_hard_negatives,
        op12_document_fingerprints,
        op13_repair_conversations,
    )
}

ORACLES = {"op1_exact_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op7_top_k_search": OP7_SQL, "op9_url_filter": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_document_fingerprints": OP12_SQL, "op13_repair_conversations": OP13_SQL}

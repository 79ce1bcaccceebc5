"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from crossmer.llm.chat import op4_chat_format
from crossmer.llm.decontamination import op9_decontamination
from crossmer.llm.exact_search import OP11_SQL, op11_exact_top_k
from crossmer.llm.fingerprints import op7_fingerprints
from crossmer.llm.language_id import op8_language_id, op8_language_id_pages
from crossmer.llm.lengths import op3_token_counts
from crossmer.llm.near_dedup import op6_near_dedup
from crossmer.llm.packing import op5_best_fit_packing
from crossmer.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from crossmer.llm.seekable import op1_token_binary
from crossmer.llm.spelling import OP12_SQL, op12_spelling_variants
from crossmer.llm.toxicity import op10_toxicity
from crossmer.llm.url_rules import OP2_SQL, op2_url_filter

QUERIES = {f.__name__: f for f in (
    op1_token_binary,
    op2_url_filter,
    op3_token_counts,
    op4_chat_format,
    op5_best_fit_packing,
    op6_near_dedup,
    op7_fingerprints,
    op8_language_id,
    op8_language_id_pages,
    op9_decontamination,
    op10_toxicity,
    op11_exact_top_k,
    op12_spelling_variants,
    op13_prefix_trie,
)}

SQL: dict[str, str] = {
    "op2_url_filter": OP2_SQL, "op11_exact_top_k": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL,
}

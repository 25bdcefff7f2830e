"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fingerprints import op2_fingerprints
from .language_id import op1_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP3_SQL, op3_mix_sources
from .ngram_join import OP8_SQL, op8_ngram_join
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_counts import op6_token_counts
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprints": op2_fingerprints,
    "op3_mix_sources": op3_mix_sources,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op3_mix_sources": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_ngram_join": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_url_filter": OP10_SQL,
}

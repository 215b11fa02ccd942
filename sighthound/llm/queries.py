"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from .language_id import op1_language_id
from .licenses import op8_license_scan
from .media import op3_media_png
from .mixing import OP5_SQL, op5_pareto_mix
from .multiset_hash import op6_multiset_hash
from .packing import op7_packing
from .preference import OP4_SQL, op4_preference_format
from .pseudonyms import op9_pii_pseudonyms
from .token_count import op2_token_count
from .trie_join import OP10_SQL, op10_ngram_join

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_count": op2_token_count,
    "op3_media_png": op3_media_png,
    "op4_preference_format": op4_preference_format,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL = {
    "op4_preference_format": OP4_SQL,
    "op5_pareto_mix": OP5_SQL,
    "op10_ngram_join": OP10_SQL,
}

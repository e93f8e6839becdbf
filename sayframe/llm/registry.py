"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP12_SQL, op12_chat_formatting
from .embeddings import op8_embedding_near_dedup
from .fingerprints import op7_fingerprints
from .jaccard import op1_jaccard_join
from .licenses import OP10_SQL, op10_license_scan
from .packing import op6_packing
from .periodic import op11_periodic_runs
from .pieces import op5_sentencepiece
from .sharding import op9_sharding
from .substrings import op3_substring_dedup
from .toxicity import op2_toxicity
from .trie import OP13_SQL, op13_prefix_trie
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op4_warc": OP4_SQL,
    "op10_license_scan": OP10_SQL,
    "op12_chat_formatting": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}

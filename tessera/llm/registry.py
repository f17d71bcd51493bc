"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat_format import OP8_SQL, op8_chat_format
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fingerprints import op9_fingerprints
from .jaccard_join import op4_jaccard_join
from .language_model import op1_lm_scoring
from .packing import op6_packing
from .pii import op2_pii
from .toxicity import op10_toxicity
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op5_url_filter": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_chat_format": OP8_SQL,
}

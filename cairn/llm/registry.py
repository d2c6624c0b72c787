"""Queries of the text operators and their SQL."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .decontaminate import OP5_SQL, op5_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .merkle import OP12_SQL, op12_merkle
from .packing import op3_packing
from .quality import op7_quality
from .repeated_text import op8_repeated_text
from .shuffle_shards import op10_shuffle_shards
from .simhash import op2_simhash
from .token_store import op4_token_store
from .toxicity import op1_toxicity
from .url_filter import op6_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_token_store": op4_token_store,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_repeated_text": op8_repeated_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_shuffle_shards": op10_shuffle_shards,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle": op12_merkle,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op5_decontaminate": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_merkle": OP12_SQL, "op13_vector_codes": OP13_SQL}

"""Queries of this folder, and SQL where SQL can say the same."""

from __future__ import annotations

from .exact_dedup import OP10_SQL, op10_exact_dedup
from .lang_id import op5_lang_id
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import op9_mixing
from .pii import op7_pii
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op3_simhash
from .token_counts import op4_token_counts
from .toxicity import op6_toxicity
from .transport_stream import op2_transport_stream

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_transport_stream": op2_transport_stream,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_lang_id": op5_lang_id,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {"op8_line_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}

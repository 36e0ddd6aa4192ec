"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat import OP8_SQL, op8_chat
from .lengths import op2_token_counts
from .metric import OP13_SQL, op13_vector_neardup
from .mining import OP11_SQL, op11_hard_negatives
from .mixing import OP1_SQL, op1_mixing
from .neardup import OP10_SQL, op10_neardup
from .neighbours import OP6_SQL, op6_neighbours
from .periods import op12_periods
from .private import op3_pseudonyms
from .quality import op5_quality
from .scoring import op9_scoring
from .substring import OP4_SQL, op4_substring

QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_pseudonyms, op4_substring, op5_quality, op6_neighbours, op7_bpe, op8_chat, op9_scoring, op10_neardup, op11_hard_negatives, op12_periods, op13_vector_neardup)}

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op4_substring": OP4_SQL, "op6_neighbours": OP6_SQL, "op8_chat": OP8_SQL, "op10_neardup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_vector_neardup": OP13_SQL}

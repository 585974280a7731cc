"""The operators' queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from loredeck.llm.op1_url import op1_url_filter
from loredeck.llm.op10_decontaminate import op10_decontaminate
from loredeck.llm.op11_negatives import SQL as OP11_SQL
from loredeck.llm.op11_negatives import op11_hard_negatives
from loredeck.llm.op12_suffixes import op12_suffix_dedup
from loredeck.llm.op13_conversations import op13_conversation_repair
from loredeck.llm.op2_bpe import op2_byte_bpe
from loredeck.llm.op3_quality import op3_quality
from loredeck.llm.op4_attention_lm import op4_attention_lm
from loredeck.llm.op5_token_files import op5_token_files
from loredeck.llm.op6_language import op6_language_id
from loredeck.llm.op7_jaccard import SQL as OP7_SQL
from loredeck.llm.op7_jaccard import op7_ngram_join
from loredeck.llm.op8_neighbours import op8_nearest
from loredeck.llm.op9_toxicity import op9_toxicity

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_attention_lm": op4_attention_lm,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_ngram_join": op7_ngram_join,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op7_ngram_join": OP7_SQL, "op11_hard_negatives": OP11_SQL}

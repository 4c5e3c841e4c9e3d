"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from vantloom.llm.bitsliced import OP8_SQL, op8_exact_topk
from vantloom.llm.bpe import op9_bpe_round_trip
from vantloom.llm.chat import OP1_SQL, op1_chat_format
from vantloom.llm.langid import op3_language_id
from vantloom.llm.line_dedup import op4_line_dedup
from vantloom.llm.matroska import op6_media_columns
from vantloom.llm.mixing import OP2_SQL, op2_source_mix
from vantloom.llm.quality import op5_quality
from vantloom.llm.simhash import op10_simhash_groups
from vantloom.llm.token_counts import op7_token_counts

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_media_columns": op6_media_columns,
    "op7_token_counts": op7_token_counts,
    "op8_exact_topk": op8_exact_topk,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_simhash_groups": op10_simhash_groups,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op2_source_mix": OP2_SQL, "op8_exact_topk": OP8_SQL}

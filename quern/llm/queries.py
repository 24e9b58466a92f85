"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import chat_perspectives, decontamination, exact_topk, spelling_groups, vector_codes
from quern.llm.chat_perspectives import op3_chat_perspectives
from quern.llm.decontamination import op13_decontamination
from quern.llm.exact_topk import op6_exact_topk
from quern.llm.main_text import op2_main_text
from quern.llm.media_columns import op10_media_columns
from quern.llm.ngram_join import op1_ngram_join
from quern.llm.quality_lm import op4_quality_lm
from quern.llm.repeated_bytes import op9_repeated_bytes
from quern.llm.sentence_pieces import op7_sentence_pieces
from quern.llm.source_mix import op5_source_mix
from quern.llm.spelling_groups import op11_spelling_groups
from quern.llm.toxicity_chain import op8_toxicity_chain
from quern.llm.vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_main_text": op2_main_text,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_quality_lm": op4_quality_lm,
    "op5_source_mix": op5_source_mix,
    "op6_exact_topk": op6_exact_topk,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_media_columns": op10_media_columns,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_perspectives": chat_perspectives.ORACLE_SQL,
    "op6_exact_topk": exact_topk.ORACLE_SQL,
    "op11_spelling_groups": spelling_groups.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_decontamination": decontamination.ORACLE_SQL,
}

"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from planwise.llm.html_extract import op8_html_extract
from planwise.llm.maxscore import ORACLE_OP3, op3_maxscore_topk
from planwise.llm.mixing import ORACLE_OP4, op4_source_mixing
from planwise.llm.ngram_join import op10_ngram_join
from planwise.llm.quality_ordinal import op9_quality_ordinal
from planwise.llm.sentence_pieces import op5_sentencepiece
from planwise.llm.suffix_dedup import op6_suffix_dedup
from planwise.llm.token_orc import op2_token_orc
from planwise.llm.toxicity import op1_toxicity
from planwise.llm.vector_join import ORACLE_OP7, op7_embedding_dedup

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_orc": op2_token_orc,
    "op3_maxscore_topk": op3_maxscore_topk,
    "op4_source_mixing": op4_source_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_quality_ordinal": op9_quality_ordinal,
    "op10_ngram_join": op10_ngram_join,
}

ORACLES = {
    "op3_maxscore_topk": ORACLE_OP3,
    "op4_source_mixing": ORACLE_OP4,
    "op7_embedding_dedup": ORACLE_OP7,
}

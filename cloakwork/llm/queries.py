"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from cloakwork.llm.bm25 import op3_search
from cloakwork.llm.fingerprints import op1_fingerprints
from cloakwork.llm.lines import op9_lines
from cloakwork.llm.minhash import op4_minhash
from cloakwork.llm.packing import op6_packing
from cloakwork.llm.pieces import op7_pieces
from cloakwork.llm.sequences import op5_sequences
from cloakwork.llm.suffixes import op10_suffixes
from cloakwork.llm.toxicity import op8_toxicity
from cloakwork.llm.urls import OP2_SQL, op2_urls

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_urls": op2_urls,
    "op3_search": op3_search,
    "op4_minhash": op4_minhash,
    "op5_sequences": op5_sequences,
    "op6_packing": op6_packing,
    "op7_pieces": op7_pieces,
    "op8_toxicity": op8_toxicity,
    "op9_lines": op9_lines,
    "op10_suffixes": op10_suffixes,
}

SQL = {"op2_urls": OP2_SQL}

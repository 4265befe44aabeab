"""The registered queries of this subpackage."""

from __future__ import annotations

from textfacts.llm.alignment import op12_alignment
from textfacts.llm.chat import OP3_SQL, op3_chat
from textfacts.llm.collocations import OP11_SQL, op11_collocations
from textfacts.llm.decontaminate import op9_decontaminate
from textfacts.llm.interpolation import op13_language_model
from textfacts.llm.language import op5_language
from textfacts.llm.nearcopies import op1_near_copies
from textfacts.llm.neighbours import op6_neighbours
from textfacts.llm.passages import op10_passages
from textfacts.llm.pieces import op8_pieces
from textfacts.llm.quality import op2_quality
from textfacts.llm.toxicity import op7_toxicity
from textfacts.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_near_copies": op1_near_copies,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_neighbours": op6_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_pieces": op8_pieces,
    "op9_decontaminate": op9_decontaminate,
    "op10_passages": op10_passages,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_language_model": op13_language_model,
}

#: DuckDB twins; the other queries are tested against brute force or held-out labels.
ORACLES: dict[str, str] = {"op3_chat": OP3_SQL, "op4_warc": OP4_SQL, "op11_collocations": OP11_SQL}

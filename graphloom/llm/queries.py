"""The queries of the training-data operators, and SQL for those that SQL can express."""

from graphloom.llm.chat import OP3_SQL, op3_chat_formatting
from graphloom.llm.decontaminate import op8_decontamination
from graphloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from graphloom.llm.html_text import op9_html_text
from graphloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from graphloom.llm.pieces import op7_pieces
from graphloom.llm.simhash import op4_simhash
from graphloom.llm.suffix_dedup import op6_suffix_dedup
from graphloom.llm.tokens import op5_token_counts
from graphloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pieces": op7_pieces,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_chat_formatting": OP3_SQL}

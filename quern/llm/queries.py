"""The registered queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from quern.llm.decontamination import OP12_SQL, op12_decontamination
from quern.llm.fingerprints import op1_fingerprints
from quern.llm.html_text import op3_html_text
from quern.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from quern.llm.line_dedup import OP4_SQL, op4_line_dedup
from quern.llm.mixing import OP6_SQL, op6_mixing
from quern.llm.nearest import op7_nearest
from quern.llm.packing import op5_packing
from quern.llm.runs import op11_periodic_runs
from quern.llm.spelling import op13_spelling_variants
from quern.llm.substrings import OP2_SQL, op2_substring_dedup
from quern.llm.token_index import op9_token_index
from quern.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_nearest": op7_nearest,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_index": op9_token_index,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op12_decontamination": OP12_SQL,
}

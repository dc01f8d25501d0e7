"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lumenpage.llm.chat import OP10_SQL, op10_chat
from lumenpage.llm.decontamination import op6_decontamination
from lumenpage.llm.jaccard import op4_jaccard
from lumenpage.llm.licenses import op9_licenses
from lumenpage.llm.packing import op7_packing
from lumenpage.llm.pii import op8_pii
from lumenpage.llm.repeats import op5_repeats
from lumenpage.llm.secrets import op3_secrets
from lumenpage.llm.topk import OP2_SQL, op2_topk
from lumenpage.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_secrets": op3_secrets,
    "op4_jaccard": op4_jaccard,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_chat": op10_chat,
}

ORACLE_SQL = {"op2_topk": OP2_SQL, "op10_chat": OP10_SQL}

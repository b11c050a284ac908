"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from storyweft.llm import exact_dedup, shingle_join
from storyweft.llm.bpe_codec import op4_bpe_codec
from storyweft.llm.context_mixing import op7_context_mixing
from storyweft.llm.packing import op10_packing
from storyweft.llm.spot_signatures import op1_spot_signatures
from storyweft.llm.token_counts import op6_token_counts
from storyweft.llm.token_files import op3_token_files
from storyweft.llm.toxicity import op8_toxicity
from storyweft.llm.url_filter import op9_url_filter

QUERIES = {f.__name__: f for f in (op1_spot_signatures, shingle_join.op2_near_duplicates, op3_token_files, op4_bpe_codec, exact_dedup.op5_exact_dedup, op6_token_counts, op7_context_mixing, op8_toxicity, op9_url_filter, op10_packing)}

ORACLE_SQL = {"op2_near_duplicates": shingle_join.SQL, "op5_exact_dedup": exact_dedup.SQL}

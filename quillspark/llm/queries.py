"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .mixing import OP8_SQL, op8_mixing
from .ngram_join import op3_ngram_join
from .pii import op6_pii
from .quality import OP4_SQL, op4_quality
from .secrets import op9_secrets
from .token_counts import op5_token_counts
from .token_files import op10_token_files
from .toxicity import op2_toxicity
from .urls import OP7_SQL, op7_urls

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_urls": op7_urls,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_token_files": op10_token_files,
}

ORACLE: dict[str, str] = {"op4_quality": OP4_SQL, "op7_urls": OP7_SQL, "op8_mixing": OP8_SQL}

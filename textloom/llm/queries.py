"""The registered queries of this subpackage and their DuckDB SQL, where SQL can say them."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .fingerprints import op8_fingerprints
from .html_text import op10_html_text
from .language_id import op4_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import op6_mixing
from .near_dedup import op5_near_dedup
from .preferences import OP7_SQL, op7_preferences
from .secrets import op9_secrets
from .sharding import op1_sharding

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_preferences": op7_preferences,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op7_preferences": OP7_SQL}

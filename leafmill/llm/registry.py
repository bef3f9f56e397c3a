"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from leafmill.llm.collocations import OP13_SQL, op13_collocations
from leafmill.llm.language import op1_language_id
from leafmill.llm.merkle import OP11_SQL, op11_merkle_manifest
from leafmill.llm.mixing import OP10_SQL, op10_mixing
from leafmill.llm.near_dup import OP6_SQL, op6_near_dup
from leafmill.llm.nearest import OP8_SQL, op8_nearest
from leafmill.llm.packing import op7_packing
from leafmill.llm.quality import op4_quality
from leafmill.llm.repeats import op3_suffix_dedup
from leafmill.llm.rules import OP9_SQL, op9_quality_rules
from leafmill.llm.secrets import op5_secrets, op5_sql
from leafmill.llm.token_counts import op12_token_counts
from leafmill.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_toxicity,
        op3_suffix_dedup,
        op4_quality,
        op5_secrets,
        op6_near_dup,
        op7_packing,
        op8_nearest,
        op9_quality_rules,
        op10_mixing,
        op11_merkle_manifest,
        op12_token_counts,
        op13_collocations,
    )
}
SQL = {
    "op5_secrets": op5_sql(),
    "op6_near_dup": OP6_SQL,
    "op8_nearest": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_collocations": OP13_SQL,
}

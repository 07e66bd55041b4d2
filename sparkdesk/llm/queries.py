"""The operators of this subpackage as queries over the test tables, and their SQL."""

from __future__ import annotations

from sparkdesk.llm.bpe import op1_bpe
from sparkdesk.llm.chat import op8_chat_formatting, op8_sql
from sparkdesk.llm.lattice import op4_embeddings
from sparkdesk.llm.lexical import op13_lexical, op13_sql
from sparkdesk.llm.line_dedup import op3_line_dedup, op3_sql
from sparkdesk.llm.mixing import op9_mixing, op9_sql
from sparkdesk.llm.ngram_join import op2_ngram_join
from sparkdesk.llm.periodic import op11_periodic_runs
from sparkdesk.llm.quality_rules import op5_quality_rules
from sparkdesk.llm.rule_ensemble import op6_rule_ensemble
from sparkdesk.llm.sharding import op10_sharding
from sparkdesk.llm.top_k import op12_sql, op12_top_k
from sparkdesk.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_embeddings": op4_embeddings,
    "op5_quality_rules": op5_quality_rules,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_top_k": op12_top_k,
    "op13_lexical": op13_lexical,
}

# Queries whose rows SQL can express; the others are tested against brute force.
ORACLES = {
    "op3_line_dedup": op3_sql,
    "op8_chat_formatting": op8_sql,
    "op9_mixing": op9_sql,
    "op12_top_k": op12_sql,
    "op13_lexical": op13_sql,
}

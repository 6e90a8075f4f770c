"""The queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from lagwise.llm.bpe import op4_byte_bpe
from lagwise.llm.contamination import OP12_SQL, op12_decontamination
from lagwise.llm.exact import OP7_SQL, op7_exact_dedup
from lagwise.llm.language import op1_language_id
from lagwise.llm.mixing import OP3_SQL, op3_mixing
from lagwise.llm.quality import op2_quality_classifier
from lagwise.llm.ranking import OP13_SQL, op13_lexical_search
from lagwise.llm.rules import op10_quality_rules
from lagwise.llm.sharding import op9_sharding
from lagwise.llm.simhash import op8_simhash_dedup
from lagwise.llm.substring import op5_substring_dedup
from lagwise.llm.toxicity import op6_toxicity
from lagwise.llm.variants import OP11_SQL, op11_spelling_variants

QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality_classifier, op3_mixing, op4_byte_bpe, op5_substring_dedup,
    op6_toxicity, op7_exact_dedup, op8_simhash_dedup, op9_sharding, op10_quality_rules,
    op11_spelling_variants, op12_decontamination, op13_lexical_search,
)}
ORACLES = {
    "op3_mixing": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_spelling_variants": OP11_SQL,
    "op12_decontamination": OP12_SQL, "op13_lexical_search": OP13_SQL,
}

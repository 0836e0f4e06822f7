"""The ``opN_*`` queries and, where SQL can express them, their SQL."""

from chainlens.llm import (balanced_mix, conversation_trie, exact_dup, fill_middle, licenses, near_dup, packing, paragraph_dup, quality_gam,
                           quality_rules, secrets, token_counts, toxicity_ftrl)

MODULES = (balanced_mix, exact_dup, near_dup, packing, quality_rules, secrets,
           licenses, quality_gam, token_counts, paragraph_dup, toxicity_ftrl, fill_middle, conversation_trie)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

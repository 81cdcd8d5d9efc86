"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from kmerloom.llm.bpe import op3_byte_bpe
from kmerloom.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from kmerloom.llm.language_id import op9_language_id
from kmerloom.llm.language_model import op8_language_model
from kmerloom.llm.mixing import OP1_SQL, op1_mixing
from kmerloom.llm.near_dedup import op5_near_dedup
from kmerloom.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from kmerloom.llm.quality import OP6_SQL, op6_quality
from kmerloom.llm.secrets import op4_secrets
from kmerloom.llm.sharding import OP10_SQL, op10_sharding
from kmerloom.llm.token_counts import op2_token_counts
from kmerloom.llm.toxicity import op12_toxicity
from kmerloom.llm.whitening import op11_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secrets": op4_secrets,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_model": op8_language_model,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op6_quality": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op10_sharding": OP10_SQL, "op13_prefix_trie": OP13_SQL}

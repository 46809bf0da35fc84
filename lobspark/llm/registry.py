"""Queries of this package by name, and their SQL where SQL can express them."""

from lobspark.llm.alignment import op12_tokenizer_alignment
from lobspark.llm.centroids import OP13_SQL, op13_centroid_clustering
from lobspark.llm.decontaminate import OP2_SQL, op2_decontamination
from lobspark.llm.packing import op9_best_fit_packing
from lobspark.llm.pii import op7_pii
from lobspark.llm.quality import op3_quality_classifier
from lobspark.llm.rules import op8_quality_rules
from lobspark.llm.simhash import op6_simhash
from lobspark.llm.substrings import OP1_SQL, op1_substring_dedup
from lobspark.llm.suffixes import OP4_SQL, op4_suffix_dedup
from lobspark.llm.token_blocks import op11_token_blocks
from lobspark.llm.tokens import op10_token_counts
from lobspark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "op11_token_blocks": op11_token_blocks,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_centroid_clustering": op13_centroid_clustering,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op13_centroid_clustering": OP13_SQL}

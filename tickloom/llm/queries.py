"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from .decontaminate import op6_benchmark_decontamination
from .langid import op8_language_id
from .lines import OP10_SQL, op10_line_dedup
from .middle import OP12_SQL, op12_fill_in_middle
from .mixing import op5_lm_scoring
from .packing import op4_best_fit_packing
from .phrases import op9_phrase_fingerprints
from .repeats import op7_suffix_array_dedup
from .secrets import op1_secret_scan
from .simhash import op3_simhash_near_dedup
from .spelling import op13_spelling_variants
from .tiers import op11_hierarchical_packing
from .tokens import op2_token_counts

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_id": op8_language_id,
    "op9_phrase_fingerprints": op9_phrase_fingerprints,
    "op10_line_dedup": op10_line_dedup,
    "op11_hierarchical_packing": op11_hierarchical_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op10_line_dedup": OP10_SQL, "op12_fill_in_middle": OP12_SQL}

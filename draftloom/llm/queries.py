"""The registered queries of this package and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe_round_trip
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language_id import op5_language_id
from .licenses import op2_license_scan
from .line_dedup import OP13_SQL, op13_line_dedup
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .pii import op4_pii
from .quality import op7_quality_classifier
from .resample import OP12_SQL, op12_importance_resampling
from .search import OP11_SQL, op11_ranked_search
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": op13_line_dedup,
}

#: Of op2 and op4 SQL can state the base columns only, of op5, op7, op8 and op10 none: they are held against brute force in the tests.
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}

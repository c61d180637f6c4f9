"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floorwright.llm import decontamination, divergence, infilling, preferences
from floorwright.llm.decontamination import op8_benchmark_decontamination
from floorwright.llm.divergence import op11_source_divergence
from floorwright.llm.edit_counts import op9_token_counts
from floorwright.llm.html_extraction import op4_html_extraction
from floorwright.llm.infilling import op13_fill_in_middle
from floorwright.llm.ngram_join import op5_ngram_jaccard_join
from floorwright.llm.nn_descent import op7_embedding_near_dedup
from floorwright.llm.packing import op6_token_packing
from floorwright.llm.preferences import op1_preference_format
from floorwright.llm.recurrent_lm import op2_language_model
from floorwright.llm.sentencepiece import op10_sentencepiece
from floorwright.llm.toxicity import op3_toxicity
from floorwright.llm.url_filter import op12_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_format": op1_preference_format,
    "op6_token_packing": op6_token_packing,
    "op9_token_counts": op9_token_counts,
    "op2_language_model": op2_language_model,
    "op4_html_extraction": op4_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filter": op12_url_filter,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_preference_format": preferences.ORACLE,
    "op8_benchmark_decontamination": decontamination.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_fill_in_middle": infilling.ORACLE,
}

"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.covertree import OP10_SQL, op10_cover_tree
from tidemill.llm.decontam import op2_latent_decontamination
from tidemill.llm.heaps import OP12_SQL, op12_heap_bounds
from tidemill.llm.jaccard import OP8_SQL, op8_ngram_jaccard
from tidemill.llm.lm import op5_deleted_interpolation
from tidemill.llm.mixing import OP4_SQL, op4_temperature_mixing
from tidemill.llm.naming import OP11_SQL, op11_block_naming
from tidemill.llm.pages import op7_page_differencing
from tidemill.llm.pii import op1_surrogates
from tidemill.llm.quality import op3_compression_quality
from tidemill.llm.tokens import op6_token_planes
from tidemill.llm.toxicity import op9_toxicity
from tidemill.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_compression_quality": op3_compression_quality,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_token_planes": op6_token_planes,
    "op7_page_differencing": op7_page_differencing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_cover_tree": op10_cover_tree,
    "op11_block_naming": op11_block_naming,
    "op12_heap_bounds": op12_heap_bounds,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op4_temperature_mixing": OP4_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op10_cover_tree": OP10_SQL,
    "op11_block_naming": OP11_SQL,
    "op12_heap_bounds": OP12_SQL,
}

"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediafold.llm import block_naming
from mediafold.llm.block_naming import op3_block_naming
from mediafold.llm.bpe_codec import op7_bpe_codec
from mediafold.llm.compaction import op6_tiered_compaction
from mediafold.llm.path_templates import op5_path_templates
from mediafold.llm.period_runs import op13_period_runs
from mediafold.llm.ppm import op8_ppm
from mediafold.llm.repair_store import op2_repair_store
from mediafold.llm.set_join import op11_set_join
from mediafold.llm.simhash import op9_simhash_pivots
from mediafold.llm.toxicity_chain import op1_toxicity_chain
from mediafold.llm.vector_codes import op12_elkan_codes
from mediafold.llm.vector_packing import op4_vector_packing
from mediafold.llm.wav_fingerprint import op10_wav_fingerprint

Query = Callable[[SparkSession, str], DataFrame]


QUERIES = (
    op1_toxicity_chain, op2_repair_store, op3_block_naming, op4_vector_packing, op5_path_templates, op6_tiered_compaction, op7_bpe_codec, op8_ppm, op9_simhash_pivots, op10_wav_fingerprint,
    op11_set_join, op12_elkan_codes, op13_period_runs,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_block_naming": block_naming.ORACLE_SQL}

"""Queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.exact_dedup import OP4_SQL, op4_chunk_recipe_dedup
from quarrymill.llm.host_rules import OP11_SQL, op11_host_rules
from quarrymill.llm.language_id import op9_language_id
from quarrymill.llm.licenses import op5_license_scan
from quarrymill.llm.mixing import op1_entropy_mix
from quarrymill.llm.packing import op3_bm25_packing
from quarrymill.llm.resampling import op13_crc_resampling
from quarrymill.llm.sharding import op2_histogram_shards
from quarrymill.llm.simhash import op6_simhash_components
from quarrymill.llm.spelling import op12_spelling_variants
from quarrymill.llm.syncmers import op7_syncmer_fingerprints
from quarrymill.llm.toxicity import op10_toxicity
from quarrymill.llm.warc import OP8_SQL, op8_warc

OPERATORS = (
    op1_entropy_mix, op2_histogram_shards, op3_bm25_packing, op4_chunk_recipe_dedup, op5_license_scan, op6_simhash_components, op7_syncmer_fingerprints, op8_warc,
    op9_language_id, op10_toxicity, op11_host_rules, op12_spelling_variants, op13_crc_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {op4_chunk_recipe_dedup.__name__: OP4_SQL, op8_warc.__name__: OP8_SQL, op11_host_rules.__name__: OP11_SQL}

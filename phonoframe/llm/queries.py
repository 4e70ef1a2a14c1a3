"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm import ann, decontam, license, mixing, pii, quality, simhash, tokenout, toxicity, urlfilter
from phonoframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
TARGETS = {0: 0.95, 1: 0.05}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _simhash(spark: SparkSession, d: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, d, "documents"), shingle=4, max_distance=4)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {
        "op1_pii": lambda s, d: pii.digest(pii.find(table(s, d, "documents"))),
        "op2_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op3_neighbours": lambda s, d: ann.neighbours(table(s, d, "embeddings")),
        "op4_url_filter": lambda s, d: urlfilter.verdicts(table(s, d, "pages"), urlfilter.RULES),
        "op5_simhash": _simhash,
        "op6_mixing": lambda s, d: mixing.rates(table(s, d, "documents"), table(s, d, "labels"), TARGETS).drop("row_hash"),
        "op7_license": lambda s, d: license.digest(license.scan(table(s, d, "documents"))),
        "op8_decontaminate": lambda s, d: decontam.contained(table(s, d, "documents"), table(s, d, "benchmark")).drop("row_hash"),
        "op9_quality": lambda s, d: quality.quality(table(s, d, "documents"), table(s, d, "labels")),
        "op10_token_output": lambda s, d: tokenout.token_files(table(s, d, "documents"), tokenizer_path()),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urlfilter.SQL, "op8_decontaminate": decontam.SQL}

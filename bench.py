"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from phonoframe import queries as own

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["oov_audit", "encode_ids", "tokens_by_kind", "token_offsets", "neighbours", "latin_runs", "lexicon_majority", "suffix_majority", "context_majority", "number_words", "year_ordinals", "affricate_fold", "subword_mean", "phonemize_years", "phonemize_numbers"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, took = own.queries(), {}
    for name in NAMES:
        began = time.time()
        known[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    rows = spark.read.parquet(f"{SF}/orders.parquet").count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "sentences_per_s": round(rows / took["phonemize_numbers"], 1)}))


if __name__ == "__main__":
    main()

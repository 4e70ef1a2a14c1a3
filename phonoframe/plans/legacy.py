"""The two-stage way by engines of one's own: accents, then sounds, with marks and overrides between and after them.

The engines aren't part of the library. `load` makes the pair (accent, phonemize) of functions from text to text, once a
worker and on one thread; each different text is worked on once. A text on which an engine fails gives an empty string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.functions import ipatext, vocab
from phonoframe.plans.models import attempt, one_thread
from phonoframe.sources import tables

Engines = tuple[Callable[[str], str], Callable[[str], str]]


def _part(load: Callable[[], Engines], which: int):
    """Loader of one of the two engines; both parts share one pair."""
    from phonoframe.plans.models import loaded

    def whole() -> Engines:
        one_thread()
        return load()

    name = (getattr(load, "__module__", ""), getattr(load, "__qualname__", repr(load)))
    whole.key = ("engines", name)

    def part():
        return loaded(whole)[which]

    part.key = ("engine", which, name)
    return part


def _mapped(df: DataFrame, column: str, out: str, load) -> DataFrame:
    """df with a column out: the engine's text, null where it failed; the engine runs over the rows of df."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [None if x is None else attempt(load, x) for x in b[column]]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` string")


def accented(df: DataFrame, load: Callable[[], Engines], text_col: str = "text") -> DataFrame:
    """(source, accented): every different trimmed text, with + before stressed vowels and before a written ё."""
    texts = df.select(F.regexp_replace(F.col(text_col), r"(?U)^\s+|\s+$", "").alias("source")).where("source is not null").distinct()
    return _mapped(texts, "source", "raw", _part(load, 0)).select("source", ipatext.mark_yo(F.col("raw")).alias("accented"))


def phonemize_by(df: DataFrame, load: Callable[[], Engines], text_col: str = "text", limit: int = 0, order: str | None = None) -> DataFrame:
    """df with a column ipa, not yet normalised; '' where the text is null or an engine fails. limit: the first rows only, by
    the column `order` if it is given; 0: all."""
    if limit:
        df = (df.orderBy(order) if order else df).limit(limit)
    said = _mapped(accented(df, load, text_col), "accented", "raw", _part(load, 1))
    ipa = ipatext.apply_overrides(F.col("source"), F.trim(ipatext.remap_legacy(F.col("raw"))), F.col("accented"))
    key = F.regexp_replace(F.col(text_col), r"(?U)^\s+|\s+$", "")
    return df.drop("ipa").join(said.select(F.col("source").alias("__source"), ipa.alias("__ipa")), key == F.col("__source"), "left").withColumn("ipa", F.coalesce("__ipa", F.lit(""))).drop("__source", "__ipa")


def outcome(df: DataFrame) -> DataFrame:
    """(rows, failures): how many rows there are, and how many without a sound."""
    return df.agg(F.count("*").alias("rows"), F.count(F.when(F.coalesce(F.col("ipa"), F.lit("")) == "", 1)).alias("failures"))


def run_corpus(spark: SparkSession, source: str, target: str, load: Callable[[], Engines], text_col: str = "text", limit: int = 0) -> dict[str, float]:
    """Read a corpus CSV, write it with its ipa column in input order, and return rows, failures, seconds and rows per second."""
    import time

    began = time.monotonic()
    rows = tables.numbered(tables.read_csv(spark, source))
    done = phonemize_by(rows, load, text_col, limit, "__row")
    tables.write_csv(done, target, "__row", keep_order=False)
    got = outcome(tables.read_csv(spark, target).select(F.col("ipa"))).first()
    seconds = time.monotonic() - began
    return {"rows": got.rows, "failures": got.failures, "seconds": seconds, "rows_per_s": got.rows / max(seconds, 1e-9)}


def spoken_texts(spark: SparkSession, texts: list[str], load: Callable[[], Engines], out: str | None = None) -> DataFrame:
    """(text, accented, ipa, unknown) of literal texts, in order; unknown: symbols outside the table. out: also write the ipa
    as a JSON list; a text without sound raises then."""
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    said = phonemize_by(rows, load)
    marks = accented(rows, load)
    both = said.join(marks, F.regexp_replace("text", r"(?U)^\s+|\s+$", "") == F.col("source"), "left")
    found = both.select("n", "text", "accented", "ipa", vocab.unknown_symbols(ipatext.to_vocab_ipa(F.col("ipa"))).alias("unknown")).orderBy("n")
    if out:
        tables.write_json_list(found, "ipa", "n", out)
    return found.drop("n")

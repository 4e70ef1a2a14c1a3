"""Scores against gold pronunciations, and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.functions import phones, vocab

PUNCTUATION = "[.,!?:;]"


def slots_match(words: Column, slots: Column) -> Column:
    """Whether each word is among the variants of its slot."""
    return (F.size(words) == F.size(slots)) & F.forall(F.zip_with(words, slots, lambda w, s: F.coalesce(F.array_contains(s, w), F.lit(False))), lambda x: x)


def error_rate(said: Column, gold: Column) -> Column:
    return F.levenshtein(said, gold) / F.length(gold)


def scored(rows: DataFrame) -> DataFrame:
    """rows (kind, text, ipa, slots) with words, passes, word_hits, stress_hits, stressed, errors, phones and unknown.

    words: those of the ipa without punctuation; passes: each is among the variants of its slot; hits, of rows with as many
    words as slots: words that are, and words of two vowels or more whose stress is the first variant's; errors: edits to the
    first variants; unknown: symbols outside the table, sorted.
    """
    said = F.filter(F.split(F.regexp_replace(F.coalesce("ipa", F.lit("")), PUNCTUATION, ""), " "), lambda w: w != "")
    rows = rows.withColumn("words", said).withColumn("gold", F.transform("slots", lambda s: F.get(s, F.lit(0))))
    same = F.size("words") == F.size("slots")
    hits = F.size(F.filter(F.zip_with("words", "slots", lambda w, s: F.coalesce(F.array_contains(s, w), F.lit(False))), lambda x: x))
    long = lambda g: F.length(F.regexp_replace(g, f"[^{phones.SOUND_VOWELS}]", "")) >= 2
    stress = F.zip_with("words", "gold", lambda w, g: F.when(long(g), F.coalesce(phones.stress_number(w) == phones.stress_number(g), F.lit(False))))
    return rows.select(
        "*", slots_match(F.col("words"), F.col("slots")).alias("passes"), F.when(same, hits).otherwise(0).alias("word_hits"), F.when(same, F.size(F.filter(stress, lambda x: x))).otherwise(0).alias("stress_hits"),
        F.size(F.filter("gold", long)).alias("stressed"), F.levenshtein(F.array_join("words", " "), F.array_join("gold", " ")).alias("errors"), F.length(F.array_join("gold", " ")).alias("phones"),
        F.array_sort(vocab.unknown_symbols(F.coalesce("ipa", F.lit("")))).alias("unknown"),
    ).drop("gold")


def totals(rows: DataFrame) -> DataFrame:
    """(kind, n, failed, words, word_hits, stressed, stress_hits, per, unknown) over scored rows, by kind."""
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count(F.when(~F.col("passes"), 1)).alias("failed"), F.sum(F.size("slots")).alias("words"), F.sum("word_hits").alias("word_hits"), F.sum("stressed").alias("stressed"),
        F.sum("stress_hits").alias("stress_hits"), F.round(F.sum("errors") / F.sum("phones"), 6).alias("per"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("unknown")))), "").alias("unknown"),
    )


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    odds = F.transform(values, lambda x: F.exp(x.cast("double") - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place of the greatest value, the first at ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1

"""The stateless steps on a stream: normalised text, tokens with neighbours, and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.functions import tokens, vocab
from phonoframe.plans.phonemize import clean


def prepared(stream: DataFrame, text_col: str = "text") -> DataFrame:
    text = clean(F.col(text_col))
    return stream.withColumn("clean", text).withColumn("tokens", tokens.sited(tokens.tokens(text))).withColumn("ids", vocab.encode(F.col(text_col)))

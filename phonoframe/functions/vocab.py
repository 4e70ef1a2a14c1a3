"""The 256-slot symbol table, and encoding by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAD, BOS, EOS = 0, 1, 2
# The order of the symbols
SYMBOLS = (
    "_^$ !'(),-.:;?abcdefhijklmnopqrstuvwxyzæçðøħŋœǀǁǂǃɐɑɒɓɔɕɖɗɘəɚɛɜɞɟɠɡɢɣɤɥɦɧɨɪɫɬɭɮɯɰɱɲɳɴɵɶɸɹɺɻɽɾʀʁʂʃʄʈʉʊʋʌʍʎʏʐʑʒʔʕʘʙʛʜʝʟʡʢʲˈˌːˑ˞βθχᵻⱱ"
    "0123456789\u0327\u0303\u032a\u032f\u0329ʰˤε↓#\"↑\u033a\u033bgʦXABCDEFGHIJKLMNOPQRSTUVWYZʤɝʧʼʴʱʷˠ→↗↘¡¿…«»*~/\\&"
    "\u0361\u035c\u0325\u032c\u0339\u031c\u031d\u031e\u031f\u0320\u0330\u0334\u031a\u0318\u0319\u0348\u0306\u0308\u031b\u0324\u033c\u02c0\u02c1\u02be\u02bf\u02bb\u02c9\u02ca\u02cb\u02c6\u02e5\u02e6\u02e7\u02e8\u02e9\u0300\u0301\u0302\u0304\u030c\u0307ʣ"
)


def symbols(spark: SparkSession) -> DataFrame:
    """(symbol, id): a row per used slot, 245 in all."""
    return spark.createDataFrame(list(zip(SYMBOLS, range(len(SYMBOLS)), strict=True)), "symbol string, id int")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[\p{L}\p{N}_]+>", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode(text: Column, on_oov: str = "pad") -> Column:
    """array<int>; unknown symbols get PAD, or fail the query with on_oov='raise'. Null stays null. See encode_warned, too."""
    if on_oov not in ("pad", "raise"):
        raise ValueError("on_oov: pad or raise")
    table = F.create_map(*[x for k, c in enumerate(SYMBOLS) for x in (F.lit(c), F.lit(k))])
    ids = F.transform(characters(strip_tags(text)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(PAD)))
    if on_oov == "raise":
        return F.when(F.size(unknown_symbols(text)) > 0, F.raise_error(F.lit("symbols outside the table"))).otherwise(ids)
    return ids


encode_multilang = encode  # tags of languages are stripped like all others


def encode_warned(df: DataFrame, text_col: str, out: str = "ids", name: str = "unknown_symbols"):
    """(df with a column of ids, observation): unknown symbols get PAD, and after an action the observation's get says how many
    texts hold some, and which ones stand in them."""
    from pyspark.sql import Observation

    seen = Observation(name)
    bad = unknown_symbols(F.col(text_col))
    rows = df.withColumn(out, encode(F.col(text_col))).withColumn("__bad", bad)
    texts, symbols = F.count(F.when(F.size("__bad") > 0, 1)).alias("texts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__bad")))).alias("symbols")
    return rows.observe(seen, texts, symbols).drop("__bad"), seen


def decode(ids: Column) -> Column:
    """Text of ids; `?` for ids without a symbol."""
    return F.array_join(F.transform(ids, lambda i: F.when((i >= 0) & (i < len(SYMBOLS)), F.substring(F.lit(SYMBOLS), i + 1, F.lit(1))).otherwise("?")), "")


def unknown_symbols(text: Column) -> Column:
    """Different symbols outside the table, in order of first appearance."""
    return F.array_distinct(F.filter(characters(strip_tags(text)), lambda c: F.position(c, F.lit(SYMBOLS)) == 0))

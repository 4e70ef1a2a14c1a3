"""Sources and sinks: CSV corpora, gzip TSV and JSON lexicon tables, gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.operators.stress import Lexicon

SCHEMAS = {
    "accents": ("word", "stress int"), "yo": ("e_form", "yo_form string"), "yo_homographs": ("e_form", "yo_form string"), "homographs": ("word", "candidates array<int>"),
    "homograph_ctx": ("key", "stress int"), "suffix_stress": ("suffix", "stress_from_end int"), "train_words": ("word", "stress int"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV, every column a string, fields of any length."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, encoding="UTF-8")


def write_csv(df: DataFrame, path: str, order: str | None = None, keep_order: bool = True) -> None:
    """Sorted by the column `order`, if it is given; keep_order: write that column too. Nulls are empty fields."""
    rows = df.orderBy(order) if order else df
    (rows if keep_order or not order else rows.drop(order)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """df with a column that has the order of its rows in the files, so that a sort on it restores the order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_json_list(df: DataFrame, column: str, order: str, path: str) -> None:
    """One file with a JSON array of a column's strings, in the order of another column; a null or empty string raises.

    For short lists: the array is one row."""
    held = df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda x: x["v"]).alias("v"), F.count(F.when(F.coalesce(F.col(column), F.lit("")) == "", 1)).alias("lost"))
    whole = F.when(F.col("lost") > 0, F.raise_error(F.lit("a text has no sound"))).otherwise(F.to_json("v"))
    held.select(whole.alias("value")).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row, text, ipa) of a labelled corpus CSV; row has the order of the lines."""
    return numbered(read_csv(spark, path), "row").select("row", "text", "ipa")


def read_metadata(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A corpus CSV with a text column, numbered by __row; limit: the first rows only, 0: all. No rows raise."""
    rows = numbered(read_csv(spark, path))
    rows = rows.orderBy("__row").limit(limit) if limit else rows
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def read_tsv(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value): each line is cut at its first tab; of a repeated key the last line counts."""
    name, kind = value.split(" ", 1)
    # a gzip file is one partition, read in order, so the rising numbers follow the lines
    lines = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")).where("instr(line, '\t') > 0")
    pair = lines.select(F.substring_index("line", "\t", 1).alias(key), F.expr("substring(line, instr(line, '\t') + 1)").alias("v"), "n")
    last = pair.groupBy(key).agg(F.max_by("v", "n").alias("v"))
    return last.select(key, (F.transform(F.split("v", ","), lambda x: x.cast("int")) if kind == "array<int>" else F.col("v").cast(kind)).alias(name))


def write_tsv(df: DataFrame, path: str) -> None:
    """Sorted by the first column, one gzip file; arrays as comma text."""
    key, value = df.columns
    text = F.array_join(F.transform(value, lambda x: x.cast("string")), ",") if df.schema[value].dataType.typeName() == "array" else F.col(value).cast("string")
    df.select(F.concat(F.col(key), F.lit("\t"), text).alias("value"), F.col(key).alias("k")).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(word, value) of a JSON object in a file, gzip or not."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("word", "value"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(kind, text, slots): blank lines, comments and lines of fewer than three fields are skipped."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    words = F.filter(F.split(F.get("f", F.lit(2)), " "), lambda w: w != "")
    return rows.select(F.get("f", F.lit(0)).alias("kind"), F.get("f", F.lit(1)).alias("text"), F.transform(words, lambda w: F.split(w, r"\|")).alias("slots"))


def read_lexicon(spark: SparkSession, folder: str) -> Lexicon:
    """The seven tables, as <name>.tsv.gz; a missing one fails at once."""
    return Lexicon(**{name: read_tsv(spark, f"{folder}/{name}.tsv.gz", key, value) for name, (key, value) in SCHEMAS.items()})

"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number n of different shingles, a partition for each power of two. An item's signature is a
bottom-k MinHash, its k least shingle hashes, and the share of a signature that a document holds estimates the containment
of the item in it, however long the document is. k and the number of hits that make a candidate are set by partition: a
document with the threshold's share of an item lacks at most m of its shingles, so it holds HITS of any m + HITS of them, and
no item is missed. Documents with fewer shingles than a partition needs skip it. Candidates are verified on the shingles
themselves. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import cut, let, sized

HITS = 2  # signature hits that make a candidate, where an item has so many shingles to spare
BROADCAST_ROWS = 500_000  # rows of the index up to which it is broadcast; beyond it the joins shuffle


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(w: Column, n: int, make) -> Column:
    count = F.size(w) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), make)).otherwise(F.array())


def shingles(w: Column, n: int) -> Column:
    return _windows(w, n, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))


def hashes(w: Column, n: int) -> Column:
    """As shingles, hashed; n counts in the hash, so those of different widths don't meet."""
    return _windows(w, n, lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]))


def _distinct(make, widths: list[int]):
    """Over an array of words: the different values of all widths."""
    return lambda w: F.array_distinct(F.concat(*[make(w, n) for n in widths]))


def index_items(items: DataFrame, item_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(item_id, width, part, s, h, n, need, hits, signed): a row per item and different shingle.

    width: words of a shingle, fewer than `shingle` for items of fewer words; part: the size partition; need: shingles that a
    document must hold; hits: those of the signature that make it a candidate; signed: whether h is in the signature.
    """
    base = items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    chosen = F.coalesce(*[F.when(F.col("width") == n, F.arrays_zip(shingles(F.col("w"), n).alias("s"), hashes(F.col("w"), n).alias("h"))) for n in range(1, shingle + 1)])
    rows = base.select("item_id", "width", F.explode(chosen).alias("x")).select("item_id", "width", "x.s", "x.h").distinct()
    sizes = rows.groupBy("item_id", "width").agg(F.sort_array(F.collect_list(F.struct("h", "s"))).alias("each")).withColumn("n", F.size("each"))
    sizes = sizes.withColumn("need", F.ceil(F.col("n") * threshold - 1e-9).cast("int")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    # within a partition all signatures are as long as its largest item needs, but for items that have fewer shingles
    top = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    k = F.least(F.col("n"), (F.floor(top * (1 - threshold) + 1e-9) + HITS).cast("int"))
    sizes = sizes.withColumn("k", k).withColumn("hits", F.greatest(F.lit(1), F.col("k") - (F.col("n") - F.col("need"))))
    each = sizes.select("item_id", "width", "part", "n", "need", "k", "hits", F.posexplode("each").alias("place", "x"))
    return each.select("item_id", "width", "part", "x.s", "x.h", "n", "need", "hits", (F.col("place") < F.col("k")).alias("signed"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, row_hash, item_id, n_shared, n_item, containment): items of which a document holds the threshold's share.

    Items with fewer words than a shingle are one shingle of all their words. Null, empty and wordless texts and items match
    nothing. Rows equal in id and text count once; row_hash tells apart texts that share an id, or have none. Items that
    repeat an id with other texts match by the union of their shingles per width. Other columns are ignored; without
    documents or items there are no rows.
    """
    index = cut(index_items(items, item_col, item_text_col, shingle, threshold))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    widths = sorted(r["width"] for r in index.select("width").distinct().collect()) or [shingle]  # at most `shingle` rows
    parts = index.groupBy("width", "part").agg(F.min("need").alias("least"))
    least = {(r["width"], r["part"]): r["least"] for r in parts.collect()}  # a row per power of two and width
    signatures = sized(cut(index.where("signed").select("h", "item_id", "width", "part", "hits")), BROADCAST_ROWS)
    fewest = min(least.values(), default=1)
    marks = rows.select("row_hash", let(words(F.col("text")), _distinct(hashes, widths)).alias("all")).where(F.size("all") >= fewest)
    met = marks.select("row_hash", F.size("all").alias("held"), F.explode("all").alias("h")).join(signatures, "h")
    if least:  # each partition needs documents of its own size
        needs = F.create_map(*[x for (w, p), n in least.items() for x in (F.lit(w * 64 + p), F.lit(n))])
        met = met.where(F.col("held") >= F.element_at(needs, F.col("width") * 64 + F.col("part")))
    near = met.select("row_hash", "item_id", "width", "h", "hits").distinct().groupBy("row_hash", "item_id", "width").agg(F.count("*").alias("n"), F.max("hits").alias("hits"))
    near = cut(near.where("n >= hits").select("row_hash", "item_id", "width"))
    texts = rows.join(sized(cut(near.select("row_hash").distinct()), BROADCAST_ROWS), "row_hash", "left_semi")
    each = texts.select("doc_id", "row_hash", F.explode(F.concat(*[F.transform(let(words(F.col("text")), _distinct(shingles, [n])), _tagged(n)) for n in widths])).alias("x")).select("doc_id", "row_hash", "x.width", "x.s")
    pairs = each.join(sized(index.select("width", "s", "item_id", "n", "need"), BROADCAST_ROWS), ["width", "s"]).join(sized(near, BROADCAST_ROWS), ["row_hash", "item_id", "width"], "left_semi")
    pairs = pairs.select("doc_id", "row_hash", "item_id", "width", "s", "n", "need").distinct()
    pairs = pairs.groupBy("doc_id", "row_hash", "item_id", "width").agg(F.count("*").alias("n_shared"), F.max("n").cast("long").alias("n_item"), F.max("need").alias("need"))
    return pairs.where("n_shared >= need").select("doc_id", "row_hash", "item_id", "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def _tagged(n: int):
    return lambda s: F.struct(F.lit(n).alias("width"), s.alias("s"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those that contain an item, with their own columns and names. Null and empty texts stay; rows that repeat
    id and text go or stay together; without items all rows stay, and an empty table gives no rows."""
    gone = cut(contained(docs, items, id_col, text_col, item_col, item_text_col, shingle, threshold).select(F.col("row_hash").alias("__gone_row")).distinct())
    return docs.join(sized(gone, BROADCAST_ROWS), F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")) == F.col("__gone_row"), "left_anti")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM b WHERE len(ws) >= 5),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, round(count(*) / any_value(n_item), 6) AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n_item) * 0.8 - 1e-9)
"""

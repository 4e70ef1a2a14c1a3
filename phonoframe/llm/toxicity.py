"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over the presence of words is trained in numpy from confirmed toxic texts (P) and unlabelled ones (U), on
the risk  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the class prior pi. A round whose second term is
negative takes its step against that term instead, so it can't be overfitted. The words are those that tell P and U apart
best, by the likelihood ratio of their counts; these are counted on the executors, and only a bit a word and text is sent to
the driver, so the fit is bounded in rows and bytes, and texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import bounded_sample, crc_bucket, cut

POSITIVES, UNLABELLED = 3000, 6000  # texts that the model is fitted on, at most
VOCABULARY = 128  # words that the model knows
LEAST = 3  # texts that must hold a word for it to be known
RIDGE = 0.1  # weight decay; it fades as P grows
PREFIX = 5
WORD = re.compile(r"[^\W\d_]+")


def parts(text: str | None) -> set[str]:
    """The different lower-cased words of a whole text, and the beginnings of long ones, which stand for their other forms."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def word_marks(text: str | None) -> np.ndarray:
    """Sorted hashes of the parts of a text."""
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in parts(text)], np.uint32))


class Model:
    def __init__(self, marks=(), weight=(), bias: float = 0.0) -> None:
        self.table, self.bias = dict(zip(map(int, marks), map(float, weight), strict=True)), bias

    def score(self, text: str | None) -> float:
        get = self.table.get
        g = self.bias + sum(get(zlib.crc32(w.encode("utf-8", "surrogatepass")), 0.0) for w in sorted(parts(text)))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def fit(marks: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 800) -> Model:
    """marks: the hashes of the known words; positive, unlabelled: a row a text, a column a word, 1 where it holds it.
    With nothing to learn from, every score is the prior."""
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    flat = Model(bias=float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled) or not len(marks):
        return flat
    p, u = positive.astype(np.float32), unlabelled.astype(np.float32)
    theta = np.zeros(len(marks) + 1)
    theta[-1] = flat.bias
    speed, square = np.zeros_like(theta), np.zeros_like(theta)
    squash = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    down = lambda x, d: np.append(x.T @ d, d.sum()) / len(x)
    for k in range(1, rounds + 1):
        gp, gu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        by_negative = down(u, squash(gu)) - prior * down(p, squash(gp))
        slope = -by_negative if negative < 0 else prior * down(p, squash(gp) - 1) + by_negative
        slope = slope + RIDGE * prior / len(p) * np.append(theta[:-1], 0)
        speed, square = 0.9 * speed + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta - 0.1 * (speed / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(marks, theta[:-1], float(theta[-1]))


def likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """How much better two shares a / n_a and b / n_b explain the counts than one."""

    def part(k: Column, n: int) -> Column:
        alike = (a + b + 0.5) / (n_a + n_b + 1)
        return F.when(k > 0, k * F.log(k / n / alike)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / n / (1 - alike))).otherwise(0.0)

    return part(a, n_a) + part(b, n_b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: tuple[int, int] | None) -> Model:
    """P: labelled 1; U: any documents; both bounded, and outside the held-out fold. The prior is the labels' share of 1. Of rows
    that share an id the least text counts; an id that is labelled both ways is 1. Without P or U every score is the prior."""
    ident = F.col(id_col).cast("long")
    inside = (crc_bucket(ident, held_out[0]) != held_out[1]) if held_out else ident.isNotNull()
    known = labels.select(ident.alias("__id"), F.col(label_col).cast("int").alias("__y"), inside.alias("__in")).where("__in and __y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = known.agg(F.count("*").alias("n"), F.sum("__y").alias("ones")).first()
    some = bounded_sample(known.where("__y = 1").select("__id"), POSITIVES, F.col("__id")).withColumn("toxic", F.lit(True))
    any_ = bounded_sample(docs.where(inside).select(ident.alias("__id")).distinct(), UNLABELLED, F.col("__id")).withColumn("toxic", F.lit(False))
    texts = docs.select(ident.alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = cut(texts.join(F.broadcast(some.union(any_)), "__id").groupBy("__id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    prior = (counts.ones or 0) / counts.n if counts.n else 0.1
    if not n_p or not n_u:
        return fit(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), prior)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                held = [word_marks(t.as_py()) for t in batch.column(0).slice(a, 200)]
                toxic = np.repeat(np.array(batch.column(1).slice(a, 200).to_pylist(), bool), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).astype(np.int64)), pa.array(toxic)], ["mark", "toxic"])

    words = texts.mapInArrow(each, "mark long, toxic boolean").groupBy("mark").agg(F.count(F.when(F.col("toxic"), 1)).alias("a"), F.count(F.when(~F.col("toxic"), 1)).alias("b"))
    best = words.where(F.col("a") + F.col("b") >= LEAST).orderBy(F.desc(F.round(likelihood_ratio(F.col("a"), F.col("b"), n_p, n_u), 9)), "mark").limit(VOCABULARY)
    marks = np.sort(np.array([r.mark for r in best.select("mark").collect()], np.uint32))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(np.isin(marks, word_marks(t.as_py()), assume_unique=True)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "toxic"])

    got = sorted((r.toxic, bytes(r.x)) for r in texts.mapInArrow(bits, "x binary, toxic boolean").collect())  # a bit a word and sampled text
    held = {t: np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=len(marks)) for y, x in got if y is t], np.uint8).reshape(-1, len(marks)) for t in (True, False)}
    return fit(marks, held[True], held[False], prior)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] | None = (5, 0), threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per input row. Null and empty texts get the score of no words; repeated
    rows score alike; null ids are never held out; labels of absent documents and null labels count for nothing. Without
    labels every score is 0.1, without toxic ones 0.001; an empty table gives no rows; other columns are ignored; very long
    texts are read whole."""
    model = train(docs, labels, id_col, text_col, label_col, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(crc_bucket(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)) if held_out else F.lit(False)
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, and exact reranking.

The centroids and codebooks are fitted on a bounded sample; every vector is coded and filed under its nearest centroid. A
query visits its nearest lists and ranks their members by an asymmetric distance table alone: with c the list's centroid and
r the coded residual, |q - c - r|^2 = |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r, where the middle term is stored with each code and
the last one is looked up in one table a query. Only the RERANK best of each query over all its lists are compared exactly.

Lists are packed into cells of at most CELL codes, near lists together; a list that is larger is dealt to several cells. A
task holds the codes of one cell and streams the queries that visit it, so its memory doesn't grow with the table, and a
query gets a bounded number of rows from each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import bounded_sample, cut

SAMPLE = 16_384  # vectors that the centroids and codebooks are fitted on, at most
CELLS, CELL = 16, 262_144  # cells at least, where there are so many lists; codes of a cell at most
RECALL = 0.97  # share of the nearest that the number of visited lists aims at, by the sample
KEPT = 32  # codes that a cell returns to a query
RERANK = 128  # codes of each query that are reranked exactly


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    unique = np.unique(x, axis=0)
    centre = unique[rng.permutation(len(unique))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(centre)) for j in range(x.shape[1])], axis=1)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    return (x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None]


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], centre).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids and codebooks; at most a quarter as many centroids as sampled vectors, ordered along their widest axis."""

    def __init__(self, sample: np.ndarray, total: int, lists: int | None, parts: int | None, seed: int = 5) -> None:
        lists = lists or max(1, min(len(sample) // 4, int(2 * math.sqrt(total))))
        centre = kmeans(sample, lists, 8, seed)
        axis = np.linalg.svd(centre - centre.mean(0), full_matrices=False)[2][0]
        self.centre = centre[np.argsort(centre @ axis, kind="stable")]
        dim = sample.shape[1]
        self.edges = np.linspace(0, dim, min(dim, parts or max(1, dim // 2)) + 1).astype(int)
        rest = sample - self.centre[nearest(sample, self.centre)]
        self.books = [kmeans(rest[:, a:b], min(256, max(1, len(rest) // 8)), 6, seed + a) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def probes(self, sample: np.ndarray, k: int, recall: float = RECALL, queries: int = 256) -> int:
        """Lists to visit for the wanted share of the k nearest, found on the sample, whose neighbours lie farther than those in all rows."""
        some, home = sample[:: max(1, len(sample) // queries)], nearest(sample, self.centre)
        near = np.argsort(distances(some, sample), axis=1, kind="stable")[:, 1 : k + 1]
        place = np.argsort(np.argsort(distances(some, self.centre), axis=1, kind="stable"), axis=1)
        ranks = np.take_along_axis(place, home[near], axis=1).ravel()
        return int(np.quantile(ranks, recall)) + 1 if len(ranks) else len(self.centre)

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes uint8, the part of the distance that doesn't depend on the query)."""
        rest, base = x - self.centre[home], self.centre[home]
        codes, fixed = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for j, book in enumerate(self.books):
            a, b = self.edges[j], self.edges[j + 1]
            codes[:, j] = nearest(rest[:, a:b], book)
            r = book[codes[:, j]]
            fixed += (r**2).sum(1) + 2 * (base[:, a:b] * r).sum(1)
        return codes, fixed

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part of a query, -2 q.r of each of its codes."""
        return [(-2 * book @ q[a:b]).astype(np.float32) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)]


def pack(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each list, lists in order."""
    room = max(1, min(CELL, -(-int(sizes.sum()) // CELLS)))
    first, many, cell, used = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes):
        if used and used + n > room:
            cell, used = cell + 1, 0
        first[k] = cell
        if n > room:
            many[k] = -(-int(n) // room)
            cell, used = cell + many[k], 0
        else:
            used += n
    return first, many


class Cell:
    """The codes of a cell, as they come in, and the search in them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ready: tuple[np.ndarray, ...] | None = None

    def add(self, ids: np.ndarray, home: np.ndarray, fixed: np.ndarray, codes: np.ndarray) -> None:
        self.parts.append((ids, home, fixed.astype(np.float32), codes))

    def search(self, index: Index, who: int, q: np.ndarray, lists: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, approximate squared distances) of the nearest codes in the lists, but the query's own; ties to smaller ids."""
        if self.ready is None:
            ids, home, fixed, codes = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, len(index.books)), np.uint8))
            order = np.argsort(ids, kind="stable")
            self.ready, self.parts = (ids[order], home[order], fixed[order], np.ascontiguousarray(codes[order].T)), []
        ids, home, fixed, codes = self.ready
        far = np.full(len(index.centre), np.inf, np.float32)
        far[lists] = ((index.centre[lists] - q) ** 2).sum(1)
        guess = far[home] + fixed
        there = np.nonzero(np.isfinite(guess) & (ids != who))[0]
        guess, some = guess[there], codes[:, there]
        for j, t in enumerate(index.table(q)):
            guess += t[some[j]]
        if len(guess) > keep:
            edge = np.partition(guess, keep - 1)[keep - 1]
            best = np.concatenate((np.nonzero(guess < edge)[0], np.nonzero(guess == edge)[0]))[:keep]
        else:
            best = np.arange(len(guess))
        return ids[there[best]], guess[best]


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v), a row per id; floats stay floats, all other numbers become doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def candidates(valid: DataFrame, k: int, query_every: int, probes: int | None, lists: int | None, parts: int | None, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id): at most `rerank` codes of each query, the nearest by the distance tables. valid: (vec_id, v)."""
    session, total = valid.sparkSession, valid.count()
    sample = np.array([r.v for r in bounded_sample(valid, SAMPLE, F.col("vec_id")).collect()], dtype=float)
    fitted = Index(sample, total, lists, parts)
    visits, kept, wanted = probes or fitted.probes(sample, k), max(KEPT, k), max(rerank, k)
    index = session.sparkContext.broadcast(fitted)  # at most 4096 centroids and 256 codes a part
    coded = "vec_id long, home int, fixed float, code binary"

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                home = nearest(x, index.value.centre)
                codes, fixed = index.value.code(x, home)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(home.astype(np.int32)), pa.array(fixed.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "home", "fixed", "code"])

    filed = cut(valid.mapInArrow(file, coded))
    sizes = np.zeros(len(fitted.centre), np.int64)
    for r in filed.groupBy("home").count().collect():  # a row per list
        sizes[r.home] = r["count"]
    first, many = pack(sizes)
    plan = session.sparkContext.broadcast((sizes, first, many))
    places = session.createDataFrame([(k, int(a), int(n)) for k, (a, n) in enumerate(zip(first, many, strict=True))], "home int, first int, many int")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, many = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            order = np.argsort(distances(x, index.value.centre), axis=1, kind="stable")
            rows: list[int] = []
            cells: list[int] = []
            visited: list[np.ndarray] = []
            for k, near in enumerate(order):
                held = np.cumsum(sizes[near])  # lists beyond the usual number, where they hold too few
                near = near[: max(visits, int(np.searchsorted(held, kept + 1)) + 1)]
                near = near[sizes[near] > 0]
                spread = np.concatenate([np.arange(first[h], first[h] + many[h]) for h in near]) if len(near) else np.zeros(0, np.int64)
                owner = np.repeat(near, many[near])
                for c in np.unique(spread):
                    rows.append(k)
                    cells.append(int(c))
                    visited.append(owner[spread == c].astype(np.int32))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(visited, pa.list_(pa.int32()))], ["cell", "vec_id", "q", "lists"])

    kind = valid.schema["v"].dataType.simpleString()
    members = filed.join(F.broadcast(places), "home").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("cell"), F.lit(0).alias("turn"), "vec_id", "home", "fixed", "code", F.lit(None).cast(kind).alias("q"), F.lit(None).cast("array<int>").alias("lists"))
    asked = valid.where(F.col("vec_id") % query_every == 0).mapInArrow(visit, f"cell int, vec_id long, q {kind}, lists array<int>")
    asked = asked.select("cell", F.lit(1).alias("turn"), "vec_id", F.lit(0).alias("home"), F.lit(0.0).cast("float").alias("fixed"), F.lit(None).cast("binary").alias("code"), "q", "lists")
    dealt = members.union(asked).repartition(int((first + many).max()), "cell").sortWithinPartitions("cell", "turn")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell()
        for b in batches:
            cells, turns = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.nonzero((np.diff(cells) != 0) | (np.diff(turns) != 0))[0] + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if z <= a:
                    continue
                if cells[a] != at:
                    at, cell = cells[a], Cell()
                part = b.slice(a, z - a)
                if turns[a] == 0:
                    codes = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(len(part), -1)
                    cell.add(part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(), codes)
                    continue
                found = [cell.search(index.value, who, np.asarray(q, float), np.asarray(lists), kept) for who, q, lists in zip(part.column(2).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(2).to_numpy(), n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.float32))], ["query_id", "vec_id", "guess"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, guess float")
    order = Window.partitionBy("query_id").orderBy("guess", "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("query_id", "vec_id")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_every: int = 100, probes: int | None = None, lists: int | None = None, parts: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by query_every.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; a query is no candidate of its own.
    Null, empty and zero vectors, those with null or non-finite components, and null ids take no part, nor do vectors of
    another length than the commonest (the shorter one at a tie). Rows that repeat an id count once, with the least vector.
    A table without a valid vector gives no rows; other columns are ignored.
    """
    valid = valid_vectors(vectors, id_col, vector_col)
    width = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return valid.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0D as score")
    valid = cut(valid.where(F.size("v") == width.n).groupBy("vec_id").agg(F.min("v").alias("v")))
    pairs = candidates(valid, k, query_every, probes, lists, parts, rerank)
    asked = valid.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = pairs.join(asked, "query_id").join(valid, "vec_id")
    square = F.aggregate(F.zip_with("v", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    exact = both.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)

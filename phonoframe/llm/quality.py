"""Document quality from a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are character-class shares, word length, size and repetition of words and lines, with those of both
neighbours. A line of a training text takes the text's label. A document's quality is the length-weighted mean of its
lines' forward-backward marginals, calibrated on the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import bounded_sample, crc_bucket, free_name, tidy

TRAIN_ROWS = 6000  # labelled documents that the model is fitted on, at most
CHUNK_LINES = 64  # a training text is cut into sequences of so many lines
TRAIN_CHUNKS = 4  # sequences of a text that the model is fitted on, spread evenly; scores always read whole texts
SLICE_BYTES = 2_000_000  # text that is worked on at once
UPPER, DIGIT, SPACE, BAR, BANG, STOP, SYMBOL = range(1, 8)
CLASS = np.zeros(256, np.uint8)  # letters, and all bytes beyond ASCII, are 0
CLASS[65:91] = UPPER
CLASS[48:58] = DIGIT
CLASS[[9, 11, 12, 13, 32]] = SPACE
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = SYMBOL
CLASS[[ord(c) for c in ".,;:'\"()?-"]] = STOP
CLASS[ord("|")], CLASS[ord("!")] = BAR, BANG
OWN = 11  # features of a line itself
WIDTH = 3 * OWN + 2


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes that begins at one of the starts; zero bytes don't count."""
    sizes = np.diff(np.append(starts, len(data)))
    place = (np.arange(starts[0], len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(data[starts[0] :].astype(np.uint64) * mixed, starts - starts[0])


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, lines of each text, bytes of each line plus one). An empty text is one empty line."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.nonzero(data == 10)[0]
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    lines = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends - 1) + 1)))
    kind = CLASS[data]
    share = {k: np.add.reduceat((kind == k).astype(np.int32), starts) for k in (UPPER, DIGIT, SPACE, BAR, BANG, STOP, SYMBOL)}
    n = np.maximum(size, 1)
    marks = _hashes(data, starts)
    owner = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((np.arange(len(marks)), marks, owner))
    again = np.zeros(len(marks), bool)
    again[order[1:]] = (marks[order[1:]] == marks[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]) & (size[order[1:]] > 0)
    words = share[SPACE] + 1.0
    gap = (kind == SPACE) | (data == 10)
    heads = np.nonzero(~gap & np.concatenate(([True], gap[:-1])))[0]
    echo = np.zeros(len(starts))
    if len(heads):
        spoken, line = _hashes(np.where(gap, np.uint8(0), data), heads), np.searchsorted(ends, heads)
        same = (spoken[1:] == spoken[:-1]) & (line[1:] == line[:-1])
        echo = np.bincount(line[1:][same], minlength=len(starts)) / words
    own = np.column_stack([
        share[UPPER] / n, share[DIGIT] / n * 3, np.minimum(share[BAR] / n * 20, 2), np.minimum(share[BANG] / n * 20, 2), np.minimum(share[STOP] / n * 10, 3),
        np.minimum(share[SYMBOL] / n * 10, 3), np.minimum(size / words, 30) / 10, np.log1p(size) / 5, again, size == 0, np.minimum(echo * 3, 2),
    ])
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[np.cumsum(lines) - 1] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[:, 1] = 1, 1
    return np.hstack([own, before, after, edge]), lines, size + 1


def marginals(gain: np.ndarray, lines: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected 2x2 counts of steps. gain: a line's score for good over bad; steps: 2x2 scores."""
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    active = np.searchsorted(-lines[order], -np.arange(lines.max()) - 0.5, side="left") if len(lines) else np.zeros(0, int)
    emit = np.exp(np.column_stack([np.minimum(-gain, 0), np.minimum(gain, 0)]))
    move = np.exp(steps - steps.max())
    forward, back = np.empty_like(emit), np.ones_like(emit)
    for t, n in enumerate(active):
        at = first[:n] + t
        now = emit[at] * (forward[at - 1] @ move if t else 1.0)
        forward[at] = now / now.sum(1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        now = (emit[at + 1] * back[at + 1]) @ move.T
        back[at] = now / now.sum(1, keepdims=True)
    both = forward * back
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(gain), bool)
    inner[np.cumsum(lines) - 1] = False
    at = np.nonzero(inner)[0]
    pair = forward[at][:, :, None] * move[None] * (emit[at + 1] * back[at + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return both[:, 1], pair.sum(0)


class Model:
    def __init__(self) -> None:
        self.weight, self.steps, self.slope, self.shift = np.zeros(WIDTH), np.zeros((2, 2)), 1.0, 0.0

    def raw(self, features: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
        good, _ = marginals(features @ self.weight, lines, self.steps)
        first = np.cumsum(lines) - lines
        mean = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
        return np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))

    def score(self, features: np.ndarray, lines: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(features, lines, size) + self.shift)))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150) -> Model:
    """samples: (features, sizes, label) of a text each. With one label only, or none, every score is that share."""
    model = Model()
    labels = np.array([s[2] for s in samples], float)
    if len(set(labels)) < 2:
        model.slope, model.shift = 0.0, float(np.clip((labels.mean() if len(labels) else 0.5) * 12 - 6, -6, 6))
        return model
    cuts = [(x[a : a + CHUNK_LINES], y) for x, _, y in samples for a in range(0, len(x), CHUNK_LINES)]
    features = np.vstack([c[0] for c in cuts])
    lines = np.array([len(c[0]) for c in cuts])
    truth = np.repeat([c[1] for c in cuts], lines).astype(float)
    seen = np.zeros((2, 2))
    for c, n in zip(cuts, lines, strict=True):
        seen[c[1], c[1]] += n - 1
    theta = np.zeros(WIDTH + 4)
    speed, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, expected = marginals(features @ theta[:WIDTH], lines, theta[WIDTH:].reshape(2, 2))
        slope = np.concatenate([features.T @ (truth - good), (seen - expected).ravel()]) / len(truth) - 1e-4 * theta
        speed, square = 0.9 * speed + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta += 0.15 * (speed / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    model.weight, model.steps = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    x = model.raw(np.vstack([s[0] for s in samples]), np.array([len(s[0]) for s in samples]), np.concatenate([s[1] for s in samples]))
    at = np.array([0.2, 0.0])
    for _ in range(50):  # Newton steps of the calibration, with a weak prior
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w, z = p * (1 - p) + 1e-9, np.column_stack([x, np.ones_like(x)])
        at = at + np.linalg.solve(z.T @ (z * w[:, None]) + 0.1 * np.eye(2), z.T @ (labels - p) - 0.1 * (at - [0.2, 0.0]))
    model.slope, model.shift = max(float(at[0]), 1e-3), float(at[1])
    return model


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for k, cell in enumerate(batch.column(column)):
        text = cell.as_buffer().to_pybytes() if cell.is_valid else b""
        if held and size + len(text) > SLICE_BYTES:
            yield start, held
            start, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def _spread(lines: int) -> np.ndarray:
    """Places of the lines that a training text gives."""
    chunks = -(-lines // CHUNK_LINES)
    picked = np.unique(np.linspace(0, chunks - 1, min(chunks, TRAIN_CHUNKS)).round().astype(int))
    return np.concatenate([np.arange(c * CHUNK_LINES, min(lines, (c + 1) * CHUNK_LINES)) for c in picked])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: tuple[int, int] | None, rows: int = TRAIN_ROWS) -> Model:
    """Fitted on at most `rows` labelled documents whose id is outside the held-out fold, and on TRAIN_CHUNKS * CHUNK_LINES
    lines of each, so what the driver gets is bounded in rows and bytes. Null labels, ids and texts are left out; an id that
    is labelled both ways is 0; of rows that share an id the least text counts."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    if held_out:
        known = known.where(crc_bucket(F.col("__id"), held_out[0]) != held_out[1])
    known = bounded_sample(known.groupBy("__id").agg(F.min("__y").alias("__y")), rows, F.col("__id"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "__id").groupBy("__id", "__y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _slices(batch, 0):
                x, lines, size = line_features(some)
                rows = np.hstack([x, size[:, None]]).astype(np.float32)
                held = [part[_spread(len(part))].tobytes() for part in np.split(rows, np.cumsum(lines)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column(1).slice(start, len(some))], ["x", "y"])

    got = texts.select("text", "__y").mapInArrow(tidy(run), "x binary, y int").collect()
    parts = [(np.frombuffer(r.x, np.float32).reshape(-1, WIDTH + 1).astype(float), r.y) for r in sorted(got, key=lambda r: (bytes(r.x), r.y))]
    return fit([(x[:, :-1], x[:, -1], y) for x, y in parts])


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score, 0 to 1. Null and empty texts are scored as one empty line; all columns are kept."""
    position = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(*line_features(some)) for _, some in _slices(batch, position)]
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, score_col])

    return docs.mapInArrow(tidy(run), f"{schema}, `{score_col}` double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] | None = (4, 2), threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted): a row per input row; ties and repeated rows score alike, null ids are never held out.

    held_out (m, r): rows with crc32(id as text) mod m = r are kept from the training. No labels: every score is a half; one
    label only: every score is near it. Null and empty texts are one empty line; a long text of one line is one line; an empty
    table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, held_out)
    rows = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    out = F.coalesce(crc_bucket(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)) if held_out else F.lit(False)
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] | None = (4, 2), threshold: float = 0.7) -> DataFrame:
    """docs whose score reaches the threshold, with their own columns and names. Null and empty texts are scored as one empty
    line; repeated rows go or stay together; without labels every score is a half, so none stays at the usual threshold; an
    empty table gives no rows."""
    model, name = train(docs, labels, id_col, text_col, label_col, held_out), free_name(docs, "__score")
    return scored(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)

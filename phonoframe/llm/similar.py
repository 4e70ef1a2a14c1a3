"""Texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, as components.

Pairs to look at come from the fingerprints' links and from the bands of a MinHash signature: two sets share one of BANDS
bands of ROWS least hashes with a chance of 1 - (1 - J^ROWS)^BANDS, so a pair at 0.8 is missed with one of 1e-7, and one that
is no more alike than a shared passage makes it seldom meets. Every pair is verified on the whole sets, which are made again
for the texts of such pairs alone. Every band has a leader; a set is first compared with one leader of each of
LEADERS parts of its bands, the one that shares most bands with others, so a large group makes no more pairs than its sets. Then all
pairs of a band, and of a bucket of linked fingerprints, whose sets are in different components yet are looked at: a component's own
pairs can't change it, so this is as complete as verifying every pair. Parity sketches, which stand in the buckets' rows, tell most
pairs that are too unlike, without error, before a pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import cut, cut_sized, sized, tidy
from phonoframe.llm.graph import connected_components

SEED = 42
FIFTHS = 4  # least similarity: 4/5
BANDS, ROWS = 40, 5
LEADERS = 1  # more of them find little more, and each makes a pair of whole sets for every set
SKETCH = 512, 4096  # fewest and most bits of a parity sketch: two sets differ in as many members at least as their sketches in bits
BLOCK = 1024  # rows of one bucket beyond which its pairs are looked at block by block
FEW = 128  # possible pairs that a set gives in one block; with more, the nearest first, since components that join need no others
ROUNDS = 8  # of such pairs; then all that are left
DRIVER_EDGES = 200_000  # edges up to which the driver joins the components
BROADCAST_ROWS = 200_000  # rows of two longs up to which a side is broadcast
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; texts with fewer words than a shingle have one, and wordless and null texts
    have none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(first, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def name_of(held: np.ndarray) -> int:
    """A signed hash of a sorted set."""
    import xxhash

    value = xxhash.xxh64_intdigest(held.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def bands(held: np.ndarray) -> np.ndarray:
    """The bands of a set's signature, each hashed with its number; of an empty set, of nothing."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(held), 2048):  # bounded memory for very long texts
        np.minimum(least, ((held[a : a + 2048, None] ^ _FLIP) * _TIMES).min(0), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(31))) * _MIX[0]).view(np.int64)


def sketch(held: np.ndarray) -> np.ndarray:
    """Bits of a set: whether the number of its members under each is odd. Twice as many bits as members, or the next power of 2, within
    SKETCH; a sketch of half the size is one half XOR the other."""
    size = min(max(SKETCH[0], 1 << (2 * len(held) - 1).bit_length()), SKETCH[1]) if len(held) else SKETCH[0]
    odd = np.bincount((held % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(sketches: pa.ListArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each sketch, and by their number sketches of so many words; rows that have fewer are empty there."""
    flat, words = sketches.flatten().to_numpy().view(np.uint64), sketches.value_lengths().to_numpy().astype(np.int64)
    starts = np.cumsum(words) - words
    out: dict[int, np.ndarray] = {}
    for size in sorted(np.unique(words).tolist(), reverse=True):
        rows = np.zeros((len(words), size), np.uint64)
        if out:
            wide = out[min(out)]
            while wide.shape[1] > size:
                wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
            rows |= wide
        own = np.nonzero(words == size)[0]
        rows[own] = flat[starts[own, None] + np.arange(size)]
        out[size] = rows
    return words, out


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, fingerprint) -> DataFrame:
    """(key, doc_id, s, n, fp, bands, sketch): a row per input row. key: a hash of id and text; s: one of the shingle set; n: its
    size; fp: what `fingerprint` makes of all shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                s, n, fp, rows, odd = [], [], [], [], []
                for t in part.column(2):
                    values = shingle_hashes(t.as_py(), shingle)
                    held = np.unique(values)
                    s.append(name_of(held))
                    n.append(len(held))
                    fp.append(fingerprint(values))
                    rows.append(bands(held).tobytes())
                    odd.append(sketch(held))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(rows, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], ["key", "doc_id", "s", "n", "fp", "bands", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(run), "key long, doc_id long, s long, n int, fp long, bands binary, sketch array<long>")


def _band_rows(one: DataFrame) -> DataFrame:
    """(band, s, n): a row per set and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))], ["band", "s", "n"])

    return one.select("s", "n", "bands").mapInArrow(tidy(run), "band long, s long, n int")


def alike(a: Column, b: Column) -> Column:
    """Whether two sets, as arrays, are similar enough; both may be empty."""
    both = F.size(F.array_intersect(a, b))
    return both * 5 >= FIFTHS * (F.size(a) + F.size(b) - both)


class Verifier:
    """Verifies pairs of sets on the sets themselves, made again from the texts."""

    def __init__(self, docs: DataFrame, names: DataFrame, id_col: str, text_col: str, shingle: int) -> None:
        """names: (key, s), one row of each set."""
        self.rows, self.names, self.shingle = _rows(docs, id_col, text_col), names, shingle

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(src, dst): those of the pairs (src, dst) of names that are similar enough."""
        shingle = self.shingle
        pairs = cut_sized(pairs)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *sets]))], ["s", "h"])

        asked = cut(pairs.select(F.explode(F.array("src", "dst")).alias("s")).distinct().join(self.names, "s").select("key", "s"))
        held = self.rows.join(sized(asked, BROADCAST_ROWS), "key").dropDuplicates(["s"]).select("s", "text").mapInArrow(tidy(make), "s long, h array<long>")
        held = cut_sized(held)
        both = pairs.join(held.select(F.col("s").alias("src"), F.col("h").alias("ha")), "src").join(held.select(F.col("s").alias("dst"), F.col("h").alias("hb")), "dst")
        return cut_sized(both.where(alike(F.col("ha"), F.col("hb"))).select("src", "dst"))


def fits(n: Column, m: Column) -> Column:
    return (n * 5 >= m * FIFTHS) & (m * 5 >= n * FIFTHS)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(F.col(a), F.col(b)).alias("src"), F.greatest(F.col(a), F.col(b)).alias("dst")]


def _apart(few: int | None):
    """Possible pairs of rows (bucket, i, j, side, probe, s, c, n, sketch), sorted by bucket, i, j and side, that share bucket, i and j:
    of different components c, not both probes, and not too unlike; never without such that are similar enough, as sets of n and m
    members at 4/5 differ in (n + m) / 9 members at most. A row gives its `few` nearest, and more says whether it has others."""

    def pairs(done: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j, side, probe, s, c, n = (done.column(k).to_numpy() for k in range(8))
        words, odd = _folded(done.column(8).combine_chunks())
        change = np.ones(len(s), bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts, n = np.nonzero(change)[0], n.astype(np.int64)
        run, end = np.cumsum(change) - 1, np.append(starts[1:], len(s))
        whole = i == j
        first = np.where(whole, np.arange(len(s)) + 1, (end - np.add.reduceat(side, starts))[run])
        load = np.where(side == 0, end[run] - first, 0)
        total = np.cumsum(load)
        for some in np.split(np.arange(len(s)), np.searchsorted(total, np.arange(500_000, total[-1], 500_000))):
            each = load[some]
            one = np.repeat(some, each)
            two = first[one] + np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each)
            fit = (c[one] != c[two]) & ((probe[one] == 0) | (probe[two] == 0)) & fits(n[one], n[two])
            one, two = one[fit], two[fit]
            differ, least = np.zeros(len(one), np.int64), np.minimum(words[one], words[two])
            for size, marks in odd.items():
                like = np.nonzero(least == size)[0]
                for part in np.array_split(like, len(like) * size // 4_000_000 + 1):  # bounded memory
                    differ[part] = np.bitwise_count(marks[one[part]] ^ marks[two[part]]).sum(1, dtype=np.int64)
            fit = differ * (5 + FIFTHS) <= (n[one] + n[two]) * (5 - FIFTHS)
            one, two, differ = one[fit], two[fit], differ[fit]
            more = np.zeros(len(one), bool)
            if few is not None and len(one):
                order = np.lexsort((differ, one))
                one, two = one[order], two[order]
                begin = np.nonzero(np.append(True, one[1:] != one[:-1]))[0]
                count = np.diff(np.append(begin, len(one)))
                near = np.arange(len(one)) - np.repeat(begin, count) < few
                more = np.repeat(count > few, count)[near]
                one, two = one[near], two[near]
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[one], s[two])), pa.array(np.maximum(s[one], s[two])), pa.array(more)], ["src", "dst", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            at = [[column[0].as_py() for column in (rest[0] if rest else batch).columns[:3]], [column[batch.num_rows - 1].as_py() for column in batch.columns[:3]]] if batch.num_rows else None
            if at is None:
                continue
            if at[0] == at[1]:  # the batch ends within the bucket that rest began with
                rest.append(batch)
                continue
            last = batch.num_rows - 1
            keys = [column.to_numpy() for column in batch.columns[:3]]
            same = np.logical_and.reduce([k == k[last] for k in keys])
            begin = int(np.argmax(same))
            yield from pairs(pa.Table.from_batches([*rest, batch.slice(0, begin)]))
            rest = [batch.slice(begin)]
        if rest:
            yield from pairs(pa.Table.from_batches(rest))

    return run


def crossing(one: DataFrame, found: DataFrame, meets: DataFrame, few: int | None) -> DataFrame:
    """(src, dst, more): the possible pairs of sets of different components that share a bucket, see _apart; some of them repeated.
    found: (node, component); meets: (bucket, s, probe)."""
    rows = meets.join(sized(found, BROADCAST_ROWS), F.col("s") == F.col("node"), "left").select("bucket", "s", "probe", F.coalesce("component", "s").alias("c"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(1 - F.col("probe")).alias("owners"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi and owners > 0")
    mixed = cut_sized(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    held = rows.join(sized(mixed, BROADCAST_ROWS), "bucket").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    held = held.join(one.select("s", "n", "sketch"), "s").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("block") > F.col("other")).cast("int")
    held = held.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "probe", "s", "c", "n", "sketch")
    held = held.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return held.mapInArrow(tidy(_apart(few)), "src long, dst long, more boolean")


def components(one: DataFrame, verify: Verifier, others) -> DataFrame:
    """(node, component) of the sets that are similar to another one. one: (s, n, fp, bands, sketch), a row per set; others: from (s,
    fp, c), c the component after the first round, to more buckets (bucket, s, probe), of which two probes are no pair.
    A set is first compared with LEADERS sets at most, so those pairs grow with the sets and not with a group's square."""
    rows = _band_rows(one)
    shared = cut_sized(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    rows = cut_sized(rows.join(sized(shared, BROADCAST_ROWS), "band"))
    degrees = rows.groupBy("s").agg(F.sum("c").alias("degree"))
    part = F.pmod("band", F.lit(LEADERS))
    # of one half of the parts the set that shares most bands leads, often the text that the others were copied from; of the others one by chance
    rank = F.struct(F.when(part % 2 == 0, F.col("degree")).otherwise(0).alias("degree"), F.xxhash64("s", part).alias("chance"))
    leaders = cut_sized(rows.join(degrees, "s").groupBy("band").agg(F.max_by(F.struct(F.col("s").alias("lead"), F.col("n").alias("m"), rank.alias("rank")), rank).alias("l")).select("band", "l.*"))
    near = rows.join(sized(leaders, BROADCAST_ROWS), "band").where((F.col("s") != F.col("lead")) & fits(F.col("n"), F.col("m")))
    near = near.groupBy("s", part.alias("part")).agg(F.max_by("lead", "rank").alias("lead"))
    tried = cut_sized(near.select(F.col("s").alias("src"), F.col("lead").alias("dst")).select(_pair("src", "dst")).distinct())
    edges = verify(tried)
    found = cut_sized(connected_components(edges, few=DRIVER_EDGES))
    sets = one.join(sized(found, BROADCAST_ROWS), F.col("s") == F.col("node"), "left").select("s", "fp", F.coalesce("component", "s").alias("c"))
    meets = rows.select(F.col("band").alias("bucket"), "s", F.lit(0).alias("probe")).union(one.select(F.xxhash64("fp", F.lit("fp")), "s", F.lit(0))).union(others(sets))
    few: int | None = FEW
    for turn in range(ROUNDS + 1):
        few = None if turn == ROUNDS else few
        met = cut_sized(crossing(one, found, meets, few))
        more = met.agg(F.max("more")).first()[0]
        if more is None:  # no pairs at all
            break
        pairs = cut_sized(met.select("src", "dst").distinct().join(tried, ["src", "dst"], "left_anti"))
        new = verify(pairs)
        if joined := not new.isEmpty():
            edges = edges.union(new)
            found = cut_sized(connected_components(edges, few=DRIVER_EDGES))
        if not more:  # all were verified
            break
        tried = tried.union(pairs)
        few = few if joined else None
    return found

"""SimHash near-duplicates found by the general pigeonhole principle.

A 64-bit fingerprint of each text is the bitwise majority of its shingles' XXH64 hashes. Two fingerprints link when at
most `max_distance` bits differ. Search: correlated bits are grouped into m parts; part i gets a threshold t_i, with
sum(t_i) = max_distance - m + 1; any linked pair is then within t_i bits in some part i. A dynamic programme picks m and
the thresholds from estimated probes and candidates. Every distinct fingerprint is filed under its own value of each part
and probes the smaller values within the threshold; whatever meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm import similar
from phonoframe.llm.common import bounded_sample, cut, cut_sized, free_name, sized, tidy
from phonoframe.llm.graph import connected_components, forest

BITS = 64
SAMPLE = 8192  # distinct fingerprints that the partitioning looks at; it affects speed only, never the links
HOT_ROWS = 16384  # rows of one bucket beyond which it is split into blocks
BROADCAST_KEYS = 50_000  # split buckets up to which their keys are broadcast
BROADCAST_ROWS = 200_000  # rows of two longs up to which a side is broadcast
PROBE_COST, PAIR_COST = 600.0, 1.5  # nanoseconds for a probe row and for a verified pair


def majority(values: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes: the bits that more than half of them have; of none, 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint; null and wordless texts have 0, texts with fewer words than a shingle have one shingle."""
    return majority(similar.shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long): one row per input row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0-63 in `parts` groups of nearly equal size, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).sum(0))
    scale[scale == 0] = 1
    tie = np.abs((bits.T @ bits) / np.outer(scale, scale))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, total: int, max_distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is searched; complete for every pair within max_distance bits."""
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, len(sample), (2, 100_000)) if len(sample) > 1 else np.zeros((2, 1), np.int64)
    apart = sample[one] != sample[two]
    differ = (sample[one] ^ sample[two])[apart]
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, min(max_distance + 1, 12) + 1):
        groups, budget = group_bits(sample, parts), max_distance - parts + 1
        cost = []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            seen = np.bincount(np.bitwise_count(differ & mask), minlength=BITS + 1) / max(1, len(differ))
            row = {-1: 0.0}
            for t in range(min(budget + parts - 1, 4) + 1):
                probes = sum(comb(len(group), j) for j in range(t + 1))
                if probes > 20_000:
                    break
                near = max(seen[: t + 1].sum(), probes / 2.0 ** len(group))
                row[t] = total * (probes * PROBE_COST / 2 + total * near * PAIR_COST / 2)
            cost.append(row)
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            grown: dict[int, tuple[float, list[int]]] = {}
            for spent, (paid, chosen) in plans.items():
                for t, price in row.items():
                    if (s := spent + t) not in grown or paid + price < grown[s][0]:
                        grown[s] = (paid + price, [*chosen, t])
            plans = grown
        if budget in plans and (best is None or plans[budget][0] < best[0]):
            best = (plans[budget][0], [(g, t) for g, t in zip(groups, plans[budget][1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _meet(max_distance: int, kind: str = "forest"):
    """Verifies runs of rows with one bucket; rows come sorted by bucket, and its own fingerprints first. Gives a forest of all pairs
    or, where rows have a label as last column, all "pairs" of different labels, or the "ends" of such pairs alone."""
    labelled = kind != "forest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def fewer() -> tuple[np.ndarray, np.ndarray]:
            one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            return forest(one, two) if kind == "forest" else (ends := np.unique(np.concatenate((one, two))), ends)

        def keep(a: np.ndarray, b: np.ndarray, apart: np.ndarray | None) -> None:
            nonlocal found, held
            near = (np.bitwise_count(a ^ b) <= max_distance) & (a != b)
            if apart is not None:
                near &= apart
            if near.any():
                found.append((a[near].view(np.int64), b[near].view(np.int64)))
                held += len(found[-1][0])
                if held > 500_000 and kind != "pairs":
                    found = [fewer()]
                    held = len(found[0][0])

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal found, held
            if kind == "pairs" and held > least:
                ends = [np.concatenate(x) for x in zip(*found, strict=True)]
                found, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["src", "dst"])

        def runs(fp: np.ndarray, own: np.ndarray, label: np.ndarray | None, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(np.append(starts, len(fp)))
            owners = np.add.reduceat(own.astype(np.int64), starts)
            for k in np.nonzero((owners > 0) & (sizes > 1) & (owners * sizes > 65_536))[0]:
                rows = fp[starts[k] : starts[k] + sizes[k]]
                step = max(1, 500_000 // len(rows))
                for at in range(0, owners[k], step):
                    part = rows[at : min(at + step, owners[k])]
                    names = None if label is None else label[starts[k] : starts[k] + sizes[k]]
                    keep(np.repeat(part, len(rows)), np.tile(rows, len(part)), None if names is None else (names[at : at + len(part), None] != names).ravel())
                    yield from full(500_000)
            small = np.nonzero((owners > 0) & (sizes > 1) & (owners * sizes <= 65_536))[0]
            load = np.cumsum(owners[small] * sizes[small])
            for some in np.split(small, np.searchsorted(load, np.arange(1_000_000, load[-1], 1_000_000))) if len(small) else ():
                each = (owners * sizes)[some]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                first, wide = np.repeat(starts[some], each), np.repeat(sizes[some], each)
                one, two = first + place // wide, first + place % wide
                keep(fp[one], fp[two], None if label is None else label[one] != label[two])
                yield from full(500_000)

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 2 - labelled)]
            change = np.zeros(batch.num_rows, bool)
            for column in bucket:
                change[1:] |= column[1:] != column[:-1]
            if rest:
                last = rest[-1].slice(rest[-1].num_rows - 1)
                change[0] = any(column[0] != last.column(k)[0].as_py() for k, column in enumerate(bucket))
            cuts = np.nonzero(change)[0]
            if not len(cuts):
                rest.append(batch)
                continue
            done = pa.Table.from_batches([*rest, batch.slice(0, cuts[-1])])
            rest = [batch.slice(cuts[-1])]
            yield from _split(done, labelled, runs)
        if rest:
            yield from _split(pa.Table.from_batches(rest), labelled, runs)
        yield from full(0)
        if found:
            a, b = fewer()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    return run


def _split(done: pa.Table, labelled: bool, runs) -> Iterator[pa.RecordBatch]:
    if not done.num_rows:
        return
    change = np.zeros(done.num_rows, bool)
    change[0] = True
    for k in range(done.num_columns - 2 - labelled):
        column = done.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    label = done.column("label").to_numpy() if labelled else None
    yield from runs(done.column("fp").to_numpy().view(np.uint64), done.column("probe").to_numpy() == 0, label, np.nonzero(change)[0])


def _signed(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _file(part: int, bits: list[int], t: int):
    """The rows of one part: its own value, and the smaller values within t bits as probes."""
    fp, mask = F.col("fp"), F.lit(_signed(bits)).cast("long")
    own = fp.bitwiseAND(mask)
    flips = F.array([F.lit(_signed(some)).cast("long") for n in range(t + 1) for some in combinations(bits, n)])
    keys = F.filter(F.transform(flips, lambda p: fp.bitwiseXOR(p).bitwiseAND(mask)), lambda k: k <= own)
    return F.transform(keys, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key"), (k != own).cast("int").alias("probe")))


def links(marks: DataFrame, max_distance: int) -> DataFrame:
    """(src, dst): edges between distinct fingerprints with the same components as all pairs within max_distance bits.

    Where marks has a column label, one of each fingerprint: all pairs within max_distance bits whose labels differ, some of them repeated."""
    return _search(marks, max_distance, "pairs" if "label" in marks.columns else "forest")[0]


def _search(marks: DataFrame, max_distance: int, kind: str) -> tuple[DataFrame, list[Column]]:
    """What _meet gives, as (src, dst), and the buckets of a fingerprint."""
    names = ["fp"] if kind == "forest" else ["fp", "label"]
    distinct = cut(marks.select(names).distinct())
    total = distinct.count()
    sample = np.array([r.fp for r in bounded_sample(distinct, SAMPLE, F.col("fp")).collect()], np.int64).view(np.uint64)
    if total < 2:
        return distinct.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0), []
    filed = [_file(part, bits, t) for part, (bits, t) in enumerate(allocate(sample, total, max_distance))]
    rows = distinct.select(*names, F.explode(F.concat(*filed)).alias("x")).select("x.part", "x.key", "x.probe", *names)
    hot = cut(rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum(1 - F.col("probe")).alias("owners")).where(f"n > {HOT_ROWS} and owners > 0").select("part", "key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("blocks")))
    n_hot = hot.count()
    cold, found = rows, None
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        cold = rows.join(side, ["part", "key"], "left_anti")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        # a bucket's own rows stand in one row of the grid of blocks, all its rows in one column
        grid = F.concat(
            F.transform(F.when(F.col("probe") == 0, every).otherwise(F.array().cast("array<int>")), lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(0).alias("probe"))),
            F.transform(every, lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(1).alias("probe"))),
        )
        split = rows.join(side, ["part", "key"]).select("part", "key", F.explode(grid).alias("g"), *names).select("part", "key", "g.i", "g.j", "g.probe", *names)
        split = split.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "probe")
        found = split.mapInArrow(tidy(_meet(max_distance, kind)), "src long, dst long")
    cold = cold.select("part", "key", "probe", *names).repartition("part", "key").sortWithinPartitions("part", "key", "probe")
    met = cold.mapInArrow(tidy(_meet(max_distance, kind)), "src long, dst long")
    return met if found is None else met.union(found), filed


def linked_buckets(sets: DataFrame, max_distance: int) -> DataFrame:
    """(bucket, s, probe): the buckets of all sets whose fingerprint has a link to one of another component. sets: (s, fp, c), c the
    component. The search gives such fingerprints only, not their pairs: a group's links grow with its square."""
    label = F.when(F.min("c") == F.max("c"), F.min("c")).otherwise(F.xxhash64("fp", F.lit("mixed")))
    met, filed = _search(sets.groupBy("fp").agg(label.alias("label")), max_distance, "ends")
    if not filed:
        return sets.select(F.col("s").alias("bucket"), "s", F.lit(0).alias("probe")).limit(0)
    ends = cut_sized(met.select(F.col("src").alias("fp")).distinct())
    rows = sets.join(sized(ends, BROADCAST_ROWS), "fp").select("s", F.explode(F.concat(*filed)).alias("x"))
    return rows.select(F.xxhash64("x.part", "x.key").alias("bucket"), "s", "x.probe")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """Fingerprint and class of every document.

    Returns (doc_id, fp, component_id), a row per input row, component_id being the smallest doc_id in the fingerprint's
    component. Null and wordless texts have fingerprint 0 and link like any other; null ids never name a component; a
    repeated row is repeated in the result; other columns are ignored; an empty table gives no rows.
    """
    marks = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = connected_components(links(marks, max_distance))
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = cut(classes.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("label")))
    named = cut(classes.groupBy("label").agg(F.min("least").alias("component_id")))  # stored, so that a large class's rows can be split
    named = cut(classes.join(sized(named, BROADCAST_ROWS), "label").select("fp", "component_id"))
    return marks.join(sized(named, BROADCAST_ROWS), "fp").select("doc_id", "fp", "component_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_distance: int = 8) -> DataFrame:
    """docs without all but one document of each class: the one with the smallest id stays, with all its columns.

    A class is a component of texts whose sets of word shingles have a similarity of 0.8 or more. Pairs are found by fingerprints
    within max_distance bits and, since such pairs often differ in more, by the signatures of `similar`; all of them whose texts are
    in different classes yet are verified. Rows are told apart by id
    and text: rows that repeat both are one; a null id comes after all others. Null and wordless texts are one class, texts
    with fewer words than a shingle are copies only of the same words. An empty table gives no rows.
    """
    name = free_name(docs, "__key")
    held = cut(similar.signed(docs, id_col, text_col, shingle, majority))
    one = cut(held.groupBy("s").agg(F.min(F.struct("key", "n", "fp", "bands", "sketch")).alias("x")).select("s", "x.*"))
    verify = similar.Verifier(docs, one.select("key", "s"), id_col, text_col, shingle)
    linked = similar.components(one, verify, lambda sets: linked_buckets(sets, max_distance))
    classes = held.select("key", "doc_id", "s").join(linked, F.col("s") == F.col("node"), "left").withColumn("class", F.coalesce("component", "s"))
    classes = cut(classes.select("key", "doc_id", "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key"))
    stays = cut(classes.groupBy("class").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("class", F.col("f.key").alias("stay")))
    gone = cut(classes.join(sized(stays, BROADCAST_ROWS), "class").where("key <> stay").select(F.col("key").alias(name)).distinct())
    twice = cut(classes.groupBy("key").count().where("count > 1").select(F.col("key").alias(name)))
    kept = docs.withColumn(name, similar.row_key(id_col, text_col)).join(sized(gone, BROADCAST_ROWS), name, "left_anti")
    twice = sized(twice, BROADCAST_ROWS)
    again = kept.join(twice, name, "left_semi").dropDuplicates([name])
    return kept.join(twice, name, "left_anti").union(again).select([F.col(f"`{c}`") for c in docs.columns])

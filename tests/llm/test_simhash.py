import random

import numpy as np
import pytest

pytest.importorskip("phonoframe.llm")
xxhash = pytest.importorskip("xxhash")
from phonoframe.llm import graph, simhash, similar  # noqa: E402


def plain_fingerprint(text, n):
    """By the definition, bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_by_definition(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "ÀÉ a b c", "A b\x0bC d\x0ce F", "x " * 9, "a b c d", "word " * 70_000]
    texts += [" ".join(rng.choice(["Ab", "cd", "é", "日本", "e."]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp & ((1 << 64) - 1) for r in simhash.fingerprints(rows).collect()}
    assert got == {k: plain_fingerprint(t, 4) for k, t in enumerate(texts)}


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 8)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 3, dtype=np.int64)
    marks = np.unique(np.concatenate([base, *[b ^ np.array([sum(1 << int(k) for k in rng.choice(20, rng.integers(0, 4), replace=False)) for _ in range(60)]) for b in base]]))
    frame = spark.createDataFrame([(int(m),) for m in marks], "fp long")
    got = {r.node: r.component for r in graph.connected_components(simhash.links(frame, 4)).collect()}
    label = {int(m): int(m) for m in marks}
    change = True
    while change:
        change = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4 and label[a] < label[b]:
                    label[b], change = label[a], True
    assert {m: got.get(m, m) for m in label} == label


def test_forests_keep_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    one, two = simhash.forest(a, b)
    assert len(one) < 300

    def groups(x, y):
        label = {}
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            lp, lq = label.get(p, p), label.get(q, q)
            label.setdefault(p, p), label.setdefault(q, q)
            lo, hi = min(lp, lq), max(lp, lq)
            label = {k: lo if v == hi else v for k, v in label.items()}
        return {k: v for k, v in label.items()}

    first, second = groups(a, b), groups(one, two)
    assert {k: v for k, v in first.items() if v != k} == {k: v for k, v in second.items() if v != k}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_copies_with_and_without_broadcasts(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(similar, "BROADCAST_ROWS", limit)
    rng = random.Random(7)
    line = lambda n: [f"w{rng.randint(0, 2000)}" for _ in range(n)]
    rows, want = [], []
    for k in range(12):
        words = line(80)
        rows.append((100 * k + 5, " ".join(words)))
        rows.append((100 * k + 7, " ".join(words).upper()))
        near = list(words)
        near[40] = "zz"  # 5 of 76 shingles differ: 71 / 81 alike
        rows.append((100 * k + 3, " ".join(near)))
        far = list(words)
        for at in (10, 30, 50, 70):
            far[at] = "yy"
        rows.append((100 * k + 1, " ".join(far)))  # 56 / 96 alike
        want += [100 * k + 3, 100 * k + 1]
    rows += [(None, rows[0][1]), (None, "only here"), (None, "only here"), (9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a b c")]
    want += [0, 9000, 9003, 9005]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, `__key` string, s int")
    kept = simhash.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(want)
    assert simhash.drop_copies(docs.limit(0)).count() == 0


def test_bands_miss_nothing_at_the_threshold():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, 10, dtype=np.uint64)))) for _ in range(2))  # 80 of 100 alike
        missed += not (similar.bands(a) == similar.bands(b)).any()
    assert missed == 0
    apart = [similar.bands(np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))) for _ in range(40)]
    assert not any((x == y).any() for k, x in enumerate(apart) for y in apart[:k])


def least_of_components(nodes, near):
    label = {x: x for x in nodes}
    change = True
    while change:
        change = False
        for a in nodes:
            for b in nodes:
                if label[a] < label[b] and near(a, b):
                    label[b], change = label[a], True
    return label


@pytest.mark.parametrize("few", [200_000, 5])
def test_copies_of_a_text_that_is_not_there(spark, monkeypatch, few):
    """Near copies at about 0.8 of each other: leaders, and a forest of fingerprints, leave some of a class apart."""
    monkeypatch.setattr(similar, "FEW", few, raising=False)
    monkeypatch.setattr(similar, "BLOCK", 4, raising=False)
    rng = random.Random(5)
    texts = {}
    for k in range(8):
        base = [f"w{k}_{j}" for j in range(100)]
        for j in range(30):
            words = list(base)
            for at in rng.sample(range(100), 2):
                words[at] = f"x{k}_{rng.randint(0, 9)}"
            at = rng.randint(0, 10)
            texts[100 * k + j] = " ".join(words[at : at + 90])
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(86)} for i, t in texts.items()}
    label = least_of_components(list(texts), lambda a, b: a // 100 == b // 100 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_copies(docs).collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("hot", [16384, 8])
def test_all_links_between_labels(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    marks = sorted({base ^ sum(1 << int(k) for k in rng.choice(16, rng.integers(0, 5), replace=False)) for _ in range(80)})
    frame = spark.createDataFrame([(m, m % 3) for m in marks], "fp long, label long")
    got = {(min(r), max(r)) for r in simhash.links(frame, 4).collect()}
    assert got == {(a, b) for a in marks for b in marks if a < b and a % 3 != b % 3 and (a ^ b).bit_count() <= 4}


def test_sketches_never_turn_away_similar_sets():
    rng = np.random.default_rng(8)
    for n in (1, 9, 90, 900):
        both = rng.integers(0, 2**63, 8 * n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n, dtype=np.uint64)))) for _ in range(2))  # 8 of 10 alike
        assert int(np.bitwise_count((similar.sketch(a) ^ similar.sketch(b)).view(np.uint64)).sum()) * 9 <= len(a) + len(b)


def test_rows_grow_with_a_groups_texts_and_not_its_pairs(spark, monkeypatch):
    """Texts with near fingerprints and shared bands, most of them at less than 0.8 of each other: few pairs become rows."""
    rng = random.Random(6)
    base = [f"w{j}" for j in range(300)]
    texts = {}
    for k in range(200):
        words = list(base)
        for at in rng.sample(range(300), 6):
            words[at] = f"x{k}_{at}"
        texts[k] = " ".join(words)
    for k in (11, 42):  # one class of three
        texts[k] = texts[7].replace("w150", f"y{k}")
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(296)} for i, t in texts.items()}
    label = least_of_components(list(texts), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    made, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **b: (made.append(plain(self, *a, **b)), made[-1])[1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_copies(docs).collect()) == sorted(set(label.values()))
    assert {label[11], label[42]} == {7}
    marks = [simhash.fingerprint(t, 5) for t in texts.values()]
    assert sum((a ^ b).bit_count() <= 8 for k, a in enumerate(marks) for b in marks[:k]) > 2000
    counts = [frame.count() for frame in made if "src" in frame.columns]
    assert counts and max(counts) <= 5 * len(texts)


@pytest.mark.parametrize("few", [None, 2])
def test_possible_pairs_of_a_bucket(monkeypatch, few):
    rng = np.random.default_rng(12)
    common = rng.integers(0, 2**63, 90, dtype=np.uint64)
    monkeypatch.setattr(similar, "SKETCH", (64, 512))
    rows, sets = [], []
    for s in range(300):
        held = np.unique(np.concatenate((common[: rng.integers(50, 91)], rng.integers(0, 2**63, rng.integers(0, 15), dtype=np.uint64))))
        sets.append(held)
        b, i, j = int(rng.integers(0, 3)), 0, 0
        if b == 2:  # two blocks against each other
            j = 1
        rows.append((b, i, j, int(rng.integers(0, 2)) if j else 0, int(rng.integers(0, 2)), s, int(rng.integers(0, 4)), len(held), similar.sketch(held).tolist()))
    rows.sort(key=lambda r: r[:4])
    table = similar.pa.table({k: [r[n] for r in rows] for n, k in enumerate(("bucket", "i", "j", "side", "probe", "s", "c", "n", "sketch"))})
    want = {}
    for a in rows:
        for b in rows:
            if a[:3] == b[:3] and a[6] != b[6] and not (a[4] and b[4]) and similar.fits(a[7], b[7]) and (a[3] < b[3] if a[2] else rows.index(a) < rows.index(b)):
                size = 64 * min(len(a[8]), len(b[8]))
                one, two = (np.bincount((sets[x] % np.uint64(size)).astype(int), minlength=size) % 2 for x in (a[5], b[5]))
                differ = int((one != two).sum())
                both = len(np.intersect1d(sets[a[5]], sets[b[5]]))
                assert 9 * differ <= a[7] + b[7] or 5 * both < 4 * (a[7] + b[7] - both)
                if 9 * differ <= a[7] + b[7]:
                    want.setdefault(a[5], []).append((differ, b[5]))
    assert {len(r[8]) for r in rows} == {2, 4}  # two sizes
    for size in (7, 1000):
        got = {}
        for batch in similar._apart(few)(iter(table.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                got[r["src"], r["dst"]] = r["more"]
        if few is None:
            assert set(got) == {(min(a, b), max(a, b)) for a, near in want.items() for _, b in near} and not any(got.values())
        else:
            assert len(got) == sum(min(few, len(near)) for near in want.values()) and any(got.values())
            dist = {(min(a, b), max(a, b)): (d, sorted(x for x, _ in near)[min(few, len(near)) - 1]) for a, near in want.items() for d, b in near}
            assert all(dist[pair][0] <= dist[pair][1] for pair in got)


def test_small_graphs_are_joined_by_the_driver(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(900, 900), (None, 3)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    rows = [sorted(tuple(r) for r in graph.connected_components(frame, few=few).collect()) for few in (0, 10, 10_000)]
    assert rows[0] == rows[1] == rows[2] and (900, 900) in rows[2]
    assert graph.connected_components(frame.limit(0), few=10).count() == 0

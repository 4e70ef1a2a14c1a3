import math
import random

import pytest

pytest.importorskip("phonoframe.llm")
from phonoframe.llm import decontam  # noqa: E402


def fixture():
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 33, 64, 130, 300])]
    items += [(50, None), (51, ""), (52, "!!!"), (0, line(8)), (53, "one two one two one two one two one two")]
    docs = [(k, line(rng.randint(1, 60))) for k in range(60)]
    docs += [(100 + k, f"{line(30)} {t or ''} {line(10)}") for k, t in items]
    for k, t in items:  # items with some words replaced, near the threshold
        words = (t or "").split(" ")
        for m in (1, 2, 3):
            other = list(words)
            for at in rng.sample(range(len(words)), min(m, len(words))):
                other[at] = "zz"
            docs.append((1000 + 10 * k + m, f"{line(400)} {' '.join(other)}"))
    docs += [(2000, None), (2001, ""), (None, items[9][1]), (109, docs[60 + 9][1]), (7, items[10][1]), (2002, " ".join(t for _, t in items if t))]
    return docs, items


def brute(docs, items, threshold):
    shingles = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    sets = {}
    for i, t in items:
        w = split(t)
        if w:
            sets.setdefault((i, min(5, len(w))), set()).update(shingles(w, min(5, len(w))))
    out = set()
    for d, t in {(d, t) for d, t in docs if t is not None}:
        for (i, n), s in sets.items():
            both = len(shingles(split(t), n) & s)
            if both and both >= math.ceil(len(s) * threshold - 1e-9):
                out.add((d, t, i, both, len(s)))
    return out


@pytest.mark.parametrize("threshold,limit", [(0.8, 500_000), (0.5, 500_000), (0.8, 0), (1.0, 500_000)])
def test_equals_brute_force_with_and_without_broadcasts(spark, monkeypatch, threshold, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    docs, items = fixture()
    rows = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, item_id int, s string")
    tests = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.contained(rows, tests, threshold=threshold).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.n_shared, r.n_item) for r in got) == sorted((d or 0, i, b, n) for d, _, i, b, n in brute(docs, items, threshold))
    assert len(got) > 20


def test_signatures_are_as_the_partition_says(spark):
    _, items = fixture()
    rows = decontam.index_items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5, 0.8).collect()
    by = {}
    for r in rows:
        by.setdefault((r.item_id, r.width), []).append(r)
    assert len({r.part for r in rows}) >= 7
    for each in by.values():
        signed = [r.h for r in each if r.signed]
        top = 2 ** (each[0].part + 1) - 1
        assert 2**each[0].part <= each[0].n <= top
        assert sorted(signed) == sorted(r.h for r in each)[: len(signed)]
        assert len(signed) - (each[0].n - each[0].need) >= each[0].hits >= 1


def test_dropping_keeps_the_rest(spark):
    docs, items = fixture()
    rows = spark.createDataFrame([(i, t, None) for i, t in docs], "doc_id long, text string, row_hash string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    gone = {r[:2] for r in brute(docs, items, 0.8)}
    kept = decontam.drop_contaminated(rows, tests)
    assert kept.columns == rows.columns
    want = [d for d in docs if d not in gone]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want)) and (2000, None) in want
    assert decontam.drop_contaminated(rows, tests.limit(0)).count() == len(docs)
    assert decontam.contained(rows.limit(0), tests).count() == 0 and decontam.drop_contaminated(rows.limit(0), tests).count() == 0

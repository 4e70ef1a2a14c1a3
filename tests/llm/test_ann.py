import numpy as np
import pytest

pytest.importorskip("phonoframe.llm")
from phonoframe.llm import ann  # noqa: E402


def exact(ids, x, who, k):
    d = np.sqrt(((x - x[ids == who][0]) ** 2).sum(1))
    d[ids == who] = np.inf
    top = np.lexsort((ids, d))[:k]
    return ids[top], d[top]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_recall_and_few_exact_comparisons(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 32)) + 2 * rng.normal(size=(200, 32)).repeat(100, axis=0)
    ids = rng.permutation(20_000)
    place = {int(i): k for k, i in enumerate(ids)}
    rows = frame(spark, ids, x).cache()
    got = ann.neighbours(rows, query_every=400).toPandas()
    hits = 0
    for who, g in got.groupby("query_id"):
        near, d = exact(ids, x, who, 10)
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and (np.diff(g.score) >= 0).all()
        assert np.allclose(g.score, np.sqrt(((x[[place[i] for i in g.vec_id]] - x[place[who]]) ** 2).sum(1)))
        hits += len(set(g.vec_id) & set(near))
    assert got.query_id.nunique() == 50 and hits >= 0.9 * 500
    compared = ann.candidates(ann.valid_vectors(rows, "vec_id", "embedding"), 10, 400, None, None, None).groupBy("query_id").count().toPandas()["count"]
    assert compared.max() <= ann.RERANK < 20_000 / 10  # the tables discard the others of all visited lists
    few = ann.neighbours(rows, query_every=400, rerank=10).toPandas()
    assert len(few) == 500  # and they decide: the ten best codes alone are another answer
    assert set(zip(few.query_id, few.vec_id, strict=True)) != set(zip(got.query_id, got.vec_id, strict=True))


def test_distance_tables_rank_as_decoded_residuals():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    index = ann.Index(x, 500, 6, 4)
    home = ann.nearest(x, index.centre)
    codes, fixed = index.code(x, home)
    decoded = index.centre[home] + np.concatenate([book[codes[:, j]] for j, book in enumerate(index.books)], axis=1)
    cell = ann.Cell()
    for a in range(0, 500, 100):
        cell.add(np.arange(a, a + 100), home[a : a + 100].astype(np.int32), fixed[a : a + 100], codes[a : a + 100])
    found, guess = cell.search(index, 7, x[7], np.arange(6), 20)
    d = ((decoded - x[7]) ** 2).sum(1)
    d[7] = np.inf
    assert np.allclose(sorted(guess), np.sort(d)[:20], atol=1e-4)
    assert 7 not in found


def test_large_lists_are_dealt_to_several_cells(monkeypatch):
    monkeypatch.setattr(ann, "CELLS", 4)
    first, many = ann.pack(np.array([10, 2, 300, 5, 0, 83]))
    assert list(many) == [1, 1, 3, 1, 1, 1] and list(first) == [0, 0, 1, 4, 4, 4]


def test_repeated_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    same = [(k, [1.0, 2.0, 3.0]) for k in range(0, 600, 2)]  # one vector holds a half of the rows
    rest = [(k, [float(c) for c in rng.normal(size=3)]) for k in range(1, 600, 2)]
    odd = [(700, None), (800, []), (900, [0.0, 0.0, 0.0]), (1000, [1.0, None, 2.0]), (1100, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1200, [1.0, 2.0]), (100, [1.0, 2.0, 4.0])]
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in same + rest + odd], "vec_id long, embedding array<double>, cell int, home string")
    got = ann.neighbours(rows).toPandas()
    assert sorted(got.query_id.unique()) == [0, 100, 200, 300, 400, 500]
    for who, g in got.groupby("query_id"):
        want = [k for k in range(0, 600, 2) if k != who][:10]  # ties go to the smaller id; 100 counts once, with its least vector
        assert list(g.sort_values("rank").vec_id) == want and (g.score == 0).all()
    assert ann.neighbours(rows.limit(0)).count() == 0
    assert ann.neighbours(rows.where("vec_id = 100")).count() == 0
    few = ann.neighbours(rows.where("vec_id in (100, 101, 102)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(100, 1, 102), (100, 2, 101)]


def test_float_vectors_score_in_double(spark):
    rows = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.1])], "vec_id long, embedding array<float>")
    got = ann.neighbours(rows).first()
    a, b = np.array([0.1, 0.2], np.float32).astype(float), np.array([0.3, 0.1], np.float32).astype(float)
    assert abs(got.score - np.sqrt(((a - b) ** 2).sum())) < 1e-15

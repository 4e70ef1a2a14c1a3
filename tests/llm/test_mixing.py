import numpy as np
import pytest

pytest.importorskip("phonoframe.llm")
from phonoframe.llm import mixing  # noqa: E402


def tables(spark):
    rng = np.random.default_rng(1)
    rows = [(k, ("rude " if k % 4 == 0 else "calm ") * int(rng.integers(1, 4)) + "filler " * int(rng.integers(1, 30)) + f"w{k}") for k in range(160)]
    rows += [(500, None), (501, ""), (None, "calm words"), (7, rows[7][1]), (8, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row_hash string, rate int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(3, None), (None, 1), (9999, 0)], "doc_id long, toxic int")
    return docs, labels


def descent(tokens, p, targets, rounds):
    """Projected gradient descent by dense matrices, as the module's text states it."""
    a = tokens[:, None] * p
    n = a.sum(0)
    aim = n.sum() * targets / targets.sum()
    r = np.ones(len(tokens))
    for _ in range(rounds):
        now = r @ a
        if np.abs(now - aim).max() <= mixing.CLOSE * n.sum():
            break
        r = np.maximum(0, r - p @ ((now - aim) / n))
    return r


@pytest.mark.parametrize("share", [0.02, 0.3, 0.6])
def test_rates_equal_dense_descent(spark, share):
    docs, labels = tables(spark)
    got = mixing.rates(docs, labels, {0: 1 - share, 1: share}).toPandas()
    p = got[["p_0", "p_1"]].to_numpy()
    want = descent(got.n_tokens.to_numpy(float), p, np.array([1 - share, share]), mixing.ROUNDS)
    assert len(got) == 165 and np.allclose(p.sum(1), 1) and np.allclose(got.rate, want, atol=1e-9)
    total = (got.rate.to_numpy() * got.n_tokens.to_numpy())[:, None] * p
    assert abs(total.sum(0)[1] / total.sum() - share) < 1e-3


@pytest.mark.parametrize("limit", [200_000, 0])
def test_mix_gives_whole_parts_and_one_chance_a_row(spark, monkeypatch, limit):
    docs, labels = tables(spark)
    rates = {(r.doc_id, r.row_hash): r.rate for r in mixing.rates(docs, labels, {0: 0.4, 1: 0.6}).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    mixed = mixing.mix(docs, labels, {0: 0.4, 1: 0.6})
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    by_id = {i: rate for (i, _), rate in rates.items() if i not in (7, 8)}
    for (i, t), n in counts.items():
        if i in by_id:
            assert int(by_id[i]) <= n <= int(by_id[i]) + 1
    assert max(counts.values()) >= 2 and all(i in {k for k, _ in counts} for i, r in by_id.items() if r >= 1)
    assert sorted((i or 0, t or "", n) for (i, t), n in counts.items()) == sorted((r.doc_id or 0, r.text or "", r["count"]) for r in mixing.mix(docs, labels, {0: 0.4, 1: 0.6}).groupBy("doc_id", "text").count().collect())


def test_no_labels_and_empty_tables(spark):
    docs, labels = tables(spark)
    assert {r.rate for r in mixing.rates(docs, labels.limit(0), {0: 0.9, 1: 0.1}).collect()} == {1.0}
    assert mixing.mix(docs, labels.limit(0), {0: 0.9, 1: 0.1}).count() == 165
    assert mixing.rates(docs.limit(0), labels, {0: 0.9, 1: 0.1}).count() == 0 and mixing.mix(docs.limit(0), labels, {0: 0.9, 1: 0.1}).count() == 0
    one = mixing.rates(docs, labels.where("toxic = 0"), {0: 0.9, 1: 0.1}).toPandas()  # one domain, and a target without a domain
    assert np.allclose(one.rate, 1)

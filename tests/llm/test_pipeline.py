import random
import zlib

import numpy as np
import pytest

pytest.importorskip("phonoframe.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def tables(folder, spark):
    """Documents with good and bad lines, copies, a benchmark passage, toxic words and odd rows."""
    rng = random.Random(11)
    words = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "r", "sh", "v") for c in ("a", "ed", "ing", "o", "ul")]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(9, 14))).capitalize() + "."
    good = lambda n: "\n".join(line() for _ in range(n))
    bad = lambda: "\n".join(["BUY!!! NOW!!! $$$ %%% |||"] * rng.randint(3, 6))
    rows = [(k, good(5)) for k in range(160)] + [(200 + k, bad()) for k in range(80)]
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood before the night falls"
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, f"{good(3)}\n{item}\n{good(2)}"), (303, None), (304, ""), (None, rows[5][1]), (None, good(4)), (7, good(6)), (12, rows[12][1])]
    toxic = [(400 + k, good(4) + "\nSuch an awful nasty word here.") for k in range(30)]
    rows += toxic
    docs = [(i, t, "en", "web", len(t) if t else None) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(120)] + [(200 + k, 0, 0) for k in range(60)] + [(400 + k, 1, 1) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == names and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    good = [(i, t) for i, t in rows if t and "BUY" not in t]
    assert not [t for _, t in kept[0] if t and "BUY" in t] and len([t for _, t in kept[0] if t]) >= 0.95 * len(good)
    one, two = {i for i, _ in kept[0]}, {i for i, _ in kept[1]}
    assert {300, 301} <= one and not {300, 301} & two and 3 in two  # copies go, the smallest id stays
    assert [t for i, t in kept[1] if i == 7] == [t for i, t in rows if i == 7]  # two texts of one id are two documents
    assert [i for i, _ in kept[1]].count(12) == 1 and [i for i, _ in kept[1]].count(None) == 1
    assert 302 in two and 302 not in {i for i, _ in kept[2]} and len(kept[2]) == len(kept[1]) - 1
    share = sum("awful" in (t or "") for _, t in kept[3]) / len(kept[3])
    before = sum("awful" in (t or "") for _, t in kept[2]) / len(kept[2])
    assert share < before / 1.5 and abs(share - 0.05) < 0.04
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tool = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = [np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in kept[3]]
    assert sorted((r.n_tokens, r.ids_crc32) for r in last) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)


def test_run_gives_the_rows_of_its_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(folder, spark)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert len(rows) > 150 and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    tables(folder, spark)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0

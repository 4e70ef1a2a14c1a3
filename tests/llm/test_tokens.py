import json
import zlib

import numpy as np
import pytest

pytest.importorskip("phonoframe.llm")
tokenizers = pytest.importorskip("tokenizers")
from phonoframe.llm import tokenout  # noqa: E402

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def wanted(texts):
    tool = tokenizers.Tokenizer.from_file(PATH)
    return [np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def test_many_files_batches_and_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenout, "FILE_DOCS", 7)
    monkeypatch.setattr(tokenout, "READ_DOCS", 3)
    monkeypatch.setattr(tokenout, "SLICE_BYTES", 40)
    rows = [(k, f"text {k} of words, number {k * k}") for k in range(90)] + [(5, "another"), (5, "another"), (None, "no id"), (None, None), (91, "")]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in rows], "doc_id long, text string, mark string, start int")
    manifest = tokenout.write_tokens(df, PATH, str(tmp_path / "out"))
    assert manifest.count() >= 12 and max(r.docs for r in manifest.collect()) <= 7
    got = sorted(tokenout.read_tokens(manifest, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    ids = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert ids == sorted(ids) and ids[:2] == [-1, -1]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    marks = lambda pairs: sorted((i if i is not None else -1, len(x), zlib.crc32(x.tobytes())) for i, x in pairs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == marks(zip([i for i, _ in rows], wanted([t for _, t in rows]), strict=True))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenout.token_files(df, PATH, folder=str(tmp_path / "none")).count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import pyarrow as pa

    with open(PATH, encoding="utf-8") as file:
        parts = json.load(file)
    assert tokenout.Encoder(PATH).by_word
    parts["normalizer"] = {"type": "NFC"}  # no lower case: words must not be folded
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts), encoding="utf-8")
    coder, tool = tokenout.Encoder(str(path)), tokenizers.Tokenizer.from_file(str(path))
    texts = ["Hello World", None, "a.B c"]
    ids, n = coder.encode(pa.array(texts))
    assert not coder.by_word and ids.tolist() == [x for t in texts for x in tool.encode(t or "", add_special_tokens=False).ids] and len(n) == 3


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_are_exact(kind):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 2), (9, 1 << 16), (1000, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (tokenout.unplanes(tokenout.planes(ids, kind), n, kind) == ids).all()

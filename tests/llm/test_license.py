import math
import random
import re

import pytest

pytest.importorskip("phonoframe.llm")
from phonoframe.llm import license  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def holds(words, phrase):
    parts = phrase.split(" ")
    return any(words[k : k + len(parts)] == parts for k in range(len(words)))


def brute(texts):
    """Labels by trying every template at every place."""
    rows = [split(t) for t in texts]
    n = {x: sum(x in set(w) for w in rows) for x in license.VOCABULARY}
    idf = {x: math.log((len(rows) + 1) / (n[x] + 0.5)) for x in n}
    out = []
    for w in rows:
        found = {}
        for label, text, keys in license.TEMPLATES:
            t = text.split(" ")
            whole = sum(idf[x] for x in t)
            best = max((sum(idf[x] for k, x in enumerate(t) if 0 <= b + k < len(w) and w[b + k] == x) / whole for b in range(-len(t), len(w) + 1)), default=0)
            if best >= license.AGREE and all(holds(w, k) for k in keys):
                found[label] = best
        out.append(found)
    return out


def test_labels_equal_trying_every_place(spark):
    rng = random.Random(4)
    filler = "the of to and a in this software license words stand is for free any".split()
    texts = [None, "", "under cc by nc 4 0", "Licensed under CC BY-NC 4.0.", "under cc_by_nc 4 0", "licence the license " * 50]
    for label, text, _ in license.TEMPLATES:
        for drop in (0, 0.1, 0.25, 0.5):
            words = [w if rng.random() >= drop else rng.choice(filler) for w in text.split(" ")]
            texts.append(" ".join(rng.choices(filler, k=rng.randint(0, 20)) + words + rng.choices(filler, k=5)))
        cut = text.split(" ")
        texts.append(" ".join(cut[len(cut) // 4 :]))  # the beginning lies before the text
        texts.append(f"{text.upper()} -- {text.replace(' ', ', ')}")
    texts += [" ".join(rng.choices(filler, k=30)) for _ in range(60)]
    rows = spark.createDataFrame([(k, t, "x", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, labels string, w double")
    got = {r.doc_id: r for r in license.scan(rows).collect()}
    want = brute(texts)
    for k, found in enumerate(want):
        assert sorted(got[k].labels) == sorted(found), texts[k]
        if found and not got[k].base:
            assert abs(got[k].score - min(1, max(found.values()))) < 1e-9
    assert {label for found in want for label in found} == {label for label, _, _ in license.TEMPLATES}
    assert got[4].labels == ["cc-by-nc-4.0"] and got[2].labels == ["cc-by-nc-4.0"]


def test_long_texts_repeated_rows_and_empty_table(spark):
    long = "license mit " * 20_000 + "released under the mit license"
    rows = spark.createDataFrame([(1, long), (2, "x " * 50), (2, "x " * 50), (None, "MIT License"), (3, None)], "doc_id long, text string")
    got = license.digest(license.scan(rows)).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 40_005 and by[1].n_base == 20_000 and by[1].labels == "mit,mit-notice" and by[1].last_word == 40_003
    assert by[2].labels == "" and by[None].base_labels == "mit" and by[3].n_words == 0
    assert license.digest(license.scan(rows.limit(0))).count() == 0


def test_postings_are_enough():
    idf = {x: 1.0 + len(x) / 7 for x in license.VOCABULARY}
    posted, whole = license.index(idf)
    for number, (_, text, _) in enumerate(license.TEMPLATES):
        mine = {x for x, ps in posted.items() if any(p // license.STRIDE == number for p in ps)}
        rest = sum(idf[x] for x in text.split(" ") if x not in mine)
        assert rest < license.AGREE * whole[number]

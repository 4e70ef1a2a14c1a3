import gzip
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from phonoframe.functions import ipatext, tokens, vocab
from phonoframe.functions.arrays import running_sum
from phonoframe.operators import evaluate, lexicon
from phonoframe.operators.stress import Lexicon, resolve
from phonoframe.plans import legacy, models
from phonoframe.plans.build_lexicon import build
from phonoframe.plans.phonemize import Models, phonemize
from phonoframe.sources import tables
from phonoframe.streaming.phonemes import prepared

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def lex_of(spark, **parts):
    schemas = {
        "accents": "word string, stress int", "yo": "e_form string, yo_form string", "yo_homographs": "e_form string, yo_form string", "homographs": "word string, candidates array<int>",
        "homograph_ctx": "key string, stress int", "suffix_stress": "suffix string, stress_from_end int", "train_words": "word string, stress int",
    }
    return Lexicon(**{name: spark.createDataFrame(parts.get(name, []), schema) for name, schema in schemas.items()})


def test_running_sum(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 200)], "x array<int>")
    for r in rows.select("x", running_sum(F.col("x")).alias("s")).collect():
        assert r.s == np.cumsum(r.x).tolist()


def test_row_plans_equal_windows(spark):
    texts = ["Hello, big world! да ok fine", "", "...", "one", "a b c, d e. f' g'h", None, "да нет", "x да y z ... w"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    flat = tokens.exploded(rows, "doc_id", "text")
    want = {(r.doc_id, r.pos): r.offset for r in tokens.with_offsets(flat, "doc_id").collect()}
    toks = tokens.tokens(F.col("text"))
    got = {(r.doc_id, r.pos): r.offset for r in rows.select("doc_id", F.posexplode(tokens.offsets(toks)).alias("pos", "offset")).collect()}
    assert got == want and len(got) == 27
    runs = {(r.doc_id, r.first, r.words, r.run) for r in tokens.latin_runs(flat, "doc_id").collect()}
    mine = rows.select("doc_id", F.explode(tokens.runs_of_latin(toks)).alias("r")).select("doc_id", "r.first", F.size("r.words").alias("words"), F.array_join("r.words", " ").alias("run"))
    assert {tuple(r) for r in mine.collect()} == runs
    for r in rows.where("text is not null").select(tokens.joined(toks).alias("s"), tokens.offsets(toks).alias("o"), toks.alias("t")).collect():
        assert all(r.s[a : a + len(t)] == t for a, t in zip(r.o, r.t, strict=True))


def test_marked_word(spark):
    row = spark.createDataFrame([("на замок, вот", 3, "замок")], "s string, o int, w string").select(models.marked(F.col("s"), F.col("o"), F.col("w")).alias("m")).first()
    assert row.m == "на <w>замок</w>, вот"


def choose():
    return lambda marked, form: 0.9 if ("повесил <w>" in marked) == form.endswith("+ок") else 0.1


def tag():
    return lambda sentence: models.word_means([(a, w) for a, w in zip(np.cumsum([0] + [len(w) + 1 for w in sentence.split(" ")]).tolist(), sentence.split(" "), strict=False)], [0.9 if w.startswith("все") else 0.1 for w in sentence.split(" ")])


def engine():
    def say(word):
        if word == "бяка":
            raise ValueError(word)
        return " kˈuk. " if word == "кука" else ""

    return say


def latin():
    return lambda run: {"hello world": "həlˈoʊ wˈɜːld", "ok": "oʊkˈeɪ sˈɜː"}.get(run) or 1 / 0


def test_models_and_engines(spark):
    lex = lex_of(spark, homographs=[("замок", [0, 1]), ("один", [0])], yo_homographs=[("все", "всё")], accents=[("повесил", 1), ("люди", 0)])
    texts = ["Он повесил замок.", "Замок старый.", "все люди", "все люди тут", "кука бяка", "Hello, hello world ok нет ok fine", None, "   ", "Один"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    said = phonemize(rows, lex, models_=Models(choose, tag, engine, latin)).orderBy("n").collect()
    tiers = [[(x.word, x.tier) for x in r.report or []] for r in said]
    assert tiers[0] == [("он", "mono"), ("повесил", "dict"), ("замок", "homograph-model")] and "zɐmˈok" in said[0].ipa
    assert tiers[1][0] == ("замок", "homograph-model") and said[1].ipa.startswith("zˈamək")
    assert tiers[2][0] == ("все", "context") and tiers[3][0] == ("все", "yo")  # the tagger needs three words
    assert tiers[4] == [("кука", "ood-engine"), ("бяка", "ood-suffix")] and said[4].ipa.startswith("kˈuk ")
    assert [w for w, t in tiers[5] if t == "latin"] == ["hello", "hello", "ok", "fine"] or [w for w, t in tiers[5]] == ["hello", "hello", "world", "ok", "нет", "ok", "fine"]
    assert said[6].ipa is None and said[7].ipa == "" and tiers[8] == [("один", "homograph-prior")]
    plain = phonemize(rows, lex).orderBy("n").collect()
    assert [x.tier for x in plain[0].report] == ["mono", "dict", "homograph-prior"] and [x.tier for x in plain[4].report] == ["ood-suffix"] * 2
    assert plain[5].ipa == "hello, hello world ok nʲet ok fine."


def test_latin_runs_said_by_an_engine(spark):
    rows = spark.createDataFrame([(0, "hello world"), (1, "да ok да"), (2, "fine day")], "n int, text string")
    got = {r.n: (r.ipa, [(x.word, x.ipa) for x in r.report if x.tier == "latin"]) for r in phonemize(rows, lex_of(spark), models_=Models(latin=latin)).collect()}
    assert got[0] == ("həlˈoʊ wˈɜːld.", [("hello", "həlˈoʊ"), ("world", "wˈɜːld")])
    assert got[1][0] == "da oʊkˈeɪ sˈɜː da." and got[1][1] == [("ok", "oʊkˈeɪ sˈɜː")]  # two sounds for one word: all of it stands there
    assert got[2][0] == "fine day."  # a failure leaves the words


def test_nfc_by_default(spark):
    rows = spark.createDataFrame([(0, "йод"), (1, "йод")], "n int, text string")
    assert len({r.ipa for r in phonemize(rows, lex_of(spark)).collect()}) == 1
    got = spark.createDataFrame([("é",), ("plain",)], "t string")
    assert sorted(r.t for r in ipatext.with_composed(got, "t").collect()) == ["plain", "é"]
    assert spark.createDataFrame([(" ç ",)], "t string").select(ipatext.normalize_ipa(F.col("t")).alias("o")).first().o == "ç."


def test_verdict_columns_and_tables(spark):
    lex = lex_of(spark, yo_homographs=[("все", "всё"), ("небо", "нёбо")])
    words = spark.createDataFrame([("небо", None, None, "YO", None), ("небо", None, None, "NO_YO", None), ("небо", None, None, None, None)], "tok string, prev string, next string, verdict string, choice int")
    assert sorted(r.accented for r in resolve(words, lex).collect()) == ["н+ебо", "н+ебо", "н+ёбо"]
    table = spark.createDataFrame([("небо", "a", None, "YO")], "tok string, prev string, next string, verdict string")
    rows = spark.createDataFrame([("небо", "a", None), ("небо", "b", None)], "tok string, prev string, next string")
    assert {r.prev: r.accented for r in resolve(rows, lex, table).collect()} == {"a": "н+ёбо", "b": "н+ебо"}


def test_lexicon_build(spark):
    accents = spark.createDataFrame([("замок", "з+амок"), ("дом", "дом"), *[(f"{a}ушка", f"{a}+ушка") for a in ("бабо", "дево", "избо", "кадо", "мако")]], "word string, accented string")
    yo = spark.createDataFrame([("елка", "ёлка"), ("все", "всё")], "e_form string, yo_form string")
    hom = spark.createDataFrame([("замок", ["з+амок", "зам+ок", "замок"]), ("мука", ["м+ука", "мук+а"]), ("рука", ["рук+а"])], "word string, variants array<string>")
    labels = spark.createDataFrame([
        (1, "пов+есил замок на дверь", "pə zɐmˈok na dvʲerʲ"), (2, "а замок на", "a zɐmˈok na"), (3, "замок", "zɐmˈok"), (4, "один два", "x"), (5, "мука ела", "mˈukə jˈelə"), (6, "мука была", "mukˈa bɨlˈa"), (7, "мука", "muka"),
    ], "row long, text string, ipa string")
    lex = build(accents, yo, yo.where("e_form = 'все'"), hom, labels)
    assert {r.word: r.stress for r in lex.accents.collect()} == {"замок": 0, **{f"{a}ушка": 2 for a in ("бабо", "дево", "избо", "кадо", "мако")}}
    assert [r.e_form for r in lex.yo.collect()] == ["елка"]
    assert {r.word: r.candidates for r in lex.homographs.collect()} == {"замок": [1, 0], "мука": [0, 1]}
    assert {r.key: r.stress for r in lex.homograph_ctx.collect()} == {"n|замок|на": 1}
    assert {r.suffix: r.stress_from_end for r in lex.suffix_stress.collect()} == {"ушка": 1, "шка": 1, "оушка": 1}
    assert {r.word: r.stress for r in lex.train_words.collect()} == {"замок": 1, "мука": 0, "ела": 0, "была": 1}  # of a tie the first seen
    bare = build(accents, yo, yo.limit(0), hom)
    assert bare.train_words.count() == 0 and {r.word: r.candidates for r in bare.homographs.collect()}["замок"] == [0, 1]


def test_gold_totals(spark):
    gold = spark.createDataFrame([("sentence", "a", "mˈama dom.", [["mˈama"], ["dom", "dˈom"]]), ("sentence", "b", "mamˈa ☃", [["mˈama"], ["dom"]]), ("word", "c", "da da", [["da"]]), ("word", "d", None, [["da"]])], "kind string, text string, ipa string, slots array<array<string>>")
    got = {r.kind: r.asDict() for r in evaluate.totals(evaluate.scored(gold)).collect()}
    assert (got["sentence"]["n"], got["sentence"]["failed"], got["sentence"]["words"], got["sentence"]["word_hits"], got["sentence"]["stressed"], got["sentence"]["stress_hits"], got["sentence"]["unknown"]) == (2, 1, 4, 2, 2, 1, "☃")
    assert (got["word"]["n"], got["word"]["failed"], got["word"]["word_hits"], got["word"]["per"]) == (2, 2, 0, 1.25)


LOADS = []


def engines():
    def accent(text):
        if "boom" in text:
            raise ValueError(text)
        return text.replace("о", "+о", 1)

    return accent, lambda text: "fsʲe" if text.startswith("вс") else " t~s" + text.replace("+", "'") + " "


def test_legacy_driver(spark, tmp_path):
    rows = spark.createDataFrame([(0, " дом "), (1, "boom"), (2, None), (3, "всё"), (4, "дом")], "n int, text string")
    got = {r.n: r.ipa for r in legacy.phonemize_by(rows, engines).collect()}
    assert got == {0: "ʦдˈом", 1: "", 2: "", 3: "fsʲˈɵ", 4: "ʦдˈом"}
    assert tuple(legacy.outcome(legacy.phonemize_by(rows, engines)).first()) == (5, 2)
    assert [r.n for r in legacy.phonemize_by(rows, engines, limit=2, order="n").orderBy("n").collect()] == [0, 1]
    source, target = tmp_path / "metadata.csv", str(tmp_path / "out")
    source.write_text('text,other\n"да, дом",1\nboom,2\n"two\nlines",3\n', encoding="utf-8")
    told = legacy.run_corpus(spark, str(source), target, engines)
    assert (told["rows"], told["failures"]) == (3, 1) and told["rows_per_s"] > 0
    back = tables.read_csv(spark, target)
    assert back.columns == ["text", "other", "ipa"] and [r.other for r in back.collect()] == ["1", "2", "3"]
    spoken = legacy.spoken_texts(spark, ["дом", "Ж"], engines, str(tmp_path / "list")).collect()
    assert [r.accented for r in spoken] == ["д+ом", "Ж"] and spoken[1].unknown == ["Ж"]
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "list")).collect()] == [["ʦдˈом", "ʦЖ"]]
    with pytest.raises(Exception, match="no sound"):
        legacy.spoken_texts(spark, ["boom"], engines, str(tmp_path / "bad"))


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("а\t1\nб\t2\tx\nа\t3\nno tab\n\n")
    assert {r.word: r.v for r in tables.read_tsv(spark, str(tmp_path / "t.tsv.gz"), "word", "v string").collect()} == {"а": "3", "б": "2\tx"}
    with gzip.open(tmp_path / "m.json.gz", "wt", encoding="utf-8") as f:
        json.dump({"а": "б", "в": "г"}, f, ensure_ascii=False)
    assert {tuple(r) for r in tables.read_json_map(spark, str(tmp_path / "m.json.gz")).collect()} == {("а", "б"), ("в", "г")}
    (tmp_path / "gold.tsv").write_text("# c\n\nword\tдом\tdom|dˈom\tmore\nshort\tline\nsentence\tа б\ta b\n", encoding="utf-8")
    assert [(r.kind, r.slots) for r in tables.read_gold(spark, str(tmp_path / "gold.tsv")).collect()] == [("word", [["dom", "dˈom"]]), ("sentence", [["a"], ["b"]])]
    lex = lex_of(spark, accents=[("б", 1), ("а", 0)], homographs=[("замок", [0, 1])])
    for name in tables.SCHEMAS:
        tables.write_tsv(getattr(lex, name), str(tmp_path / "lex" / f"{name}.tsv.gz"))
    back = tables.read_lexicon(spark, str(tmp_path / "lex"))
    assert [tuple(r) for r in back.homographs.collect()] == [("замок", [0, 1])] and back.accents.count() == 2
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_lexicon(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "empty.csv").write_text("text\n", encoding="utf-8")
        tables.read_metadata(spark, str(tmp_path / "empty.csv"))


def test_lexicon_rows(spark):
    labels = spark.createDataFrame([(1, "а б", "a b"), (2, "а б", "a")], "row int, text string, ipa string")
    assert [(r.word, r.sound) for r in lexicon.aligned(labels, "text", "ipa").orderBy("pos").collect()] == [("а", "a"), ("б", "b")]
    yo = spark.createDataFrame([("а", "б"), ("в", "г")], "e_form string, yo_form string")
    assert [r.e_form for r in lexicon.without_homographs(yo, yo.where("e_form = 'а'")).collect()] == ["в"]


def test_encode_with_a_warning(spark):
    rows = spark.createDataFrame([("a☃",), ("b",), ("<x>☃☂",)], "t string")
    done, seen = vocab.encode_warned(rows, "t")
    assert sorted(r.ids for r in done.collect()) == [[0, 0], [vocab.SYMBOLS.index("a"), 0], [vocab.SYMBOLS.index("b")]]
    assert seen.get["texts"] == 2 and seen.get["symbols"] == ["☂", "☃"]
    assert len(vocab.SYMBOLS) == 245 and len(set(vocab.SYMBOLS)) == 245


def test_prepared_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("5 домов, ok\n", encoding="utf-8")
    stream = prepared(spark.readStream.schema("value string").text(str(tmp_path / "in")), "value")
    query = stream.writeStream.format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    row = spark.sql("select * from said").first()
    assert row.clean.startswith("пять домов") and [t.tok for t in row.tokens] == ["пять", "домов", ",", "ok"] and len(row.ids) == len("5 домов, ok")


def test_model_folder(tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"0": "NO_YO", "1": "YO"}}), encoding="utf-8")
    onnx = models.Onnx(str(tmp_path))
    assert not onnx.available() and onnx.label_ids() == {"NO_YO": 0, "YO": 1}
    asked = {}

    class Model:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, feeds):
            asked.update(feeds)
            return [np.array([[1.0, 1.0]])]

    encoded = type("E", (), {"ids": [1], "attention_mask": [1], "type_ids": [0]})
    assert models.probabilities(models.Session(None, Model()).run(encoded)).tolist() == [0.5, 0.5] and set(asked) == {"input_ids", "attention_mask"}
    assert models.word_means([(0, "a"), (1, "##b"), (3, "c")], [0.2, 0.4, 0.9]) == [(0, pytest.approx(0.3)), (3, 0.9)]


def test_the_plan_of_phonemize_stays_small(spark):
    """The driver's memory goes to plans: the tokens' expressions and the joins of the tiers stand in it few times."""
    rows = spark.createDataFrame([(1, "сто"), (2, "21 июля & 3,5%"), (3, None), (4, "é й")], "n int, text string")
    out = phonemize(rows, lex_of(spark)).select("n", "ipa")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 15  # 5 of each copy
    assert plan.count("Join ") <= 16

import duckdb
import pytest
from pyspark.sql import functions as F

from phonoframe import queries as own
from phonoframe.functions import ipatext, numbers, phones, tokens, vocab
from phonoframe.operators import lexicon
from phonoframe.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or str(v) in ("nan", "<NA>", "None"):
        return "~"
    return v if isinstance(v, str | bool) else str(float(v))


def same(a, b):
    rows = lambda d: sorted(tuple(map(value, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    return rows(a) == rows(b)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(own.queries()) == set(own.oracle_sql())


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert same(own.queries()[name](spark, SF).toPandas(), duck.execute(own.oracle_sql()[name]).df())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, said", [
    ("5 лет", "пять лет"), ("3,5 %", "три целых пять десятых процентов"), ("9 мая", "девятое мая"), ("2000 год", "двухтысячный год"), ("21 книга", "двадцать одна книга"),
    ("1 000 000", "один миллион"), ("1234567890123", "1234567890123"), ("0", "ноль"), ("5 6", "пятьдесят шесть"),
])
def test_numbers(spark, text, said):
    assert one(spark, numbers.expand_numbers(F.lit(text))) == said


def test_vocabulary(spark):
    assert len(vocab.SYMBOLS) == len(set(vocab.SYMBOLS)) == 245
    assert vocab.SYMBOLS.index("ʣ") == 244 and vocab.SYMBOLS.index("ˈ") == 120
    assert one(spark, vocab.encode(F.lit("привет"))) == [0] * 6
    assert one(spark, vocab.unknown_symbols(F.lit("ппивет"))) == list("пивет")
    assert one(spark, vocab.decode(vocab.encode(F.lit("vɐˈda")))) == "vɐˈda"
    assert one(spark, vocab.encode(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="outside the table"):
        spark.range(1).select(vocab.encode(F.lit("привет"), "raise")).collect()


def test_tokens(spark):
    got = one(spark, tokens.sited(tokens.tokens(F.lit("Да, and Нет!"))))
    assert [(r.tok, r.prev, r.next) for r in got] == [("да", None, "and"), (",", None, None), ("and", "да", "нет"), ("нет", "and", None), ("!", None, None)]
    assert one(spark, tokens.tokens(F.lit(""))) == []


def test_normalize(spark):
    assert one(spark, ipatext.normalize_ipa(F.lit(" a  ,b ''x''"))) == "a ,b'x'"
    assert one(spark, ipatext.normalize_ipa(F.lit(""))) == "."


def test_words_have_one_stress():
    for w in ["кор+ова", "молок+о", "", None, "ъ", "абв", "отд+ать"]:
        assert (phones.word_to_ipa(w) or "").count("ˈ") <= 1


def test_years(spark):
    row = own.queries()["phonemize_years"](spark, SF).where("text like '%1995%'").first()
    assert row.ipa == "v tˈɨsʲɪʧə dʲɪvʲɪʦˈot dʲɪvʲɪnˈostə pʲˈatəm ɡɐdˈu on staɫ."


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("б", 1), ("а", 0)], "word string, stress int")
    tables.write_tsv(rows, f"{tmp_path}/t")
    assert sorted(map(tuple, tables.read_tsv(spark, f"{tmp_path}/t", "word", "stress int").collect())) == [("а", 0), ("б", 1)]
    text = spark.createDataFrame([('a "b", c\nd', "1")], "text string, n string")
    tables.write_csv(text, f"{tmp_path}/c")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/c").collect()] == [('a "b", c\nd', "1")]


def test_stress_index(spark):
    assert one(spark, lexicon.stress_index(F.lit("зам+ок"))) == 1 and one(spark, lexicon.stress_index(F.lit("замок"))) is None

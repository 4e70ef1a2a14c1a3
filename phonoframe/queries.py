"""Queries over the driver's tables, and the SQL of each that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.functions import ipatext, numbers, phones, tokens, vocab
from phonoframe.functions.arrays import bound
from phonoframe.operators import evaluate, lexicon
from phonoframe.operators.stress import Lexicon, resolve
from phonoframe.plans.build_lexicon import build
from phonoframe.plans.phonemize import phonemize

Query = Callable[[SparkSession, str], DataFrame]
FIXTURES = [
    ("мо+ей", "mɐˈjej"), ("даёт", "dɐˈjɵt"), ("+если", "ˈjesʲlʲɪ"), ("час+ы", "ʧɪsˈɨ"), ("жал+еть", "ʐɨlʲˈetʲ"), ("дв+адцать", "dvˈaʦːɨtʲ"), ("рай+он", "rɐˈjon"), ("май+ор", "mɐˈjor"),
    ("кон+ечно", "kɐnʲˈeʂnə"), ("что", "ʂto"), ("бог", "box"), ("же", "ʐɨ"), ("во", "vɐ"), ("нибудь", "nʲɪbʊtʲ"), ("ж", "ʂ"), ("в", "v"), ("так+ое", "tɐkˈojə"), ("эн+ергия", "ɛnˈɛrɡʲɪjə"),
    ("н+овые", "nˈovɨje"), ("пьёт", "pʲjɵt"), ("днём", "dʲnʲɵm"), ("всё", "fsʲˈɵ"), ("д+енег", "dʲˈenʲɪk"), ("из", "is"),
]
OVERRIDDEN = [
    ("всё", "fsʲe", None, "fsʲˈɵ"), ("всё.", "fsʲe.", None, "fsʲˈɵ."), ("Всё,", "fsʲe,", None, "fsʲˈɵ,"), ("все", "fsʲe", "вс+ё", "fsʲˈɵ"), ("и все.", "i fsʲe.", "и вс+ё.", "i fsʲˈɵ."),
    ("все", "fsʲe", "вс+е", "fsʲe"), ("всё и всё", "fsʲe", None, "fsʲe"), ("всё", "fsʲe", "вс+ё и вс+ё", "fsʲˈɵ"), ("привет", "prʲɪvʲet", None, "prʲɪvʲet"),
]
REMAPPED = [("t~sena", "ʦena"), ("t~ɕas", "ʧas"), ("d~ʐem", "ʤem"), ("vɐ'da", "vɐˈda"), ("t͡sena", "ʦena"), ("t͡ɕas", "ʧas"), ("mʊt͡ʂinə", "mʊʧinə"), ("d͡ʑem", "ʤem"), ("t͜sena", "ʦena"), ("p~f", "pf"), ("p͡f", "pf")]
MARKED = [("всё", "вс+ё"), ("её ещё", "е+ё ещ+ё"), ("сам+олёт", "сам+олёт"), ("вс+ё", "вс+ё"), ("трёхколёсный", "трёхкол+ёсный"), ("четырёхзвёздочный", "четырёхзв+ёздочный"), ("Ёлка", "+Ёлка"), ("Всё готово", "Вс+ё готово"), ("привет мир", "привет мир"), (" a\n\tё  ё ", " a\n\t+ё  +ё ")]
CASCADE = [  # word, next, stressed, tier, under the lexicon below
    ("он", "повесил", "+он", "mono"), ("повесил", "замок", "пов+есил", "dict"), ("замок", "на", "з+амок", "homograph-prior"), ("замок", None, "зам+ок", "homograph-prior-ctx"), ("все", "люди", "вс+е", "context"),
    ("все", "равно", "вс+ё", "yo"), ("далеко", "в", "далек+о", "dict"), ("елка", None, "+ёлка", "yo"), ("в", "доме", "в", "novowel"), ("кукарача", None, "кукар+ача", "ood-suffix"), ("программист", None, "программ+ист", "ood-suffix"), ("тестовый", None, "т+естовый", "train"),
]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def small_lexicon(spark: SparkSession) -> Lexicon:
    """A few hand-made rows per table."""
    make = spark.createDataFrame
    accents = {"повесил": 1, "далеко": 2, "года": 0, "году": 1, "тысяча": 0, "девятьсот": 2, "стал": 0, "заказ": 1, "девяносто": 2, "первом": 0, "втором": 1, "третьем": 0, "четвёртом": 1, "пятом": 0, "шестом": 1, "седьмом": 1, "восьмом": 1}
    return Lexicon(
        make(list(accents.items()), "word string, stress int"), make([("елка", "ёлка")], "e_form string, yo_form string"), make([("все", "всё"), ("далеко", "далёко")], "e_form string, yo_form string"),
        make([("замок", [0, 1])], "word string, candidates array<int>"), make([("n|замок|</s>", 1)], "key string, stress int"), make([("ача", 1), ("ммист", 0)], "suffix string, stress_from_end int"), make([("тестовый", 0)], "word string, stress int"),
    )


def oov_audit(s: SparkSession, d: str) -> DataFrame:
    unknown = F.translate("text", vocab.SYMBOLS, "")  # what is left when the table's symbols go
    chars = read(s, d, "documents").select("lang", F.explode(vocab.characters(unknown)).alias("ch"))
    return chars.groupBy("lang", "ch").agg(F.count("*").alias("n"))


def first_vowel(word) -> F.Column:
    return F.length(F.regexp_extract(word, "^[^aeiou]*", 0))


def words_of(s: SparkSession, d: str) -> DataFrame:
    """A pseudo-lexicon: words of the documents, labelled with the place of their first vowel."""
    rows = tokens.exploded(read(s, d, "documents"), "doc_id", "text").where("kind = 'latin'")
    return rows.select(F.col("tok").alias("word"), F.struct("doc_id", "pos").alias("seen"), first_vowel(F.col("tok")).alias("stress"))


def suffix_majority(s: SparkSession, d: str) -> DataFrame:
    words = words_of(s, d).groupBy("word", "stress").agg(F.count("*").alias("n"), F.min("seen").alias("first"))  # different words only are cut into suffixes
    each = words.select("stress", "n", "first", F.explode(lexicon.suffixes(F.col("word"))).alias("suffix"))
    counts = each.groupBy("suffix", "stress").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return lexicon.majority_of_counts(counts, "suffix", "stress", lexicon.SUFFIX_SUPPORT, lexicon.SUFFIX_SHARE)


def context_majority(s: SparkSession, d: str) -> DataFrame:
    latin = F.filter(tokens.tokens(F.col("text")), lambda t: tokens.kind(t) == "latin")
    near = read(s, d, "documents").select("doc_id", F.posexplode(bound(latin, lexicon.neighbours)).alias("pos", "x"))
    rows = near.select(F.struct("doc_id", "pos").alias("seen"), first_vowel(F.col("x.word")).alias("stress"), F.explode(lexicon.context_keys(F.col("x"))).alias("context"))
    return lexicon.majority(rows, "context", "stress", "seen", lexicon.CONTEXT_SUPPORT, lexicon.CONTEXT_SHARE)


def total(values) -> F.Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def offsets(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", tokens.offsets(tokens.tokens(F.col("text"))).alias("o")).where("size(o) > 0")
    return rows.select("doc_id", F.size("o").cast("long").alias("n_tokens"), F.element_at("o", -1).alias("last_offset"), total("o").alias("sum_offset"))


def neighbours(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", tokens.word_list(tokens.tokens(F.col("text"))).alias("w")).where("size(w) > 0")
    sizes = F.transform("w", F.length)
    chars = lambda part: F.when(F.size("w") > 1, total(part))
    same = F.size(F.filter(F.transform("w", lambda w, i: (i > 0) & F.coalesce(F.get("w", i - 1) == F.get("w", i + 1), F.lit(False))), lambda x: x))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), chars(F.slice(sizes, F.lit(1), F.size("w") - 1)).alias("prev_chars"), chars(F.slice(sizes, F.lit(2), F.size("w"))).alias("next_chars"), same.cast("long").alias("n_same"))


def latin_runs(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", F.explode(tokens.runs_of_latin(tokens.tokens(F.col("text")))).alias("r"))
    return rows.select("doc_id", "r.first", F.size("r.words").cast("long").alias("words"), F.length(F.array_join("r.words", " ")).alias("chars"))


def punct_runs(s: SparkSession, d: str) -> DataFrame:
    rows = tokens.exploded(read(s, d, "documents"), "doc_id", "text").where("kind = 'punct'")
    return rows.groupBy(F.col("tok").alias("run"), tokens.collapse_run(F.col("tok")).alias("mark")).agg(F.count("*").alias("n"))


def year_text(column: str):
    return F.concat(F.lit("В "), F.year(column).cast("string"), F.lit(" году"))


# Number words with their stress, and how they sound
NUMBER_SOUNDS = {
    "ноль": (None, "nolʲ"), "один": (1, "ɐdʲˈin"), "одна": (1, "ɐdnˈa"), "два": (None, "dva"), "две": (None, "dvʲe"), "три": (None, "trʲi"), "четыре": (1, "ʧɪtˈɨrʲe"), "пять": (None, "pʲætʲ"),
    "шесть": (None, "ʂɛsʲtʲ"), "семь": (None, "sʲemʲ"), "восемь": (0, "vˈosʲɪmʲ"), "девять": (0, "dʲˈevʲɪtʲ"), "десять": (0, "dʲˈesʲɪtʲ"), "одиннадцать": (1, "ɐdʲˈinːəʦːɨtʲ"), "двенадцать": (1, "dvʲɪnˈaʦːɨtʲ"), "тринадцать": (1, "trʲɪnˈaʦːɨtʲ"),
    "четырнадцать": (1, "ʧɪtˈɨrnəʦːɨtʲ"), "пятнадцать": (1, "pʲɪtnˈaʦːɨtʲ"), "шестнадцать": (1, "ʂɨsnˈaʦːɨtʲ"), "семнадцать": (1, "sʲɪmnˈaʦːɨtʲ"), "восемнадцать": (2, "vəsʲɪmnˈaʦːɨtʲ"), "девятнадцать": (2, "dʲɪvʲɪtnˈaʦːɨtʲ"), "двадцать": (0, "dvˈaʦːɨtʲ"), "тридцать": (0, "trʲˈiʦːɨtʲ"),
    "сорок": (0, "sˈorək"), "пятьдесят": (2, "pʲɪdʲɪsʲˈat"), "шестьдесят": (2, "ʂɨzʲdʲɪsʲˈat"), "семьдесят": (0, "sʲˈemʲdʲɪsʲɪt"), "восемьдесят": (0, "vˈosʲɪmʲdʲɪsʲɪt"), "девяносто": (2, "dʲɪvʲɪnˈostə"), "сто": (None, "sto"), "двести": (0, "dvʲˈesʲtʲɪ"),
    "триста": (0, "trʲˈistə"), "четыреста": (2, "ʧɪtɨrʲˈestə"), "пятьсот": (1, "pʲɪʦˈot"), "шестьсот": (1, "ʂɨsːˈot"), "семьсот": (1, "sʲɪmʲsˈot"), "восемьсот": (2, "vəsʲɪmʲsˈot"), "девятьсот": (2, "dʲɪvʲɪʦˈot"), "тысяча": (0, "tˈɨsʲɪʧə"),
    "тысячи": (0, "tˈɨsʲɪʧɪ"), "тысяч": (0, "tˈɨsʲɪʧ"), "миллион": (2, "mʲɪlʲɪˈon"), "миллиона": (2, "mʲɪlʲɪˈonə"), "миллионов": (2, "mʲɪlʲɪˈonəf"), "миллиард": (2, "mʲɪlʲɪˈart"), "миллиарда": (2, "mʲɪlʲɪˈardə"), "миллиардов": (2, "mʲɪlʲɪˈardəf"),
}
# The words of "В <year> году он стал." beside those, with the tier that decides each
YEAR_SOUNDS = {
    "двухтысячном": ("ood-suffix", "dvʊxtɨsʲˈæʧnəm"), "девятом": ("ood-suffix", "dʲɪvʲˈatəm"), "две": ("mono", "dvʲe"), "тысячи": ("ood-suffix", "tɨsʲˈæʧɪ"),
    "в": ("novowel", "v"), "тысяча": ("dict", "tˈɨsʲɪʧə"), "девятьсот": ("dict", "dʲɪvʲɪʦˈot"), "девяносто": ("dict", "dʲɪvʲɪnˈostə"), "году": ("dict", "ɡɐdˈu"), "он": ("mono", "on"), "стал": ("mono", "staɫ"), "первом": ("dict", "pʲˈervəm"),
    "втором": ("dict", "ftɐrˈom"), "третьем": ("dict", "trʲˈetʲjɪm"), "четвёртом": ("yo", "ʧɪtvʲˈɵrtəm"), "пятом": ("dict", "pʲˈatəm"), "шестом": ("dict", "ʂɨstˈom"), "седьмом": ("dict", "sʲɪdʲmˈom"), "восьмом": ("dict", "vɐsʲmˈom"),
}


def number_lexicon(s: SparkSession) -> Lexicon:
    """The accents of the number words; all other tables are empty."""
    accents = [(w, k) for w, (k, _) in NUMBER_SOUNDS.items() if k is not None]
    none = lambda schema: s.createDataFrame([], schema)
    return Lexicon(
        s.createDataFrame(accents, "word string, stress int"), none("e_form string, yo_form string"), none("e_form string, yo_form string"), none("word string, candidates array<int>"),
        none("key string, stress int"), none("suffix string, stress_from_end int"), none("word string, stress int"),
    )


def phonemize_numbers(s: SparkSession, d: str) -> DataFrame:
    """A different Cyrillic sentence for nearly every order: its number in words."""
    rows = read(s, d, "orders").select("o_orderkey", numbers.number_words(F.col("o_orderkey") * 7919).alias("text"))
    return phonemize(rows, number_lexicon(s)).select("o_orderkey", "text", "ipa")


def phonemize_lines(s: SparkSession, d: str) -> DataFrame:
    """Digits, signs, punctuation and Latin words in whole sentences, over the lines of all orders."""
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.lit("& ok,"), F.col("l_partkey").cast("string"), F.lit("+"), F.col("l_suppkey").cast("string"), F.lit("?!")).alias("text"))
    said = phonemize(rows, number_lexicon(s))
    return said.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("ipa")), "|").cast("binary")).alias("digest"))


def lexicon_build(s: SparkSession, d: str) -> DataFrame:
    """The tables that a labelled corpus gives, the corpus being number words and their sounds."""
    sounds = F.create_map(*[F.lit(x) for w, (_, ipa) in NUMBER_SOUNDS.items() for x in (w, ipa)])
    text = read(s, d, "orders").select(F.col("o_orderkey").alias("row"), numbers.number_words(F.col("o_orderkey") * 7919).alias("text"))
    labels = text.withColumn("ipa", F.array_join(F.transform(F.split("text", " "), lambda w: F.element_at(sounds, w)), " "))
    accents = s.createDataFrame([("тысяча", "т+ысяча"), ("тысячи", "т+ысячи"), ("миллион", "милли+он"), ("двести", "дв+ести"), ("ноль", "ноль")], "word string, accented string")
    yo = s.createDataFrame([("елка", "ёлка"), ("все", "всё")], "e_form string, yo_form string")
    hom = s.createDataFrame([("двадцать", ["двадц+ать", "дв+адцать", "двадцать"]), ("сорок", ["с+орок", "с+орок"]), ("триста", ["трист+а", "тр+иста"])], "word string, variants array<string>")
    lex = build(accents, yo, yo.where("e_form = 'все'"), hom, labels)
    part = lambda kind, df, key, value: df.select(F.lit(kind).alias("part"), F.col(key).alias("key"), value.cast("string").alias("value"))
    parts = [
        part("train", lex.train_words, "word", F.col("stress")), part("context", lex.homograph_ctx, "key", F.col("stress")), part("homograph", lex.homographs, "word", F.array_join("candidates", ",")),
        part("accent", lex.accents, "word", F.col("stress")), part("yo", lex.yo, "e_form", F.col("yo_form")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def phonemize_years(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").select("o_orderkey", F.concat(year_text("o_orderdate"), F.lit(" он стал.")).alias("text"))
    said = phonemize(rows, small_lexicon(s))
    return said.select("o_orderkey", "text", "ipa", F.array_join(vocab.encode(F.col("ipa")), " ").alias("ids"))


def tier_report(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").select(F.concat(year_text("o_orderdate"), F.lit(" он стал.")).alias("text"))
    said = phonemize(rows, small_lexicon(s)).select(F.explode("report").alias("r"))
    return said.groupBy("r.tier").agg(F.count("*").alias("n"), F.countDistinct("r.word").alias("words"))


def tier_cascade(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(w, "и" if w == "все" else None, n) for w, n, _, _ in CASCADE], "tok string, prev string, next string")
    return resolve(rows, small_lexicon(s)).select("tok", "next", "accented", "tier")


def gold(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(w, i, i if k % 3 else i + "x") for k, (w, i) in enumerate(FIXTURES)], "word string, gold string, said string")
    return rows.select("word", evaluate.slots_match(F.array("said"), F.array(F.array("gold"))).alias("exact"), F.round(evaluate.error_rate(F.col("said"), F.col("gold")), 6).alias("per"))


def softmax_argmax(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "embeddings")
    return rows.select("vec_id", evaluate.argmax(F.col("embedding")).alias("best"), F.round(F.array_max(evaluate.softmax(F.col("embedding"))), 5).alias("p"))


def subword_mean(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "events")
    return lexicon.candidates(rows, "user_id", "event_type", "event_id").select("user_id", F.array_join("candidates", ",").alias("candidates"))


def queries() -> dict[str, Query]:
    # columns are made when a query runs: without a session there are none
    t = lambda: F.col("text")
    doc = lambda make: lambda s, d: read(s, d, "documents").select("doc_id", F.md5(make(t()).cast("binary")).alias("digest"))
    order = lambda make: lambda s, d: read(s, d, "orders").select("o_orderkey", make().alias("words"))
    return {
        "oov_audit": oov_audit,
        "oov_distinct_in_order": lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.array_join(vocab.unknown_symbols(t()), "").alias("unknown")),
        "encode_ids": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(vocab.encode(t()), " ").alias("ids")),
        "decode_ids": lambda s, d: read(s, d, "benchmark").select("item_id", vocab.decode(F.concat(vocab.encode(t()), F.array(F.lit(250)))).alias("text")),
        "tag_strip": lambda s, d: read(s, d, "pages").select("page_id", F.md5(vocab.strip_tags(F.col("html")).cast("binary")).alias("digest")),
        "char_replacements": doc(ipatext.replace_characters), "punct_spacing": doc(ipatext.tighten_punctuation), "quote_collapse": doc(ipatext.collapse_quotes),
        "affricate_fold": doc(ipatext.fold_affricates), "terminal_dot": doc(ipatext.close_sentence),
        "tokens_by_kind": lambda s, d: tokens.exploded(read(s, d, "documents"), "lang", "text").groupBy("lang", "kind").agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars")),
        "token_offsets": offsets, "neighbours": neighbours, "punct_runs": punct_runs,
        "latin_runs": latin_runs,
        "lexicon_majority": lambda s, d: lexicon.majority(words_of(s, d), "word", "stress", "seen"), "suffix_majority": suffix_majority, "context_majority": context_majority, "homograph_candidates": candidates,
        "number_words": order(lambda: numbers.number_words(F.col("o_orderkey") * 7919)), "number_words_feminine": lambda s, d: read(s, d, "part").select("p_partkey", numbers.number_words(F.col("p_size"), True).alias("words"), numbers.plural(F.col("p_size"), "процент", "процента", "процентов").alias("form")),
        "year_ordinals": order(lambda: numbers.expand_numbers(year_text("o_orderdate"))),
        "date_ordinals": lambda s, d: read(s, d, "lineitem").select(F.dayofmonth("l_shipdate").alias("day")).distinct().select("day", numbers.expand_numbers(F.concat(F.col("day").cast("string"), F.lit(" мая"))).alias("words")),
        "decimal_words": lambda s, d: read(s, d, "lineitem").select(F.format_string("%.2f", "l_discount").alias("number")).distinct().select("number", numbers.expand_numbers(F.col("number")).alias("words")),
        "percent_and_signs": lambda s, d: read(s, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct().select("q", numbers.expand_numbers(numbers.expand_signs(F.concat(F.col("q").cast("string"), F.lit(" % & 3$")))).alias("words")),
        "softmax_argmax": softmax_argmax, "subword_mean": subword_mean, "gold_scoring": gold, "tier_cascade": tier_cascade,
        "word_to_ipa_fixture": lambda s, d: phones.once_per_word(s.createDataFrame([(w,) for w, _ in FIXTURES], "word string"), "word").select("word", "ipa", phones.stress_number(F.col("ipa")).alias("vowel")),
        "aligned_override": lambda s, d: s.createDataFrame([r[:3] for r in OVERRIDDEN], "source string, ipa string, accented string").select("source", "accented", ipatext.apply_overrides(F.col("source"), F.col("ipa"), F.col("accented")).alias("out")),
        "remap_ipa": lambda s, d: s.createDataFrame([r[:1] for r in REMAPPED], "ipa string").select("ipa", ipatext.remap_legacy(F.col("ipa")).alias("out")),
        "yo_mark": lambda s, d: s.createDataFrame([r[:1] for r in MARKED], "word string").select("word", ipatext.mark_yo(F.col("word")).alias("out")),
        "phonemize_years": phonemize_years, "tier_report": tier_report, "phonemize_numbers": phonemize_numbers, "phonemize_lines": phonemize_lines, "lexicon_build": lexicon_build,
    }


# Number words of the SQL side, written out once more so that a wrong one in the library shows
SMALL = "три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
SCALES = [("миллиард", "миллиарда", "миллиардов"), ("миллион", "миллиона", "миллионов"), ("тысяча", "тысячи", "тысяч")]


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _sql_group(n: str, feminine: bool) -> str:
    unit = f"CASE WHEN ({n}) % 100 < 20 THEN ({n}) % 100 ELSE ({n}) % 10 END"
    small = ["", *(["одна", "две"] if feminine else ["один", "два"]), *SMALL]
    return f"nullif({_sql_list(HUNDREDS)}[({n}) // 100 + 1], ''), CASE WHEN ({n}) % 100 >= 20 THEN {_sql_list(TENS)}[({n}) % 100 // 10 + 1] END, nullif({_sql_list(small)}[({unit}) + 1], '')"


def _sql_plural(n: str, forms) -> str:
    return f"CASE WHEN ({n}) % 10 = 1 AND ({n}) % 100 <> 11 THEN '{forms[0]}' WHEN ({n}) % 10 BETWEEN 2 AND 4 AND ({n}) % 100 NOT BETWEEN 12 AND 14 THEN '{forms[1]}' ELSE '{forms[2]}' END"


def sql_number(n: str, feminine: bool = False) -> str:
    parts = []
    for k, forms in enumerate(SCALES):
        g = f"({n}) // {1000 ** (3 - k)} % 1000"
        said = _sql_group(g, k == 2)
        if k == 2:
            said = f"CASE WHEN ({g}) <> 1 THEN nullif(concat_ws(' ', {said}), '') END"
        parts += [said, f"CASE WHEN ({g}) > 0 THEN {_sql_plural(g, forms)} END"]
    return f"CASE WHEN ({n}) = 0 THEN 'ноль' ELSE concat_ws(' ', {', '.join(parts)}, {_sql_group(f'({n}) % 1000', feminine)}) END"


def _sql_ordinal(words: str, case: int) -> str:
    cases = " ".join(f"WHEN last = '{w}' THEN '{stem}{numbers.SOFT[case] if stem == 'трет' else 'ой' if case == 0 and stem in numbers.STRESSED else numbers.HARD[case]}'" for w, stem in numbers.STEMS.items())
    return f"(SELECT CASE WHEN w = 'две тысячи' THEN 'двухтысячн{numbers.HARD[case]}' ELSE left(w, length(w) - length(last)) || (CASE {cases} ELSE last END) END FROM (SELECT w, regexp_extract(w, '[^ ]+$') AS last FROM (SELECT {words} AS w)))"


TOK = r"""t AS (SELECT *, CASE WHEN left(tok, 1) IN ('.', ',', '!', '?', ':', ';', '…') THEN 'punct' WHEN regexp_matches(tok, '^[a-z]') THEN 'latin' ELSE 'cyrillic' END AS kind FROM (
  SELECT doc_id, lang, unnest(range(len(x))) AS pos, lower(unnest(x)) AS tok FROM (SELECT doc_id, lang, regexp_extract_all(text, '(?i)[а-яё]+|[a-z]+(?:''[a-z]+)?|[.,!?:;…]+') AS x FROM documents)))"""
WORDS = TOK + ", words AS (SELECT doc_id, pos, tok AS word, (doc_id, pos) AS seen, length(regexp_extract(tok, '^[^aeiou]*')) AS stress FROM t WHERE kind = 'latin')"


def _sql_majority(source: str, key: str, support: int, share: float) -> str:
    return f""", c AS (SELECT {key}, stress, count(*) AS n, min(seen) AS first FROM {source} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY {key}) AS total FROM c)
SELECT {key}, stress, n, total::BIGINT AS total FROM r WHERE rn = 1 AND total >= {support} AND n / total >= {share}"""


def oracle_sql() -> dict[str, str]:
    q = vocab.SYMBOLS.replace("'", "''")
    doc = lambda e: f"SELECT doc_id, md5({e}) AS digest FROM documents"
    rows = lambda data, names: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else chr(39) + v + chr(39) if isinstance(v, str) else str(v) for v in r) + ')' for r in data)}) AS v({names})"
    spaced = "text"
    for mark in ",.!?;:":
        spaced = f"replace({spaced}, ' {mark}', '{mark}')"
    spaced = f"replace({spaced}, ' ''', '''')"
    plain = "".join(ipatext.REPLACED).replace("'", "''")
    put = "".join(ipatext.REPLACED.values()).replace("'", "''")
    folded = "text"
    for a, b in [("t[͜͡]s", "ʦ"), ("t[͜͡]?ʃ", "ʧ"), ("d[͜͡]?ʒ", "ʤ"), ("d[͜͡]?z", "ʣ")]:
        folded = f"regexp_replace({folded}, '{a}', '{b}', 'gi')"
    folded = f"regexp_replace({folded}, 'ts([^\\p{{L}}\\p{{N}}_]|$)', 'ʦ\\1', 'gi')"
    closing = ipatext.CLOSING.replace("'", "''")
    chars = "list_filter(string_split(regexp_replace(text, '</?[\\p{L}\\p{N}_]+>', '', 'g'), ''), lambda c: c <> '')"
    say = lambda words: f"list_transform(string_split({words}, ' '), lambda w: sounds[w])"
    sounds = lambda held: "MAP {" + ", ".join(f"'{w}': '{v}'" for w, v in held.items()) + "}"
    spoken = sounds({w: ipa for w, (_, ipa) in NUMBER_SOUNDS.items()})
    places = sounds({w: str(k) for w, (k, _) in NUMBER_SOUNDS.items() if k is not None})
    in_year = sounds({w: ipa for w, (_, ipa) in YEAR_SOUNDS.items()})
    in_tier = sounds({w: tier for w, (tier, _) in YEAR_SOUNDS.items()})
    digit_ids = f"array_to_string(list_transform(list_filter(string_split(ipa, ''), lambda c: c <> ''), lambda c: greatest(strpos('{q}', c) - 1, 0)), ' ')"
    train = f"""x AS (SELECT o_orderkey AS row, string_split({sql_number('o_orderkey * 7919')}, ' ') AS ws FROM orders),
u AS (SELECT row, unnest(range(len(ws))) AS pos, unnest(ws) AS word, unnest(list_concat(['<s>'], ws[:-2])) AS prev, unnest(list_concat(ws[2:], ['</s>'])) AS next FROM x),
k AS (SELECT *, CAST(({places})[word] AS INT) AS stress FROM u WHERE ({places})[word] IS NOT NULL),
h AS (SELECT row, pos, stress, 'p|' || prev || '|' || word AS key FROM k WHERE word IN ('двадцать', 'сорок', 'триста') UNION ALL SELECT row, pos, stress, 'n|' || word || '|' || next FROM k WHERE word IN ('двадцать', 'сорок', 'триста'))"""
    day = _sql_ordinal(sql_number("day"), 5)
    year = _sql_ordinal(sql_number("year(o_orderdate)"), 3)
    return {
        "oov_audit": f"SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND strpos('{q}', ch) = 0 GROUP BY 1, 2",
        "oov_distinct_in_order": f"SELECT conv_id, turn, coalesce(string_agg(ch, '' ORDER BY p) FILTER (WHERE ch IS NOT NULL), '') AS unknown FROM (SELECT conv_id, turn, ch, min(p) AS p FROM (SELECT conv_id, turn, CASE WHEN strpos('{q}', ch) = 0 THEN ch END AS ch, p FROM (SELECT conv_id, turn, unnest(x) AS ch, unnest(range(len(x))) AS p FROM (SELECT conv_id, turn, {chars} AS x FROM conversations))) GROUP BY ALL) GROUP BY 1, 2",
        "encode_ids": f"SELECT item_id, array_to_string(list_transform({chars}, lambda c: greatest(strpos('{q}', c) - 1, 0)), ' ') AS ids FROM benchmark",
        "decode_ids": f"SELECT item_id, array_to_string(list_transform({chars}, lambda c: CASE WHEN strpos('{q}', c) = 0 THEN '_' ELSE c END), '') || '?' AS text FROM benchmark",
        "tag_strip": r"SELECT page_id, md5(regexp_replace(html, '</?[\p{L}\p{N}_]+>', '', 'g')) AS digest FROM pages",
        "char_replacements": doc(f"translate(regexp_replace(text, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F1E6}}-\\x{{1F1FF}}♥☆♡©]', '', 'g'), '{plain}', '{put}')"), "punct_spacing": doc(spaced),
        "quote_collapse": doc("regexp_replace(regexp_replace(text, '\"{2,}', '\"', 'g'), '''{2,}', '''', 'g')"), "affricate_fold": doc(folded),
        "terminal_dot": doc(f"CASE WHEN length(text) > 0 AND strpos('{closing}', right(text, 1)) > 0 THEN text ELSE text || '.' END"),
        "tokens_by_kind": f"WITH {TOK} SELECT lang, kind, count(*) AS n, sum(length(tok))::BIGINT AS chars FROM t GROUP BY 1, 2",
        "token_offsets": f"WITH {TOK}, o AS (SELECT doc_id, sum(length(tok) + CASE WHEN kind <> 'punct' AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - length(tok) AS o FROM t) SELECT doc_id, count(*) AS n_tokens, max(o)::BIGINT AS last_offset, sum(o)::BIGINT AS sum_offset FROM o GROUP BY 1",
        "neighbours": f"WITH {TOK}, o AS (SELECT doc_id, lag(tok) OVER w AS p, lead(tok) OVER w AS n FROM t WHERE kind <> 'punct' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(*) AS n_words, sum(length(p))::BIGINT AS prev_chars, sum(length(n))::BIGINT AS next_chars, count(*) FILTER (WHERE p = n) AS n_same FROM o GROUP BY 1",
        "punct_runs": f"WITH {TOK}, p AS (SELECT tok AS run, regexp_replace(tok, '…', '', 'g') AS k FROM t WHERE kind = 'punct') SELECT run, CASE WHEN left(k, 1) IN ('?', '!') AND len(list_distinct(string_split(k, ''))) > 1 THEN k ELSE left(k, 1) END AS mark, count(*) AS n FROM p GROUP BY 1, 2",
        "latin_runs": f"WITH {TOK}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM t WHERE kind = 'latin') SELECT doc_id, min(pos) AS first, count(*) AS words, (sum(length(tok)) + count(*) - 1)::BIGINT AS chars FROM i GROUP BY doc_id, g",
        "lexicon_majority": f"WITH {WORDS}" + _sql_majority("words", "word", 1, 0),
        "suffix_majority": f"WITH {WORDS}, s AS (SELECT seen, stress, right(word, k) AS suffix FROM words, (VALUES (3), (4), (5), (6)) AS v(k) WHERE length(word) > k)" + _sql_majority("s", "suffix", 5, 0.6),
        "context_majority": f"WITH {WORDS}, n AS (SELECT *, lag(word, 1, '<s>') OVER w AS p, lead(word, 1, '</s>') OVER w AS q FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), s AS (SELECT seen, stress, 'p|' || p || '|' || word AS context FROM n UNION ALL SELECT seen, stress, 'n|' || word || '|' || q FROM n)" + _sql_majority("s", "context", 2, 0.8),
        "homograph_candidates": "SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, first) AS candidates FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1",
        "number_words": f"SELECT o_orderkey, {sql_number('o_orderkey * 7919')} AS words FROM orders",
        "number_words_feminine": f"SELECT p_partkey, {sql_number('p_size', True)} AS words, {_sql_plural('p_size', ('процент', 'процента', 'процентов'))} AS form FROM part",
        "year_ordinals": f"SELECT o_orderkey, 'В ' || {year} || ' году' AS words FROM orders",
        "date_ordinals": f"SELECT day, {day} || ' мая' AS words FROM (SELECT DISTINCT day(l_shipdate)::INT AS day FROM lineitem)",
        "decimal_words": f"SELECT number, concat_ws(' ', {sql_number('a', True)}, {_sql_plural('a', ('целая', 'целых', 'целых'))}, {sql_number('b', True)}, {_sql_plural('b', ('сотая', 'сотых', 'сотых'))}) AS words FROM (SELECT number, split_part(number, '.', 1)::BIGINT AS a, split_part(number, '.', 2)::BIGINT AS b FROM (SELECT DISTINCT printf('%.2f', l_discount) AS number FROM lineitem))",
        "percent_and_signs": f"SELECT q, CASE WHEN {_sql_plural('q', ('a', 'b', 'c'))} = 'b' THEN {sql_number('q', True)} ELSE {sql_number('q')} END || ' ' || {_sql_plural('q', ('процент', 'процента', 'процентов'))} || '  и  три долларов ' AS words FROM (SELECT DISTINCT l_quantity::INT AS q FROM lineitem)",
        "softmax_argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 5) AS p FROM embeddings",
        "subword_mean": "SELECT label, dim::INT AS dim, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2",
        "gold_scoring": f"SELECT word, said = gold AS exact, round(levenshtein(said, gold) / length(gold), 6) AS per FROM ({rows([(w, i, i if k % 3 else i + 'x') for k, (w, i) in enumerate(FIXTURES)], 'word, gold, said')})",
        "tier_cascade": rows([(w, n, a, t) for w, n, a, t in CASCADE], "tok, next, accented, tier"),
        "phonemize_numbers": f"SELECT o_orderkey, text, array_to_string(list_transform(string_split(text, ' '), lambda w: ({spoken})[w]), ' ') || '.' AS ipa FROM (SELECT o_orderkey, {sql_number('o_orderkey * 7919')} AS text FROM orders)",
        "phonemize_lines": f"SELECT l_orderkey, count(*) AS n, md5(string_agg(ipa, '|' ORDER BY ipa)) AS digest FROM (SELECT l_orderkey, array_to_string(list_transform(string_split(a, ' '), lambda w: ({spoken})[w]), ' ') || ' i ok, ' || array_to_string(list_transform(string_split(b, ' '), lambda w: ({spoken})[w]), ' ') || ' plʲus ' || array_to_string(list_transform(string_split(c, ' '), lambda w: ({spoken})[w]), ' ') || '?!' AS ipa FROM (SELECT l_orderkey, {sql_number('l_quantity::INT')} AS a, {sql_number('l_partkey')} AS b, {sql_number('l_suppkey')} AS c FROM lineitem)) GROUP BY 1",
        "lexicon_build": f"""WITH {train},
t AS (SELECT word, stress, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT key, stress, count(*) AS n FROM h GROUP BY 1, 2)
SELECT 'train' AS part, word AS key, stress::VARCHAR AS value FROM t
UNION ALL SELECT 'context', key, any_value(stress)::VARCHAR FROM c GROUP BY key HAVING sum(n) >= 2 AND count(*) = 1
UNION ALL SELECT * FROM (VALUES ('homograph', 'двадцать', '0,1'), ('homograph', 'триста', '0,1'), ('accent', 'тысяча', '0'), ('accent', 'тысячи', '0'), ('accent', 'миллион', '2'), ('accent', 'двести', '0'), ('yo', 'елка', 'ёлка'))""",
        "phonemize_years": f"SELECT o_orderkey, text, ipa, {digit_ids} AS ids FROM (SELECT o_orderkey, 'В ' || year(o_orderdate) || ' году он стал.' AS text, array_to_string(list_transform(string_split(lower('В ' || {year} || ' году он стал'), ' '), lambda w: ({in_year})[w]), ' ') || '.' AS ipa FROM orders)",
        "tier_report": f"SELECT ({in_tier})[w] AS tier, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT unnest(string_split(lower('В ' || {year} || ' году он стал'), ' ')) AS w FROM orders) GROUP BY 1",
        "word_to_ipa_fixture": rows([(w, i, phones.stressed_vowel(i)) for w, i in FIXTURES], "word, ipa, vowel"),
        "aligned_override": rows([(a, c, o) for a, _, c, o in OVERRIDDEN], "source, accented, out"), "remap_ipa": rows([(a.replace("'", "''"), b) for a, b in REMAPPED], "ipa, out"), "yo_mark": rows(MARKED, "word, out"),
    }

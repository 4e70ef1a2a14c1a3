"""Personal data by patterns, and the terms that disclose it by their information content.

Base spans are found by pattern; so are secrets, an added kind. A protected entity is the value of such a span. Its context
is the passage that it stands in with the passages on both sides: texts are cut into passages of PASSAGE code points, so most
texts are one context, and long ones don't pair each entity with each word. Over the whole corpus the information that a
term t gives about an entity e is PMI(e; t) = log2(p(e|t) / p(e)), with p(e|t) the share of the texts holding t in which t
stands in a context of e. It is measured against IC(e) = -log2 p(e): a term whose share of it reaches `remove` is removed,
one that reaches `generalise` is replaced by a general term, in every text, whether the entity stands there or not.

Copies are no evidence: contexts whose terms are alike, found by the bands of a MinHash signature, are one class, and a term
needs SUPPORT classes beside an entity. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import cut, let, sized
from phonoframe.llm.graph import connected_components

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the patterns: they match the same, in time linear in the text
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CHEAP = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}  # what a text with a match holds
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+"  # kept with a letter, a digit and 8 different characters
WORD = r"[\p{L}]+"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
PASSAGE = 1000  # code points
SUPPORT = 2  # classes of contexts in which a term must stand beside an entity
REMOVE, GENERALISE = 0.95, 0.9  # shares of an entity's information beyond which a term is removed or generalised
SAME = 0.4  # Jaccard similarity of the terms of contexts that are one class
BANDS, WIDTH = 24, 3  # contexts whose terms have a Jaccard similarity of 0.5 share a band with a chance of 0.96
BROADCAST_ROWS = 200_000  # rows of two longs up to which a side is broadcast
BLOCK = 64


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the check sum."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8)
    d = _digits(v)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.length(d).between(16, 19) & luhn(d)


def running(sizes: Column) -> Column:
    """Running sums of an array of ints; block by block, so that time isn't the square of its length."""
    zero = F.array(F.lit(0)).cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.aggregate(F.slice(sizes, b + 1, F.lit(BLOCK)), zero, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))))

    def placed(bs: Column) -> Column:
        before = F.aggregate(bs, zero, lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + F.element_at(b, -1))))
        return let(before, lambda o: F.flatten(F.transform(bs, lambda b, i: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda y: y + F.get(o, i)))))

    return let(blocks, placed)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Every leftmost non-overlapping match, with its place in code points."""

    def measured(values: Column) -> Column:
        sizes = F.zip_with(values, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), lambda v, g: F.length(v) + F.length(g))
        return F.zip_with(values, let(sizes, running), lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def _spans_of(text: Column, kind: str, pattern: str, cheap: str) -> Column:
    none = F.array().cast(SPANS)
    there = text.contains(cheap) if cheap == "@" else text.rlike(cheap)
    return F.when(there, F.filter(matches(text, pattern, kind), lambda s: _valid(kind, s["value"])).cast(SPANS)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<kind string, start int, end int, value string>> by kind as in KINDS, then start; ends are exclusive."""
    return F.concat(*[_spans_of(text, kind, PATTERNS[kind], CHEAP[kind]) for kind in KINDS])


def secrets(text: Column) -> Column:
    """Runs that hold too much information for a word."""
    return _spans_of(text, "secret", SECRET, "[A-Za-z0-9]{16}")


def term_hashes(text: Column) -> Column:
    """Hashes of the different lower-cased words of three letters or more."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3), lambda w: F.xxhash64(w)))


def _contexts(text: Column, spans: Column) -> Column:
    """A passage that holds entities each: their hashes, and those of the terms of its context without the entities' own words."""

    def one(p: Column) -> Column:
        at = F.greatest(p - 1, F.lit(0)) * PASSAGE
        inside = F.filter(spans, lambda s: F.floor(s["start"] / PASSAGE) == p)
        around = F.filter(spans, lambda s: F.floor(s["start"] / PASSAGE).between(p - 1, p + 1))
        side = F.substring(text, at + 1, (p + 2) * PASSAGE - at)
        return F.struct(
            F.array_distinct(F.transform(inside, lambda s: F.xxhash64(s["kind"], s["value"]))).alias("entities"),
            F.array_except(term_hashes(side), F.flatten(F.transform(around, lambda s: term_hashes(s["value"])))).alias("terms"),
        )

    return F.transform(F.array_distinct(F.transform(spans, lambda s: F.floor(s["start"] / PASSAGE).cast("int"))), one)


def _seeded(k: int):
    return lambda x: F.xxhash64(x, F.lit(k))


def _classes(contexts: DataFrame) -> DataFrame:
    """(context, class) of (context, terms), rows that repeat a context being one: contexts that share a band of their
    signature with the least one there, and enough of their terms, are of one class."""
    least = [F.array_min(F.transform("terms", _seeded(k))) for k in range(BANDS * WIDTH)]
    bands = F.array(*[F.xxhash64(F.lit(b), *least[b * WIDTH : (b + 1) * WIDTH]) for b in range(BANDS)])
    contexts = cut(contexts.dropDuplicates(["context"]))
    rows = cut(contexts.select("context", F.explode(bands).alias("band")))
    first = rows.groupBy("band").agg(F.min("context").alias("least"))
    pairs = rows.join(first, "band").where("context <> least").select("context", "least").distinct()
    pairs = pairs.join(contexts, "context").join(contexts.select(F.col("context").alias("least"), F.col("terms").alias("others")), "least")
    both, union = F.size(F.array_intersect("terms", "others")), F.size(F.array_union("terms", "others"))
    edges = pairs.where(both >= union * SAME).select(F.col("context").alias("src"), F.col("least").alias("dst"))
    linked = connected_components(edges)
    return contexts.join(linked, F.col("context") == F.col("node"), "left").select("context", F.coalesce("component", "context").alias("class"))


def disclosing(spotted: DataFrame, rows: DataFrame, remove: float, generalise: float) -> DataFrame | None:
    """(row, told array<struct<term long, kind string>>): the disclosing terms of each text that holds any; None: there are none.

    spotted: (uid, contexts), computed already, uid being unique; rows: (row, text).
    """
    each = spotted.where("size(contexts) > 0").select("uid", F.explode("contexts").alias("c")).select("uid", F.xxhash64(F.array_sort("c.terms")).alias("context"), "c.entities", "c.terms")
    owned = each.select("uid", F.explode("entities").alias("entity")).distinct()
    often = cut(owned.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT))  # one text gives no more than one class
    beside = each.select("uid", "context", "terms", F.explode("entities").alias("entity")).join(sized(often, BROADCAST_ROWS), "entity")
    beside = cut(beside.select("uid", "context", "entity", "n_entity", "terms"))
    if beside.isEmpty():
        return None
    classes = cut(_classes(beside.select("context", "terms")))
    several = beside.select("entity", "context").distinct().join(classes, "context").groupBy("entity").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("entity")
    several = cut(several)  # the others can't reach the support
    pairs = beside.join(sized(several, BROADCAST_ROWS), "entity", "left_semi").join(sized(classes, BROADCAST_ROWS), "context")
    pairs = pairs.select("entity", "n_entity", "class", "uid", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term", "class").agg(F.count("*").alias("n"), F.max("n_entity").alias("n_entity"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"), F.max("n_entity").alias("n_entity"))
    pairs = cut(pairs.where(F.col("support") >= SUPPORT))
    terms = cut(pairs.select("term").distinct())
    if terms.isEmpty():
        return None
    each_term = rows.select("row", F.explode(term_hashes(F.col("text"))).alias("term"))
    counts = each_term.join(sized(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    information = -F.log2(F.col("n_entity") / F.lit(float(rows.count())))
    # a text that stands in two classes counts twice in n_both, and no share is above 1
    share = 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / information
    told = pairs.join(counts, "term").where(information > 0).withColumn("share", share).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise)
    told = cut(told.select("term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind")))
    if told.isEmpty():
        return None
    return each_term.join(sized(told, BROADCAST_ROWS), "term").groupBy("row").agg(F.collect_set(F.struct("term", "kind")).alias("told"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(row, doc_id, base, added): a row per input row.

    row: a hash of id and text. base and added: array<struct<kind string, start int, end int, value string>>, places in code
    points, ends exclusive; base by kind as in KINDS, then start; added: secrets, then terms to generalise, then to remove,
    each by start. Null texts are empty. Repeated rows count in the statistics and are found alike; null ids
    are kept. Ties of a share go to the stronger measure. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    found = rows.withColumn("base", base_spans(F.col("text"))).withColumn("secrets", secrets(F.col("text")))
    found = found.withColumn("contexts", let(F.concat("base", "secrets"), lambda s: _contexts(F.col("text"), s)))
    spotted = cut(found.select(F.monotonically_increasing_id().alias("uid"), "row", "doc_id", "base", "secrets", "contexts"))
    told = disclosing(spotted.select("uid", "contexts"), rows.select("row", "text"), remove, generalise)
    if told is None:
        return spotted.select("row", "doc_id", "base", F.col("secrets").alias("added"))
    told = cut(told)
    texts = rows.select("row", "text").join(sized(told, BROADCAST_ROWS // 16), "row").dropDuplicates(["row"])

    def marked(m: Column) -> Column:
        words = F.transform(matches(F.col("text"), WORD, "word"), lambda w: F.struct(F.try_element_at(m, F.xxhash64(F.lower(w["value"]))).alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value")))
        return F.array_sort(F.filter(words, lambda s: s["kind"].isNotNull()))

    marks = texts.select("row", let(F.map_from_entries("told"), marked).alias("marks"))
    both = spotted.join(marks, "row", "left")
    clear = F.filter(F.coalesce("marks", F.array().cast(SPANS)), lambda m: ~F.exists(F.concat("base", "secrets"), lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"])))
    return both.select("row", "doc_id", "base", F.concat("secrets", clear.cast(SPANS)).alias("added"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(doc_id, text), a row per input row: entities are replaced by their kind in brackets, generalised terms by [name] where
    they begin with a capital letter and by [word] elsewhere, and removed terms by nothing. Null texts stay null. Of spans
    that overlap, the one that begins first counts, the longer one at a tie."""
    found = find(docs, id_col, text_col, remove, generalise).where("size(base) + size(added) > 0").select("row", F.concat("base", "added").alias("spans"))
    found = cut(found.dropDuplicates(["row"]))
    lost = docs.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    joined = keyed(docs.where(F.col(text_col).isNotNull()), id_col, text_col).join(found, "row", "left")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["value"].alias("value"))))
    put = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] != "generalise", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"].rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        piece = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), put(x))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["last"]).alias("at"), piece.alias("out")))

    whole = F.aggregate(order, state, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return joined.select("doc_id", F.coalesce(whole, "text").alias("text")).union(lost)


def digest(found: DataFrame) -> DataFrame:
    """A row per row of find's result: counts of the base spans, their hash, all spans as text, and the number of all spans.
    Without spans the hash is that of the empty string, and the text is empty."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    rows = found.select("doc_id", *counts, joined("base").alias("b"), joined("added").alias("a"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("b"), 256).alias("base_sha256"), F.concat_ws(",", F.expr("nullif(b, '')"), F.expr("nullif(a, '')")).alias("spans"), "n_spans")


def _is(kind: str):
    return lambda s: s["kind"] == kind

"""Soft-membership mixing: document rates whose expected token totals by domain match target weights.

A Bernoulli naive Bayes classifier, trained on a labelled table, gives every document posteriors over the domains. Rates
r >= 0 are then fitted by projected gradient descent on the weighted least squares sum_k (S_k - T_k)^2 / N_k, where
S_k = sum_d r_d * tokens_d * p_dk is a domain's expected total, T_k its target, N_k its total at rate 1. A step's gradient
needs the K totals only, so a round is one aggregate over the documents, and a document's rate after any number of rounds
is an expression of its own posteriors and the rounds' K numbers. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import bounded_sample, cut, free_name

TRAIN_ROWS = 6000  # labelled documents that the classifier is fitted on, at most
VOCABULARY = 48  # the classifier's features: the tokens that tell most about the domain
ROUNDS = 25  # rounds of descent, at most
BROADCAST_ROWS = 200_000  # rows of a long and an int up to which a side is broadcast
CLOSE = 1e-4  # share of the total by which no domain may miss its target for the descent to stop


def tokens(text: Column) -> Column:
    """Lower-cased words, and runs of symbols as tokens of their own."""
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}\s.,]+)", " $1 ")
    return F.split(spaced, r"[\s.,]+")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> tuple[list[int], dict[int, float], dict[str, dict[int, float]]]:
    """(domains, log prior and absent weight of each, weight of each vocabulary token by domain)."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    known = cut(bounded_sample(known.groupBy("__id").agg(F.min("__y").alias("__y")), rows, F.col("__id")))
    some = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "__id")
    some = cut(some.select("__y", F.array_distinct(tokens(F.col("text"))).alias("w")))
    size = {r["__y"]: r["n"] for r in some.groupBy("__y").agg(F.count("*").alias("n")).collect()}  # a row per domain
    domains = sorted(size)
    if len(domains) < 2:
        return domains, dict.fromkeys(domains, 0.0), {}
    total = sum(size.values())
    counts = some.select("__y", F.explode("w").alias("w")).where("w <> ''").groupBy("w").agg(*[F.count(F.when(F.col("__y") == k, 1)).alias(f"n{k}") for k in domains])
    gain = F.lit(0.0)
    present = sum((F.col(f"n{k}") for k in domains), F.lit(0))
    for k in domains:  # mutual information of presence and domain
        for n, of in ((F.col(f"n{k}"), present), (size[k] - F.col(f"n{k}"), total - present)):
            gain = gain + F.when(n > 0, n / total * F.log(n * total / (of * size[k]))).otherwise(0.0)
    best = counts.withColumn("gain", gain).orderBy(F.desc("gain"), "w").limit(VOCABULARY).collect()
    rate = {r["w"]: {k: (r[f"n{k}"] + 0.5) / (size[k] + 1) for k in domains} for r in best}
    base = {k: math.log(size[k] / total) + sum(math.log(1 - r[k]) for r in rate.values()) for k in domains}
    return domains, base, {w: {k: math.log(r[k] / (1 - r[k])) for k in domains} for w, r in rate.items()}


def posteriors(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, row_hash, n_tokens, p_<domain> for each domain), and the column to keep as `whole`; null texts have no tokens
    and the prior's posteriors."""
    domains, base, weights = model
    kept = [F.col("whole")] if keep else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *([F.col(keep).alias("whole")] if keep else []))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), tokens(F.col("text")).alias("w"), *kept)
    vocabulary = F.array(*[F.lit(w) for w in weights]) if weights else F.array().cast("array<string>")
    rows = rows.select("doc_id", "row_hash", F.size(F.filter("w", lambda x: x != "")).cast("long").alias("n_tokens"), F.array_intersect("w", vocabulary).alias("seen"), *kept)
    for k in domains:
        table = F.create_map(*[x for w, by in weights.items() for x in (F.lit(w), F.lit(by[k]))]) if weights else F.create_map().cast("map<string,double>")
        rows = rows.withColumn(f"s_{k}", _sum(table, base[k]))
    top = F.greatest(*[F.col(f"s_{k}") for k in domains]) if len(domains) > 1 else F.col(f"s_{domains[0]}")
    rows = rows.withColumn("top", top)
    odds = {k: F.exp(F.col(f"s_{k}") - F.col("top")) for k in domains}
    whole = sum(odds.values(), F.lit(0.0))
    return rows.select("doc_id", "row_hash", "n_tokens", *[(odds[k] / whole).alias(f"p_{k}") for k in domains], *kept)


def _sum(table: Column, start: float) -> Column:
    return F.aggregate("seen", F.lit(start), lambda s, w: s + F.element_at(table, w))


def fit_rates(soft: DataFrame, domains: list[int], targets: dict[int, float], budget: float | None = None) -> tuple[Column, list[dict[int, float]]]:
    """(the rate as an expression over soft's columns, expected totals by domain before each round and after the last)."""
    part = {k: F.col("n_tokens") * F.col(f"p_{k}") for k in domains}
    rate, history = F.lit(1.0), []
    first: dict[int, float] = {}
    for _ in range(ROUNDS + 1):
        got = soft.agg(*[F.sum(rate * part[k]).alias(f"t{k}") for k in domains]).first()
        now = {k: float(got[f"t{k}"] or 0.0) for k in domains}
        history.append(now)
        first = first or now
        whole = budget if budget is not None else sum(first.values())
        share = sum(targets.get(k, 0.0) for k in domains)
        aim = {k: whole * targets.get(k, 0.0) / share if share else 0.0 for k in domains}
        if whole <= 0 or max(abs(now[k] - aim[k]) for k in domains) <= CLOSE * whole or len(history) > ROUNDS:
            break
        # N bounds the curvature: the matrix of sum_d tokens p_j p_k has the row sums N_k, so a unit step never overshoots
        step = sum((F.lit((now[k] - aim[k]) / first[k]) * F.col(f"p_{k}") for k in domains if first[k] > 0), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - step)
    return rate, history


def _model(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str, text_col: str, label_col: str):
    """(classifier, targets); without labels one domain that every document is of."""
    model = train(docs, labels, id_col, text_col, label_col)
    return (model, targets) if model[0] else (([0], {0: 0.0}, {}), {0: 1.0})


def rates(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", budget: float | None = None) -> DataFrame:
    """(doc_id, row_hash, n_tokens, p_<domain>..., rate): a row per input row; equal rows have equal rates.

    targets: weight of each domain, of those that the labels hold; a domain without a target has the target 0. budget: tokens
    to reach in all, by default as many as there are. No labels: every rate is 1. An empty table gives no rows.
    """
    model, targets = _model(docs, labels, targets, id_col, text_col, label_col)
    soft = cut(posteriors(docs, model, id_col, text_col))
    rate, _ = fit_rates(soft, model[0], targets, budget)
    return soft.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", budget: float | None = None) -> DataFrame:
    """docs, each as often as its rate says: the whole part always, the rest with that chance by a hash of id and text.

    No text is shuffled: up to BROADCAST_ROWS rows that go or repeat are broadcast; beyond that each row works out its own rate,
    which is an expression of its own posteriors. Null texts
    have no tokens and the prior's rate; repeated rows have one rate and one chance; no labels: every row once; an empty table
    gives no rows. Columns and names are those of docs.
    """
    model, targets = _model(docs, labels, targets, id_col, text_col, label_col)
    soft = cut(posteriors(docs, model, id_col, text_col))
    rate, _ = fit_rates(soft, model[0], targets, budget)
    chance = F.pmod(F.xxhash64("row_hash", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    name = free_name(docs, "__row")
    few = cut(soft.select(F.col("row_hash").alias(name), F.floor(rate + chance).cast("int").alias(f"{name}_times")).where(F.col(f"{name}_times") != 1).distinct())
    if few.count() <= BROADCAST_ROWS:
        row = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
        joined = docs.withColumn(name, row).join(F.broadcast(few), name, "left").withColumn(f"{name}_times", F.coalesce(f"{name}_times", F.lit(1))).where(F.col(f"{name}_times") > 0)
        return joined.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}_times")))).select([F.col(f"`{c}`") for c in docs.columns])
    whole = posteriors(docs.withColumn(free_name(docs, "__whole"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])), model, id_col, text_col, free_name(docs, "__whole"))
    times = whole.select("whole", F.floor(rate + chance).cast("int").alias("times")).where("times > 0")
    return times.select("whole", F.explode(F.sequence(F.lit(1), F.col("times")))).select("whole.*")

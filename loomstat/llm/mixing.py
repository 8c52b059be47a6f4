"""Mixing towards target domain weights with soft domain membership.

A classifier trained on a labelled table predicts every document's posterior over
domains.  Nonnegative document rates r (how often a document is read) are then
fitted by least squares, so that the expected domain token totals sum_i r_i n_i p_i
match the targets:

    minimise |G^-1/2 (M r - T)|^2  over  r >= floor,   M = [n_i p_i],  G = sum_i n_i p_i p_i'

by projected gradient from r = 1, with momentum.  In this metric the gradient step of
length one from y is r_i <- max(floor, y_i - p_i . h) with h = G^-1 (M y - T), and
y <- r + b (r - previous r): a rate depends on a document's posterior and the steps
(h, b) only.  So an iteration is one aggregation of
domain totals over a compact table (tokens and posteriors), rates are never kept,
and the driver holds a few numbers per domain.

Native: DataFrame expressions and ``pyspark.ml``; no Python runs on executors.

The classifier is multinomial logistic regression on hashed counts of word
endings, fitted on at most ``MAX_FIT`` labelled rows (the first by a hash of the id);
totals, rates and copies cover all rows.

Edge cases: null or empty text has no tokens and the classifier's prior as its
posterior; without labelled rows, or with one domain only, every document belongs to
that one domain; a domain without tokens gets rate steps of 0; repeated rows each
count; ties in the most likely domain go to the first in alphabetical order; targets
that cannot be met are met in the least-squares sense (``Mix.residual`` tells, and a fit that ends at
``MAX_ITERATIONS`` warns); an
empty table gives no rows; extra columns are kept by ``repeat_rows`` and ignored
otherwise.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_rows, materialize, table

BUCKETS = 1 << 13
LETTERS = 3  # 0: whole words, for domains that differ in topic
MAX_FIT = 20_000
MAX_DOMAINS = 32
TEMPERATURE, SLACK = 0.7, 0.01
#: Target shares of the registered query, by language; a domain that is not listed weighs as much as the last one.
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Steps end when every total is this near its target (as a share of all target tokens), or when a step changes the
#: rates by less than ``LEAST_CHANGE`` (root mean square over tokens): the least-squares solution.
MAX_ITERATIONS, TOLERANCE, LEAST_CHANGE = 50, 1e-6, 1e-4


def feature_list(words: Column) -> Column:
    """The words' last ``LETTERS`` letters: they tell languages of words not seen in the fit."""
    return F.transform(words, lambda w: F.substring(w, -LETTERS, LETTERS)) if LETTERS else words


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


@dataclass
class DomainModel:
    """Domains in alphabetical order and the classifier over them (none for a single domain)."""

    domains: list[str]
    model: PipelineModel | None

    def posteriors(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``_n`` (tokens) and ``_p`` (posterior array) to ``df``."""
        df = df.withColumn("_words", word_list(F.col(f"`{text}`"))).withColumn("_n", F.size("_words").cast("long"))
        df = df.withColumn("_features", feature_list(F.col("_words")))
        if self.model is None:
            return df.withColumn("_p", F.array(F.lit(1.0))).drop("_words", "_features")
        out = self.model.transform(df).withColumn("_p", vector_to_array("_prob"))
        return out.drop("_words", "_features", "_tf", "_x", "_raw", "_prob")


def fit_domains(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text",
                limit: int = MAX_FIT) -> DomainModel:
    """Fit the classifier on ``labelled`` (doc_id, domain); at most ``limit`` ids are broadcast and used."""
    ids = labelled.select(F.col("doc_id").alias("_id"), F.col("domain").alias("_domain")).dropna()
    ids = ids.groupBy("_id").agg(F.min("_domain").alias("_domain"))
    ids = materialize(ids.orderBy(F.xxhash64("_id"), "_id").limit(limit), "labelled")
    domains = sorted(r[0] for r in bounded_rows(ids.select("_domain").distinct(), MAX_DOMAINS, "domains"))
    if len(domains) < 2:
        return DomainModel(domains or ["all"], None)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), feature_list(word_list(F.col(f"`{text}`"))).alias("_features"))
    rows = rows.join(F.broadcast(ids), "_id")
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")) - 1
    tf = HashingTF(numFeatures=BUCKETS, inputCol="_features", outputCol="_tf")
    unit = Normalizer(inputCol="_tf", outputCol="_x")
    train = materialize(unit.transform(tf.transform(rows)).select("_x", place.cast("double").alias("_label")), "train")
    if train.select("_label").distinct().count() < 2:
        return DomainModel(domains[:1], None)
    lr = LogisticRegression(featuresCol="_x", labelCol="_label", family="multinomial", regParam=1e-4, maxIter=30,
                            rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="")
    return DomainModel(domains, PipelineModel([tf, unit, lr.fit(train)]))


Step = tuple[np.ndarray, float]


def rate_columns(p: Column, steps: list[Step], floor: float) -> Column:
    """Struct (r, y) of a document with posterior ``p`` after the given gradient steps: its rate, and the point that
    the next step starts from."""
    start = F.lit(max(1.0, floor))
    first = F.struct(start.alias("r"), start.alias("y"))
    if not steps:
        return first
    table_ = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in h]).alias("h"), F.lit(float(b)).alias("b"))
                       for h, b in steps])
    size = len(steps[0][0])

    def step(state: Column, s: Column) -> Column:
        dot = F.lit(0.0)
        for d in range(size):
            dot = dot + p[d] * s["h"][d]
        r = F.greatest(F.lit(float(floor)), state["y"] - dot)
        return F.struct(r.alias("r"), (r + s["b"] * (r - state["r"])).alias("y"))

    return F.aggregate(table_, first, step)


@dataclass
class Mix:
    """Fitted steps; ``totals`` and ``targets`` by domain, and the largest relative distance left."""

    domains: list[str]
    steps: list[Step]
    floor: float
    targets: np.ndarray
    totals: np.ndarray
    residual: float

    def rate(self, p: Column) -> Column:
        return rate_columns(p, self.steps, self.floor)["r"]


def default_targets(totals: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    """Totals flattened by ``temperature`` and scaled up: targets for a mix that repeats documents but drops none (floor 1).

    The domain that grows least keeps its tokens.  Posteriors are not sharp, so raising the other domains raises its
    expected total too, and no rates of at least one would meet its present total: ``SLACK`` leaves room for that."""
    live = totals > 0
    shares = np.where(live, np.maximum(totals, 1e-300) ** temperature, 0.0)
    if not live.any():
        return totals.copy()
    return shares * np.max(totals[live] / shares[live]) * (1 + SLACK)


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None,
              total: float | None = None, floor: float = 0.0) -> Mix:
    """Fit rates on ``members`` (_n, _p).

    ``weights`` are target shares by domain (scaled to ``total`` tokens, by default the
    present total); without them ``default_targets`` apply.
    """
    k = len(domains)
    n, p = F.col("_n"), F.col("_p")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    first = members.agg(*[F.sum(n * p[a]).alias(f"m{a}") for a in range(k)],
                        *[F.sum(n * p[a] * p[b]).alias(f"g{a}_{b}") for a, b in pairs]).first()
    totals = np.array([first[f"m{a}"] or 0.0 for a in range(k)])
    gram = np.zeros((k, k))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = first[f"g{a}_{b}"] or 0.0
    if weights is None:
        targets = default_targets(totals)
    else:
        share = np.array([float(weights.get(d, 0.0)) for d in domains])
        targets = share / max(share.sum(), 1e-300) * (totals.sum() if total is None else total)
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    scale = max(targets.sum(), 1e-300)
    steps: list[Step] = []
    now = ahead = totals * max(1.0, floor)
    residual, pace = float(np.abs(now - targets).max() / scale), 1.0
    while residual >= TOLERANCE and len(steps) < MAX_ITERATIONS:
        next_pace = (1 + math.sqrt(1 + 4 * pace ** 2)) / 2
        steps.append((inverse @ (ahead - targets), (pace - 1) / next_pace))
        pace = next_pace
        rated = members.withColumn("_s", rate_columns(p, steps, floor)).withColumn(
            "_o", rate_columns(p, steps[:-1], floor)["r"])
        r, y = F.col("_s.r"), F.col("_s.y")
        row = rated.agg(*[F.sum(r * n * p[a]) for a in range(k)], *[F.sum(y * n * p[a]) for a in range(k)],
                        F.sqrt(F.try_divide(F.sum(n * F.pow(r - F.col("_o"), 2)), F.sum(n)))).first()
        now, ahead = (np.array([x or 0.0 for x in row[i:i + k]]) for i in (0, k))
        residual = float(np.abs(now - targets).max() / scale)
        if (row[2 * k] or 0.0) < LEAST_CHANGE:
            break
    else:
        if residual >= TOLERANCE:
            warnings.warn(f"mixing rates still moved after {MAX_ITERATIONS} steps; the largest distance left is {residual:.2e} of "
                          "all target tokens", stacklevel=2)
    return Mix(domains, steps, floor, targets, now, residual)


def copies_column(rate: Column, *keys: Column) -> Column:
    """Whole number of copies with the rate as its mean: the fraction is drawn by a hash of the keys."""
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def memberships(docs: DataFrame, model: DomainModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _u, _n, _p) of every row: id, draw, tokens and posterior, written once."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    members = model.posteriors(rows, "_text").withColumn("_u", F.xxhash64("_id", "_text"))
    return materialize(members.select("_id", "_u", "_n", "_p"), "members")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, total: float | None = None,
        floor: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Mix, DomainModel]:
    """(members, fitted mix, model); ``members`` holds _id, _u (draw), _n and _p of every row."""
    model = fit_domains(docs, labelled, doc_id, text)
    members = memberships(docs, model, doc_id, text)
    return members, fit_rates(members, model.domains, weights, total, floor), model


def repeat_rows(docs: DataFrame, fitted: Mix, model: DomainModel, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says; same columns, one map, no join."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at_id, at_text = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    rows = model.posteriors(plain, at_text)
    copies = copies_column(fitted.rate(F.col("_p")), F.xxhash64(at_id, at_text))
    rows = rows.select(*names, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_one"))
    return rows.select(*names).toDF(*docs.columns)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the labelled ids with the language noted for them."""
    known = labels.select("doc_id").dropna().distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).dropna().join(known, "doc_id")


def weights_for(domains: list[str], weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """The weight of each domain; one that is not listed weighs as much as the last listed."""
    rest = list(weights.values())[-1]
    return {d: weights.get(d, rest) for d in domains}


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document towards the target shares ``WEIGHTS`` of the present tokens (floor 0: languages
    above their share shrink); ``target`` and ``total`` are those of the document's most likely language, ``residual`` is
    the largest distance of any total from its target, as a share of all target tokens."""
    docs = table(spark, sf_dir, "documents")
    model = fit_domains(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))
    members = memberships(docs, model)
    fitted = fit_rates(members, model.domains, weights_for(model.domains))
    names, targets, totals = (F.array(*[F.lit(x) for x in c]) for c in (
        fitted.domains, [float(t) for t in fitted.targets], [float(t) for t in fitted.totals]))
    best = F.array_max("_p")
    at = F.array_position(F.col("_p"), best).cast("int")
    rate = fitted.rate(F.col("_p"))
    return members.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_tokens"), F.element_at(names, at).alias("domain"),
        best.alias("posterior"), rate.alias("rate"), copies_column(rate, F.col("_u")).alias("copies"),
        F.element_at(targets, at).alias("target"), F.element_at(totals, at).alias("total"),
        F.lit(fitted.residual).alias("residual"))

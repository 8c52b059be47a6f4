"""Quality classifier: a generalised additive model with pairwise interactions.

A document is ``FEATURES`` numbers about its whole text, each cut into at most ``BINS`` bins at quantiles of the
labelled sample.  The model is an intercept, one lookup table a feature and one table over the bins of each chosen
pair of features; a score is the logistic function of their sum.  Fitting is cyclic boosting: features take turns, each
turn fits a shallow tree (two cuts deep) of Newton steps to the present gradients over the bins of its feature alone,
and adds a ``RATE`` of it to the table.  Then every pair is measured by the gain of its best cross cut (one cut in each
feature), the ``PAIRS`` best pairs get tables, and these take turns in the same way.  Scoring is additions of looked-up
bins over a batch of documents.

The fit uses at most ``MAX_FIT`` labelled rows: the first by a hash of their id.  Their bins are a ``MAX_FIT`` x
``FEATURES`` matrix of bytes on the driver.  Every document is scored; one pass, no shuffle.

Edge cases: a null text is an empty one, whose features are all 0, and is scored like any other; labels that are null or
neither 0 nor 1 are no labels, and an id with both labels counts as 0; a null ``doc_id`` is never held out and never
labelled; each row of a repeated id is scored and, if labelled, learned from; without labelled rows of both classes
every score is the smoothed share of good ones; very long texts are read whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import materialize, table
from loomstat.llm.hyperlang import held_out
from loomstat.llm.kernels import steps, tidy, utf8

FEATURES = ("log_words", "word_chars", "upper", "symbols", "digits", "stops", "distinct_words", "distinct_triples",
            "repeated_lines", "line_words", "longest_word", "short_words", "capitalised", "top_byte", "byte_kinds")
MAX_FIT = 20_000
BINS = 32
RATE, ROUNDS, PAIR_ROUNDS, PAIRS = 0.1, 150, 60, 6
RIDGE, LEAST_WEIGHT = 1.0, 2.0
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _class(members) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


# Byte classes; the columns are upper, symbols, digits, stops, blanks, continuation bytes.
_CLASSES = np.stack([_class(range(0x41, 0x5B)), _class(b"!\"#$%&()*+/<=>@[\\]^_`{|}~"), _class(range(0x30, 0x3A)),
                     _class(b".,;:?"), _class([0x20, *range(0x09, 0x0E)]), _class(range(0x80, 0xC0))], 1)


def features(text: bytes) -> list[float]:
    """The numbers of one text, in the order of ``FEATURES``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.zeros(256, np.int64)
    for at in range(0, len(text), 1 << 22):
        seen += np.bincount(np.frombuffer(text[at: at + (1 << 22)], np.uint8), minlength=256)
    upper, symbols, digits, stops, blanks, inner = (seen @ _CLASSES).tolist()
    chars = max(1, len(text) - inner - blanks)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    lengths = list(map(len, words))
    visible = seen.copy()
    visible[[0x20, *range(0x09, 0x0E)]] = 0
    return [float(np.log1p(n)), chars / n, upper / chars, symbols / chars, digits / chars, stops / chars,
            len(set(words)) / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
            1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(np.log1p(max(lengths))),
            sum(map((4).__gt__, lengths)) / n, sum(map(bytes.istitle, words)) / n,
            float(visible.max()) / (len(text) - blanks), float(np.count_nonzero(seen))]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` holds (feature, feature, table over their bins)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.edges)), np.int64)
        for i, e in enumerate(self.edges):
            out[:, i] = np.searchsorted(e, x[:, i], side="left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            total += t[bins[:, i]]
        for i, j, t in self.pairs:
            total += t[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(self.bins(x)), -500, 500)))


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of all bins but the last: distinct quantiles; a value goes to the first end not below it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _gain(g, h):
    return np.where(h >= LEAST_WEIGHT, g * g / (h + RIDGE), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins left of it) of the best cut of a run of bins; gain 0 when none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton step of every bin, from a tree of cuts over gradient and curvature sums a bin."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def cross_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, Newton steps) of the best cut in four quarters of a table of gradient and curvature sums."""
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)

    def quarters(t):
        c = t.cumsum(0).cumsum(1)
        a, rows, cols, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, rows - a, cols - a, whole - rows - cols + a

    qg, qh = quarters(g), quarters(h)
    gains = sum(np.where(b > 0, a * a / (np.maximum(b, 0) + RIDGE), 0) for a, b in zip(qg, qh))
    gains = gains - g.sum() ** 2 / (h.sum() + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    steps_ = [float(a[i, j] / (max(b[i, j], 0) + RIDGE)) for a, b in zip(qg, qh)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = steps_
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a feature matrix and 0/1 labels."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [bin_edges(c) for c in x.T]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, size in enumerate(sizes):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[:, i], g, size), np.bincount(bins[:, i], h, size))
            model.tables[i] += step
            margin += step[bins[:, i]]

    def sums(i, j, g, h):
        key, shape = bins[:, i] * sizes[j] + bins[:, j], (sizes[i], sizes[j])
        return [np.bincount(key, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    g, h = slopes()
    gains = [(-cross_cut(*sums(i, j, g, h))[0], i, j) for i in range(len(sizes)) for j in range(i)]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * cross_cut(*sums(i, j, *slopes()))[1]
            t += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def labelled_sample(labels: DataFrame, limit: int = MAX_FIT) -> DataFrame:
    """(id, label) of the labelled ids that are not held out; the first ``limit`` by a hash of the id."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    rows = rows.filter("_id IS NOT NULL AND _label IN (0, 1)").filter(~held_out(F.col("_id")))
    return rows.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(limit)


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(0))
        for lo, hi in steps(texts):
            x = feature_matrix(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          limit: int = MAX_FIT) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out: at most ``limit`` ids are broadcast and collected."""
    sample = materialize(labelled_sample(labels, limit), "labelled")
    rows = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    rows = rows.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_label")
    found = rows.mapInArrow(tidy(_feature_task), "label int, x array<double>")
    found = found.orderBy(F.xxhash64("label", "x"), "x", "label").limit(limit).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy(np.float64))


def _score_task(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            for lo, hi in steps(texts):
                score = model.score(feature_matrix(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo),
                     pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(_score_task(model)), SCHEMA)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))

"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector.  An n-gram vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place; a document vector bundles
(adds) its n-gram vectors, and a language's prototype bundles the documents it is
learned from.  A document gets the language whose prototype has the highest cosine
with it.

N-grams are taken over letters in lower case with single gaps between words and at
both ends; letters beyond U+024F share ``SHARED`` hashed vectors, so memory does not
grow with the alphabets met.  Prototypes are sums: each task bundles its documents
and Spark adds the partial sums (languages x ``DIM`` numbers), of which the driver
holds one set for at most ``MAX_LANGS`` languages.

Edge cases: null text, or text without a letter, is ``und`` with score 0, and so is
everything when nothing could be learned; ties go to the first language in
alphabetical order; rows without id or lang are predicted but not learned from;
very long texts are taken whole; repeated rows count again; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_rows, table
from loomstat.llm.kernels import steps, tidy, utf8

DIM, GRAM = 1024, 3
DIRECT, SHARED = 0x250, 1024
SEED = 20
MAX_LANGS = 1_000
_BASE = 2048  # above DIRECT + SHARED
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class Space:
    """Letter symbols and n-gram vectors; both are filled as letters and n-grams are met."""

    ROWS = 40_000

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.letters = (rng.integers(0, 2, (DIRECT + SHARED + 1, DIM), np.int8) * 2 - 1).astype(np.int8)
        self.symbol = np.zeros(0x110000, np.uint16)
        self.known = np.zeros(0x110000, np.bool_)
        self.codes = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIM), np.int8)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbol of each code point; 0 for anything but a letter."""
        if not self.known[points].all():
            for p in np.unique(points[~self.known[points]]):
                c = chr(p).lower()[:1]
                q = ord(c) if c else int(p)
                if chr(p).isalpha():
                    self.symbol[p] = q if q < DIRECT else DIRECT + 1 + (q * 2654435761 >> 7) % SHARED
                self.known[p] = True
        return self.symbol[points]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, n-gram code) of every n-gram with a letter."""
        padded = [f" {t} " for t in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        first = np.zeros(len(points), np.bool_)
        first[np.cumsum(lengths) - lengths] = True
        s = self.symbols(points)
        keep = first | (s > 0)
        keep[1:] |= s[:-1] > 0
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[keep]
        s = s[keep].astype(np.int64)
        code = (s[:-2] * _BASE + s[1:-1]) * _BASE + s[2:]
        inside = (doc[:-2] == doc[2:]) & (code > 0)
        return doc[:-2][inside], code[inside]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers in ``vectors`` of sorted distinct n-gram codes."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > self.ROWS:
                new, self.codes, self.vectors = codes, self.codes[:0], self.vectors[:0]
            a, b, c = new // _BASE ** 2, new // _BASE % _BASE, new % _BASE
            made = np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c]
            at = np.searchsorted(self.codes, new)
            self.codes = np.insert(self.codes, at, new)
            self.vectors = np.insert(self.vectors, at, made, 0)
        return np.searchsorted(self.codes, codes)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIM)
        for lo in range(0, len(codes), 4096):
            rows = self.rows(codes[lo:lo + 4096])
            total += counts[lo:lo + 4096].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def _counted(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) with counts, sorted."""
    key, n = np.unique(doc.astype(np.int64) << 36 | code, return_counts=True)
    return key >> 36, key & ((1 << 36) - 1), n


def _learn_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, sums = Space(), {}
    for batch in batches:
        texts, langs = utf8(batch.column(0)), batch.column(1).to_pylist()
        for lo, hi in steps(texts):
            names = sorted(set(langs[lo:hi]))
            doc, code = space.grams([t.decode("utf-8", "replace") for t in texts[lo:hi]])
            place = {name: i for i, name in enumerate(names)}
            which = np.array([place[x] for x in langs[lo:hi]], np.int64)
            lang, code, n = _counted(which[doc], code)
            for i, name in enumerate(names):
                a, b = np.searchsorted(lang, [i, i + 1])
                if b > a:
                    sums[name] = sums.get(name, 0) + space.bundle(code[a:b], n[a:b])
    for name, v in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v, pa.float64())],
            names=["lang", "at", "v"])


def _predict_task(langs: list[str], prototypes: np.ndarray) -> Callable:
    units = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in batches:
            texts = utf8(batch.column(2))
            for lo, hi in steps(texts):
                doc, code, n = _counted(*space.grams([t.decode("utf-8", "replace") for t in texts[lo:hi]]))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                said, score = ["und"] * (hi - lo), [0.0] * (hi - lo)
                for i in range(hi - lo):
                    a, b = bounds[i], bounds[i + 1]
                    if b > a and langs:
                        v = space.bundle(code[a:b], n[a:b])
                        cos = units @ v / max(float(np.linalg.norm(v)), 1e-12)
                        best = int(np.argmax(cos))
                        said[i], score[i] = langs[best], float(min(1.0, max(0.0, cos[best])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo),
                     pa.array(said, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from the rows of ``docs`` with a lang and a text."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    sums = rows.mapInArrow(tidy(_learn_task), "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = bounded_rows(sums, MAX_LANGS * DIM, "prototypes")
    langs = sorted({r["lang"] for r in found})
    prototypes = np.zeros((len(langs), DIM))
    place = {x: i for i, x in enumerate(langs)}
    for r in found:
        prototypes[place[r["lang"]], r["at"]] = r["v"]
    return langs, prototypes


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(_predict_task(*model)), SCHEMA)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learn from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))))

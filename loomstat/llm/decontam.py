"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``PASSAGE`` words, half overlapping.  Terms are the
benchmark items' own words, without those that stand in more than ``MAX_DF`` of the
passages (each item keeps its ``MIN_TERMS`` rarest words in any case): other words
cannot add to a product with an item.  Passages with at least two terms are the rows
of a TF-IDF matrix (squared idf weights, unit rows).

1. Count document frequencies over all passages.
2. Write the matrix rows (term ids only: a small fraction of the text).
3. Randomised SVD: subspace iterations with A'A, each a pass over the rows in which
   every task adds up its share and Spark sums the shares; the driver holds terms x
   rank numbers, bounded by ``MAX_ITEMS``.
4. Fold passages and items into the latent space and take every pair with cosine at
   least ``MIN_COSINE`` as a candidate - all passages against the items, a stated
   query set that is worked through in blocks of at most ``MAX_ITEMS``.
5. The latent space is an approximation, so candidates also come from an exact count
   that needs no rank, frequency limit or cosine: a stretch with ``need`` of an item's
   n words in order holds at least ``RARE`` of the item's n - need + ``RARE`` rarest
   words, whichever the others are.
6. Check candidates by longest common subsequence against every stretch of the text
   around them: a leak holds ``VERBATIM`` of the item's words in order, or
   ``PARAPHRASE`` of them and most of its answer (an ``answer`` column, else the last words of an item of ``OWN_ANSWER``
   words or more; the tail of a shorter one proves nothing).  An item below ``WHOLE`` words is only found word for word,
   or by ``VERBATIM`` and its answer where it has one; one below ``TINY`` words only as the whole text.  With step 5 the
   result is that of checking every stretch of every text against every item.

Steps 4 to 6 are one map over the documents for each block of items, whose task holds that block alone; nothing is
shuffled.  ``cosine`` is the one of the best passage at the stretch, 0 when none there has two terms.

Edge cases: null or empty texts have no passages; items without words match nothing; an empty benchmark or an empty
table gives no rows; ties between stretches go to the first; repeated rows are each
searched; very long texts are taken whole, in steps; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_rows, materialize, table, unused
from loomstat.llm.kernels import steps, tidy, utf8

PASSAGE, STRIDE = 32, 16
MAX_DF, MIN_TERMS = 0.0002, 6
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 3
MIN_COSINE = 0.15
RARE, PAIRS = 4, 2_000_000
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.55, 0.6
ANSWER_WORDS, OWN_ANSWER, WHOLE, TINY = 5, 12, 8, 3
MAX_ITEMS = 1_000
SEED = 3
_BLOCK = 64
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, cosine double, common double, answer boolean"

# ASCII letters in lower case and digits stay, other ASCII characters part words.
_WORD_BYTES = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def word_ids(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word, -1 for words outside ``vocabulary``."""
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))


def passage_terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, term) of each distinct pair in order, and the number of passages."""
    at = np.flatnonzero(ids >= 0)
    n = max(1, -(-len(ids) // STRIDE) - 1) if len(ids) else 0
    chunk = at // STRIDE
    passage, term = np.concatenate([chunk, chunk - 1]), np.concatenate([ids[at], ids[at]])
    inside = (passage >= 0) & (passage < n)
    key = np.unique(passage[inside] << 32 | term[inside])
    return key >> 32, key & 0xFFFFFFFF, n


def _frequency_task(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                _, term, n = passage_terms(word_ids(words_of(text), vocabulary))
                np.add.at(df, term, 1)
                total += n
        df[-1] = total
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["term", "n"])
    return run


def _rows_task(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in utf8(batch.column(0)):
                passage, term, _ = passage_terms(word_ids(words_of(text), vocabulary))
                if len(term):
                    cut = np.flatnonzero(np.diff(passage)) + 1
                    out += [x.astype(np.int32) for x in np.split(term, cut) if len(x) > 1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["terms"])
    return run


def _unit_rows(sizes: np.ndarray, terms: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows (given by their terms) times ``basis``."""
    first = np.cumsum(sizes) - sizes
    w = weight[terms]
    norm = np.sqrt(np.add.reduceat(w * w, first))
    return np.add.reduceat(w[:, None] * basis[terms], first) / norm[:, None]


def _subspace_task(weight: np.ndarray, basis: np.ndarray):
    """Share of A'A basis, in blocks of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float64)
        for batch in batches:
            lists = batch.column(0)
            for lo in range(0, len(lists), 2000):
                part = lists.slice(lo, 2000)
                terms = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.fromiter((len(x) for x in part), np.int64, len(part))
                if not len(terms):
                    continue
                y = _unit_rows(sizes, terms, weight, basis)
                row = np.repeat(np.arange(len(sizes)), sizes)
                w = weight[terms] / np.sqrt(np.add.reduceat(weight[terms] ** 2, np.cumsum(sizes) - sizes))[row]
                order = np.argsort(terms, kind="stable")
                t = terms[order]
                first = np.flatnonzero(np.diff(t, prepend=-1))
                total[t[first]] += np.add.reduceat(w[order][:, None] * y[row[order]], first)
        blocks = range(0, len(total), _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // _BLOCK for b in blocks], pa.int32()),
             pa.array([total[b:b + _BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "data"])
    return run


def _sum_blocks(group: pa.Table) -> pa.Table:
    data = group.column("data").to_pylist()
    total = np.frombuffer(data[0]).copy()
    for x in data[1:]:
        total += np.frombuffer(x)
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                     "data": pa.array([total.tobytes()], pa.binary())})


def latent_basis(rows: DataFrame, weight: np.ndarray, rank: int = RANK, iterations: int = ITERATIONS) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF rows, by randomised subspace iteration."""
    width = min(rank + OVERSAMPLE, len(weight))
    basis = np.random.default_rng(SEED).standard_normal((len(weight), width))
    image = basis
    for _ in range(iterations):
        basis = np.linalg.qr(image)[0]
        shares = rows.mapInArrow(tidy(_subspace_task(weight, basis)), "block int, data binary")
        image = np.zeros_like(basis)
        for r in shares.groupBy("block").applyInArrow(_sum_blocks, "block int, data binary").collect():
            part = np.frombuffer(r["data"]).reshape(-1, width)
            image[r["block"] * _BLOCK: r["block"] * _BLOCK + len(part)] = part
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return basis @ turn[:, ::-1][:, :min(rank, width)]


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of an item (bit masks of its words' places) and ``words``."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = masks.get(w)
        if hit is not None:
            keep = row & hit
            row = (row + keep | row - keep) & full
    return size - row.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def rule(size: int, answered: bool) -> tuple[int, int]:
    """Words of an item that a stretch must hold in order to be a leak, and how many with its answer."""
    verbatim, paraphrase = (-int(-(share * size - 1e-9) // 1) for share in (VERBATIM, PARAPHRASE))
    if size < WHOLE:
        return size, verbatim if answered else size
    return verbatim, paraphrase if answered else verbatim


class Searcher:
    """Everything a task needs to search texts for one block of items."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], vocabulary: dict[bytes, int],
                 weight: np.ndarray, basis: np.ndarray, frequency: dict[bytes, int]) -> None:
        self.weight, self.basis = weight, basis.astype(np.float32)
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, w, _ in items]
        self.counts = [Counter(w) for w in self.words]
        self.masks = [_masks(w) for w in self.words]
        self.answers = [(len(a), _masks(a)) for _, _, a in items]
        self.rules = [rule(len(w), bool(a)) for _, w, a in items]  # (words for a leak, words with the answer)
        self.tiny: dict[tuple, list[int]] = {}
        for q, w in enumerate(self.words):
            if len(w) < TINY:
                self.tiny.setdefault(tuple(w), []).append(q)
        latent = np.zeros((len(items), basis.shape[1]), np.float32)
        for q, w in enumerate(self.words):
            terms = np.array(sorted({vocabulary[x] for x in w if x in vocabulary}), np.int64)
            if len(terms):
                latent[q] = weight[terms] @ basis[terms]
        self.long = np.array([len(w) >= TINY for w in self.words])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        # Exact count: hits needed of each item's rarest words, and the items of each such word.
        sizes = np.array([len(w) for w in self.words])
        need = np.array([min(r) for r in self.rules])
        self.spans = np.where(need == sizes, sizes, sizes + np.maximum(3, sizes // 4))
        self.hits = np.minimum(RARE, need)
        owners: dict[bytes, list[int]] = {}
        for q, w in enumerate(self.words):
            if sizes[q] < TINY:
                continue
            for x in set(sorted(w, key=lambda x: (frequency[x], x))[:sizes[q] - need[q] + self.hits[q]]):
                owners.setdefault(x, []).append(q)
        self.lookup = {w: t for t, w in enumerate(dict.fromkeys([*vocabulary, *owners]))}
        lists = [owners.get(w, []) for w in self.lookup] + [[]]  # the last one is for number -1
        self.n_owners = np.array([len(x) for x in lists])
        self.first_owner = np.cumsum(self.n_owners) - self.n_owners
        self.owners = np.array([q for x in lists for q in x], np.int64)
        self.kept = np.array([vocabulary.get(w, -1) for w in self.lookup] + [-1], np.int64)

    def _check(self, words: list[bytes], q: int, lo: int, hi: int) -> tuple[float, bool, int, int] | None:
        """(share of the item found in order, answer found, start, length) of the best leak in words lo to hi.

        Every stretch is met: one that starts elsewhere holds no more than one that starts at a word of the item.
        """
        size, span, masks, count = len(self.words[q]), int(self.spans[q]), self.masks[q], self.counts[q]
        alone, answered = self.rules[q]
        lo, need, full = max(0, lo), min(alone, answered), (1 << size) - 1
        region = words[lo:hi]
        own = [(at, w) for at, w in enumerate(region) if w in count]
        if len(own) < need or sum(min(n, count[w]) for w, n in Counter(w for _, w in own).items()) < need:
            return None
        hits = [masks[w] for _, w in own]
        best, end = None, 0
        for i, (at, _) in enumerate(own):
            while end < len(own) and own[end][0] < at + span:
                end += 1
            if end - i < need:
                continue
            row = full
            for hit in hits[i:end]:
                keep = row & hit
                row = (row + keep | row - keep) & full
            found = size - row.bit_count()
            if found < need:
                continue
            stretch = region[at:at + span]
            n, answers = self.answers[q]
            answer = n > 0 and common_subsequence(answers, n, stretch) >= ANSWER * n
            if (found >= alone or answer and found >= answered) and (best is None or found > best[0]):
                best = (found, answer, lo + at, len(stretch))
                if found == size:
                    break
        return None if best is None else (best[0] / size, *best[1:])

    def _counted(self, ids: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, last word + 1) of the places that hold enough of an item's rarest words."""
        gap = int(self.spans.max())
        starts = np.cumsum([0] + [len(x) + gap for x in ids])
        place = [np.flatnonzero(self.n_owners[x]) for x in ids]
        word = np.concatenate([x[at] for x, at in zip(ids, place)])
        place = np.concatenate([at + start for at, start in zip(place, starts)])
        total = np.cumsum(self.n_owners[word])
        lo = 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            back = int(np.searchsorted(place, place[lo] - gap))
            w = word[back:hi]
            n = self.n_owners[w]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = self.owners[np.repeat(self.first_owner[w], n) + within] << 40 | np.repeat(place[back:hi], n)
            key.sort()
            item, at = key >> 40, key & (1 << 40) - 1
            last = np.arange(len(key)) + self.hits[item] - 1
            live = np.flatnonzero(last < len(key))
            last = last[live]
            met = (item[last] == item[live]) & (at[last] - at[live] < self.spans[item[live]])
            first, last, item = at[live[met]], at[last[met]], item[live[met]]
            text = np.searchsorted(starts, first, "right") - 1
            a, b = last - self.spans[item] + 1 - starts[text], first + self.spans[item] - starts[text]
            # Neighbouring places of one text and item are one.
            new = np.ones(len(a), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (a[1:] >= b[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(a)) - 1 if len(a) else heads
            yield from zip(text[heads].tolist(), item[heads].tolist(), a[heads].tolist(), b[tails].tolist())
            lo = hi

    def search(self, texts: list[bytes]) -> list[dict[int, tuple]]:
        """For each text: item number -> (cosine, share, answer, start, length) of its best leak."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        if not texts:
            return out
        words = [words_of(t) for t in texts]
        ids = [word_ids(w, self.lookup) for w in words]
        owner, passages, sizes, terms = ([np.zeros(0, np.int64)] for _ in range(4))
        for i, w in enumerate(words):
            for q in self.tiny.get(tuple(w), []) if len(w) < TINY else []:
                out[i][q] = (0.0, 1.0, False, 0, len(w))
        for i, x in enumerate(ids):
            passage, term, _ = passage_terms(self.kept[x])
            if len(term):
                first = np.flatnonzero(np.diff(passage, prepend=-1))
                size = np.diff(np.append(first, len(passage)))
                live = size > 1
                owner.append(np.full(live.sum(), i))
                passages.append(passage[first][live])
                sizes.append(size[live])
                terms.append(term[np.repeat(live, size)])
        owner, passages, sizes, terms = map(np.concatenate, (owner, passages, sizes, terms))
        edge = np.concatenate([[0], np.cumsum(sizes)])

        def cosines(lo: int, hi: int) -> np.ndarray:
            y = _unit_rows(sizes[lo:hi], terms[edge[lo]:edge[hi]], self.weight, self.basis).astype(np.float32)
            return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12) @ self.latent.T

        for lo in range(0, len(sizes), 4000):
            cosine = cosines(lo, min(lo + 4000, len(sizes)))
            for p, q in np.argwhere((cosine >= MIN_COSINE) & self.long):
                i, at, size = int(owner[lo + p]), int(passages[lo + p]) * STRIDE, len(self.words[q])
                found = self._check(words[i], int(q), at - size, at + PASSAGE + size)
                if found and (q not in out[i] or found[0] > out[i][q][1]):
                    out[i][int(q)] = (float(cosine[p, q]), *found)
        for i, q, a, b in self._counted(ids):
            found = self._check(words[i], q, a, b)
            if found and (q not in out[i] or found[0] > out[i][q][1]):
                start, n = found[2:]
                lo, hi = np.searchsorted(owner, [i, i + 1])
                lo, hi = lo + np.searchsorted(passages[lo:hi] * STRIDE, [start - PASSAGE + 1, start + n])
                out[i][q] = (float(cosines(lo, hi)[:, q].max()) if lo < hi else 0.0, *found)
        return out


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> Iterator[list[tuple]]:
    """Items (id, words, answer words) in blocks of at most ``MAX_ITEMS`` or so, each checked."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"),
                            (F.col(f"`{answer}`") if answer else F.lit(None).cast("string")).alias("a"))
    rows = rows.filter("t IS NOT NULL")
    blocks = -(-rows.count() // MAX_ITEMS)
    for b in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = []
        for r in sorted(bounded_rows(mine, 2 * MAX_ITEMS, "benchmark items of a block"),
                        key=lambda r: (r["i"] is not None, r["i"], r["t"])):
            words = words_of(r["t"].encode())
            own = words_of(r["a"].encode()) if r["a"] else words[-ANSWER_WORDS:] if len(words) >= OWN_ANSWER else []
            if words:
                items.append((r["i"], words, own))
        if items:
            yield items


def searchers(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text") -> Iterator[Searcher]:
    """A fitted ``Searcher`` for each block of benchmark items, one after another."""
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    for items in _item_blocks(benchmark, item_id, item_text, "answer" if "answer" in benchmark.columns else None):
        every: dict[bytes, int] = {}
        for _, words, _ in items:
            for w in words:
                every.setdefault(w, len(every))
        counts = texts.mapInArrow(tidy(_frequency_task(every)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = np.zeros(len(every) + 1, np.int64)
        for r in bounded_rows(counts, len(df), "document frequencies"):
            df[r["term"]] = r["n"]
        passages = df[-1]
        keep = df[:-1] <= MAX_DF * passages
        for _, words, _ in items:
            keep[sorted({every[w] for w in words}, key=lambda t: (df[t], t))[:MIN_TERMS]] = True
        vocabulary = {w: i for i, w in enumerate(w for w, t in every.items() if keep[t])}
        weight = np.log((2 + passages) / (1 + df[:-1][keep])) ** 2
        rows = materialize(texts.mapInArrow(tidy(_rows_task(vocabulary)), "terms array<int>"), "passages")
        yield Searcher(items, vocabulary, weight, latent_basis(rows, weight), {w: int(df[t]) for w, t in every.items()})


def _leaks_of(docs: DataFrame, searcher: Searcher) -> DataFrame:
    """Leaks of one block of items in ``docs`` (doc_id, text): the columns of ``SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = utf8(batch.column(1)), batch.column(0).cast(pa.int64()).to_pylist()
            for lo, hi in steps(raw):
                rows = [(ids[lo + i], searcher.ids[q], a, n, c, share, answer)
                        for i, hits in enumerate(searcher.search(raw[lo:hi]))
                        for q, (c, share, answer, a, n) in sorted(hits.items())]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 names=names)
    return docs.mapInArrow(tidy(run), SCHEMA)


def _n_blocks(benchmark: DataFrame, item_text: str = "text") -> int:
    return -(-benchmark.filter(F.col(f"`{item_text}`").isNotNull()).count() // MAX_ITEMS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it leaks (columns of ``SCHEMA``).  Several blocks of items are searched one after
    another, each in jobs of its own."""
    pairs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    several = _n_blocks(benchmark) > 1
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for searcher in searchers(docs, benchmark, text):
        found = _leaks_of(pairs, searcher)
        out = out.unionByName(materialize(found, "leaks")) if several else found
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns: one map for a single block of items, else without
    the rows whose text is that of a leak."""
    at = docs.columns.index(text)

    def clean_of(searcher: Searcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, mask = utf8(batch.column(at)), []
                for lo, hi in steps(raw):
                    mask += [not hits for hits in searcher.search(raw[lo:hi])]
                yield batch.filter(pa.array(mask, pa.bool_()))
        return run

    if _n_blocks(benchmark) <= 1:
        for searcher in searchers(docs, benchmark, text):
            docs = docs.mapInArrow(tidy(clean_of(searcher)), docs.schema)
        return docs
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    own, key = unused(docs, "_own"), unused(docs, "_key")

    def leaking(searcher: Searcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = utf8(batch.column(0))
                for lo, hi in steps(raw):
                    found = [bool(hits) for hits in searcher.search(raw[lo:hi])]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).filter(pa.array(found, pa.bool_()))], names=[key])
        return run

    texts = docs.select(F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    bad = docs.sparkSession.createDataFrame([], f"{key} string")
    for searcher in searchers(docs, benchmark, text):
        bad = bad.unionByName(materialize(texts.mapInArrow(tidy(leaking(searcher)), f"{key} string"), "leaks"))
    marked = docs.withColumn(own, digest).join(bad.distinct(), F.col(own) == F.col(key), "left_anti")
    return marked.drop(own)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

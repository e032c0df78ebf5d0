"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words, counted by occurrence: the second occurrence of a word in a text is a term
of its own, and so is each further one, so that frequency counts. The index holds every
term of every example; beginnings of words (4 to 7 letters) are terms too where the labels
tie them to label 1. A term weighs its IDF, and TIED times that if the labels tie it to
label 1 (LEAST_TRUE, LEAST_Z, LEAST_LIFT). The cosine is over these weights and all terms of
the examples; words that no example holds do not count. The K nearest examples by cosine
vote, weighted by distance, and an isotonic fit on leave-one-out votes of the examples
calibrates the score. A text without any known word has no neighbours and gets the rate of
such examples.

The index orders examples by their tied, then their commonest terms and cuts them into
blocks. Terms in few examples have posting lists, which are summed; those in more than one
of COMMON examples have one list for each block, a dense one, with the block's largest
weight of the term. That weight and the block's largest sum of rarer terms bound the
cosines of all its examples. For each text the blocks of the largest bounds are read first,
then every block whose bound reaches the K-th best cosine so far, block by block for all
texts of a batch that ask for it; what comes close to the K-th best is computed once more
in double precision. The result is exact. Equal vectors have equal neighbours, which are
kept per worker.

The sample is bounded by SAMPLE_ROWS labelled rows of at most MAX_CHARS characters; the
index is broadcast and is bounded with it.

Edge cases: null and empty texts have no terms; texts of any length are scored whole;
null labels are not learned from; rows with equal or null ids each give a row; without
labelled rows every score is 0.5; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, python_workers, session

SAMPLE_ROWS, MAX_CHARS = 6_000, 20_000
#: Terms tied to label 1: least examples of label 1 with the term, least z of its log odds, least lift.
LEAST_TRUE, LEAST_Z, LEAST_LIFT = 4, 4.0, 3.0
BEGINNINGS = (4, 5, 6, 7)
#: How many times its IDF a tied term weighs.
TIED = 40.0
K, BLOCK, FIRST_BLOCKS, COMMON, NEAR, PRIOR_VOTES = 24, 32, 3, 16, 0.05, 1.0
#: More than the error of a cosine in single precision, and texts that are searched at once.
ERROR, BATCH = 1e-4, 256
KNOWN_WORDS, KNOWN_VECTORS = 300_000, 50_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    return [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - start, size)


def _tied(words: list[Counter], labels: np.ndarray) -> set[tuple[str, int]]:
    """(term, occurrence) pairs of words and beginnings that the labels tie to label 1."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    true: Counter = Counter()
    for c, y in zip(words, labels, strict=True):
        if y:
            true.update((t, k) for t, n in _begun(c).items() for k in range(1, n + 1))
    true = Counter({t: n for t, n in true.items() if n >= LEAST_TRUE})
    first, other = {t for t, _ in true}, Counter()
    for c, y in zip(words, labels, strict=True):
        if not y:
            other.update(p for t, n in _begun(c, first).items() for k in range(1, n + 1) if (p := (t, k)) in true)
    out = set()
    for t, a in true.items():
        b = other[t]
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if z >= LEAST_Z and a / n1 >= LEAST_LIFT * b / max(1, n0):
            out.add(t)
    return out


def _begun(words: Counter, known: set[str] | None = None) -> Counter:
    """The counts of words and their beginnings, of `known` ones if given."""
    out: Counter = Counter()
    for w, n in words.items():
        for t in (w, *beginnings(w)):
            if known is None or t in known:
                out[t] += n
    return out


class Examples:
    """The labelled sample as a block-max inverted index, with its calibration."""

    def __init__(self, rows: list[tuple[Any, str | None, int]]):
        labels = np.array([y for _, _, y in rows], float)
        words = [Counter(words_of(t)) for _, t, _ in rows]
        tied = _tied(words, labels)
        tied_terms = {t for t, _ in tied if t.endswith("-")}
        counted = [c | _begun(c, tied_terms) for c in words] if tied_terms else words
        most: dict[str, int] = {}
        for c in counted:
            for t, n in c.items():
                if n > most.get(t, 0):
                    most[t] = n
        # a term's occurrences have numbers in a row, the commonest terms the first ones
        held = Counter(t for c in counted for t in c)
        self.place = {t: k for k, (t, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0])))}
        self.most = np.array([most[t] for t in self.place], np.int64)
        self.first = np.cumsum(self.most) - self.most
        size = int(self.most.sum())
        found = [self.numbers(np.array([self.place[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted]
        df = np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=size)
        is_tied = np.zeros(size, bool)
        for t, k in tied:
            is_tied[self.first[self.place[t]] + k - 1] = True
        self.weight = (np.log((1 + len(rows)) / (1 + df)) + 1) * np.where(is_tied, TIED, 1.0)
        self.tied = sorted(tied)
        bare = [y for y, f in zip(labels, found, strict=True) if not len(f)]
        self.bare = float((sum(bare) + 1) / (len(bare) + 2))
        self.prior = float((labels.sum() + 1) / (len(rows) + 2))

        key = lambda k: (tuple(found[k][is_tied[found[k]]].tolist()), tuple(found[k][:12].tolist()), str(rows[k][0]), k)
        order = sorted((k for k, f in enumerate(found) if len(f)), key=key)
        self.ids = [rows[k][0] for k in order]
        self.labels = labels[order] if order else np.empty(0)
        self.n_blocks = -(-len(order) // BLOCK)
        # the terms of each example, in a row
        self.terms = np.concatenate([np.empty(0, np.int64), *(found[k] for k in order)]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum([len(found[k]) for k in order])]).astype(np.int64)
        self.steps = self.opened()._calibrated()

    def opened(self) -> Examples:
        """Lay out the weights, the posting lists of the rarer terms and the dense lists of each block; they are not sent with the index."""
        example = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        self.query = np.zeros(len(self.weight))
        self.weights = self.weight[self.terms]
        self.weights /= np.sqrt(np.bincount(example, self.weights**2, len(self.ids)))[example]
        df = np.bincount(self.terms, minlength=len(self.weight))
        often = COMMON * df > len(self.ids)
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        place = self.common[self.terms]
        rare = np.flatnonzero(place < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.post_example, self.post_weight = example[rare], self.weights[rare].astype(np.float32)
        self.post_starts = np.searchsorted(self.terms[rare], np.arange(len(self.weight) + 1))
        self.dense = np.zeros((self.n_blocks * BLOCK, int(often.sum())), np.float32)
        self.dense[example[place >= 0], place[place >= 0]] = self.weights[place >= 0]
        self.tops = self.dense.reshape(self.n_blocks, BLOCK, -1).max(1, initial=0) if self.n_blocks else np.empty((0, self.dense.shape[1]), np.float32)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("query", "weights", "common", "post_example", "post_weight", "post_starts", "dense", "tops")}

    def numbers(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sorted numbers of the terms at distinct places, each as often as it occurs and the index knows."""
        return np.sort(_ranges(self.first[places], np.minimum(self.most[places], counts)))

    def vector(self, found: np.ndarray) -> np.ndarray:
        """The weights of a text's terms, as a vector of length 1."""
        w = self.weight[found]
        return w / np.sqrt((w * w).sum())

    def cosines(self, found: np.ndarray, vector: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cosines of a vector and some examples, in double precision."""
        size = self.starts[at + 1] - self.starts[at]
        of = _ranges(self.starts[at], size)
        self.query[found] = vector
        out = np.add.reduceat(self.query[self.terms[of]] * self.weights[of], np.cumsum(size) - size)
        self.query[found] = 0
        return out

    def nearest(self, texts: list[np.ndarray], leave: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """For the terms of each text the K examples of largest cosine, exactly; of equals the first. leave[i] is left out for text i."""
        if not self.n_blocks or not texts:
            return [[] for _ in texts]
        n, vectors = len(texts), [self.vector(f) if len(f) else np.empty(0) for f in texts]
        sums = np.zeros((n, self.n_blocks * BLOCK), np.float32)
        query = np.zeros((n, self.dense.shape[1]), np.float32)
        for i, (f, v) in enumerate(zip(texts, vectors, strict=True)):
            place = self.common[f]
            query[i, place[place >= 0]] = v[place >= 0]
            f, v = f[place < 0], v[place < 0]
            size = self.post_starts[f + 1] - self.post_starts[f]
            of = _ranges(self.post_starts[f], size)
            sums[i] = np.bincount(self.post_example[of], np.repeat(v, size) * self.post_weight[of], sums.shape[1])
        bound = query @ self.tops.T + sums.reshape(n, self.n_blocks, BLOCK).max(2) + ERROR
        first = np.argpartition(-bound, min(FIRST_BLOCKS, self.n_blocks) - 1, 1)[:, :FIRST_BLOCKS]
        asked, done = np.zeros((2, n, self.n_blocks), bool)
        np.put_along_axis(asked, first, True, 1)
        cosine = np.full((n, self.n_blocks, BLOCK), -1, np.float32)
        for read in (first, None):
            for b in np.flatnonzero((asked & ~done).any(0)).tolist():
                i = np.flatnonzero(asked[:, b] & ~done[:, b])
                cosine[i, b] = sums[i, b * BLOCK : (b + 1) * BLOCK] + query[i] @ self.dense[b * BLOCK : (b + 1) * BLOCK].T
            done |= asked
            cosine.reshape(n, -1)[:, len(self.ids) :] = -1
            if leave is not None:
                cosine.reshape(n, -1)[np.arange(n), leave] = -1
            known = (cosine if read is None else np.take_along_axis(cosine, read[:, :, None], 1)).reshape(n, -1)
            k = min(K, known.shape[1]) - 1
            worst = np.maximum(0, -np.partition(-known, k, 1)[:, k]) - ERROR
            asked = bound >= worst[:, None]
        cosine = cosine.reshape(n, -1)
        out = []
        for i, (f, v) in enumerate(zip(texts, vectors, strict=True)):
            at = np.flatnonzero(cosine[i] >= max(float(worst[i]), 0)) if len(f) else np.empty(0, np.int64)
            c = np.round(self.cosines(f, v, at), 12) if len(at) else np.empty(0)
            best = np.lexsort((at, -c))[:K]
            out.append([(k, x) for k, x in zip(at[best].tolist(), c[best].tolist(), strict=True) if x > 0])
        return out

    def votes(self, near: list[tuple[int, float]]) -> float:
        weight = [1 / (max(0.0, 1 - c) + NEAR) for _, c in near]
        m = PRIOR_VOTES / (1 + NEAR)
        return (sum(w * self.labels[k] for w, (k, _) in zip(weight, near, strict=True)) + m * self.prior) / (sum(weight) + m)

    def _calibrated(self) -> list[tuple[float, float]]:
        """Isotonic steps (vote, rate) over leave-one-out votes."""
        own = [self.terms[self.starts[k] : self.starts[k + 1]] for k in range(len(self.ids))]
        near = [x for lo in range(0, len(own), BATCH) for x in self.nearest(own[lo : lo + BATCH], list(range(lo, min(lo + BATCH, len(own)))))]
        votes = sorted((self.votes(x), float(y)) for x, y in zip(near, self.labels, strict=True))
        steps: list[list[float]] = []
        for vote, label in votes:
            steps.append([vote, label, 1.0])
            while len(steps) > 1 and steps[-2][1] >= steps[-1][1]:
                v, y, n = steps.pop()
                v0, y0, n0 = steps[-1]
                steps[-1] = [(v0 * n0 + v * n) / (n0 + n), (y0 * n0 + y * n) / (n0 + n), n0 + n]
        return [(v, (y * n + self.prior) / (n + 1)) for v, y, n in steps]

    def score(self, near: list[tuple[int, float]]) -> tuple[float, str]:
        """(score, evidence: the ids of the nearest examples with their labels and cosines)."""
        if not near:
            return self.bare, ""
        x, y = zip(*self.steps, strict=True)
        said = ", ".join(f"{self.ids[k]}:{int(self.labels[k])}:{c:.3f}" for k, c in near[:3])
        return float(np.clip(np.interp(self.votes(near), x, y), 0, 1)), said


class Scorer:
    """An index with a worker's tables of words and vectors seen."""

    def __init__(self, examples: Examples):
        self.examples = examples.opened()
        self.known: dict[bytes, tuple[float, str]] = {}
        #: word -> the places of its beginnings, for words that have any
        self.begun: dict[str, tuple[int, ...]] = {}
        place, begun = examples.place, self.begun

        class Places(dict):
            """word -> its place in the index or -1."""

            def __missing__(self, word: str) -> int:
                out = place.get(word, -1)
                if more := tuple(place[t] for t in beginnings(word) if t in place):
                    begun[word] = more
                if len(word) <= 64:
                    if len(self) >= KNOWN_WORDS:
                        self.clear()
                    self[word] = out
                return out

        self.places = Places()

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of the terms of a whole text."""
        count = Counter(words_of(text))
        places = np.fromiter(map(self.places.__getitem__, count), np.int64, len(count))
        counts = np.fromiter(count.values(), np.int64, len(count))
        known = places >= 0
        places, counts = places[known], counts[known]
        if more := count.keys() & self.begun.keys():
            begun: Counter = Counter()
            for word in more:
                for p in self.begun[word]:
                    begun[p] += count[word]
            places = np.concatenate([places, list(begun)])
            counts = np.concatenate([counts, list(begun.values())])
        return self.examples.numbers(places, counts)

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        out: list[tuple[float, str]] = []
        for lo in range(0, len(texts), BATCH):
            found = [self.numbers(t) for t in texts[lo : lo + BATCH]]
            keys = [f.tobytes() for f in found]
            new = {k: f for k, f in zip(keys, found, strict=True) if k not in self.known}
            if len(self.known) + len(new) > KNOWN_VECTORS:
                self.known.clear()
                new = dict(zip(keys, found, strict=True))
            self.known.update(zip(new, map(self.examples.score, self.examples.nearest(list(new.values()))), strict=True))
            out += [self.known[k] for k in keys]
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, max_chars: int = MAX_CHARS) -> Examples:
    """Examples from labelled rows whose id satisfies `learn`."""
    return Examples(labelled_sample(docs, labels, learn, label_col, id_col, text_col, rows, max_chars))


def score_documents(docs: DataFrame, examples: Examples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence for every row."""
    import pyarrow as pa

    spark = session(docs)
    python_workers(spark)
    sent = spark.sparkContext.broadcast(examples)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scored(batches: Iterator[Any]) -> Iterator[Any]:
        scorer = Scorer(sent.value)
        for b in batches:
            out = scorer.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string())], names=["doc_id", "score", "evidence"])

    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, evidence string")

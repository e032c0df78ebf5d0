"""Language identification with string kernels.

The kernel is the blended spectrum of presence: the number of character n-grams, n from 1
to 4, that two texts share, divided by the root of the numbers each has. N-grams are those
of lower-cased letters with runs of other characters as one blank, hashed into GRAM_SPACE
places. Every place counts: in the numbers shared where a landmark has it, and always in
the root.

Landmarks are labelled texts. Nyström's map K(x, landmarks) K(landmarks)^-1/2 makes the
kernel a finite vector, and kernel ridge regression on it gives one scorer per language
against the rest. Scores are the matrix product of presence, landmarks, map and scorers.
All but the first factor are multiplied when the model is made, so that a batch of texts is
one product of its (sparse) presence with a table of places by languages.

The sample is bounded by SAMPLE_ROWS rows of at most MAX_CHARS characters; the broadcast
model has GRAM_SPACE rows at most and a column for each language.

Edge cases: texts that are null or have no letter are `und` with score 0; texts of any
length are read whole; null languages are not learned from; ties go to the first language
by name; rows with equal or null ids each give a row; without labelled rows everything is
`und`; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import labelled_sample, python_workers, session

SAMPLE_ROWS, MAX_CHARS = 3_000, 20_000
GRAMS, GRAM_SPACE, LANDMARKS, RIDGE = 4, 1 << 18, 128, 1e-3
#: How much a difference of scorers counts in the score.
SHARP = 4.0
#: Characters read at once, so that long texts need little memory.
SLICE = 1 << 20
_MUL = np.uint32(0x9E3779B1)
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for all that is no letter."""
    if not _FOLD:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(fold)
    return _FOLD[0]


def gram_places(text: str | None) -> Iterator[np.ndarray]:
    """Hashed places of the n-grams of a whole text, slice by slice; nothing for a text without letters."""
    text = text or ""
    fold = _fold()
    for lo in range(0, len(text), SLICE):
        raw = text[max(0, lo - GRAMS) : lo + SLICE].encode("utf-32-le", "surrogatepass")
        c = fold[np.frombuffer(raw, "<u4")]
        blank = c == 32
        if blank.all():
            continue
        c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
        code = np.zeros(len(c), np.uint32)
        for n in range(1, min(GRAMS, len(c)) + 1):
            code = code[: len(c) - n + 1] * _MUL + c[n - 1 :] + np.uint32(n)
            yield (code * _MUL) >> np.uint32(32 - 18)


def present(text: str | None, mark: np.ndarray) -> np.ndarray:
    """The distinct places of a text's n-grams, in order. `mark` holds False for each place, before and after."""
    got = False
    for p in gram_places(text):
        mark[p] = got = True
    places = np.flatnonzero(mark) if got else np.empty(0, np.int64)
    mark[places] = False
    return places


class Kernel:
    """Landmarks, Nyström's map and scorers, multiplied into a table of places by languages."""

    def __init__(self, rows: list[tuple[Any, str | None, str]]):
        mark = np.zeros(GRAM_SPACE, bool)
        places = [present(t, mark) for _, t, _ in rows]
        rows_ok = [k for k, p in enumerate(places) if len(p)]
        self.languages = sorted({rows[k][2] for k in rows_ok})
        if not self.languages:
            return
        queues = [[k for k in rows_ok if rows[k][2] == lang] for lang in self.languages]
        marks = [q[i] for i in range(max(map(len, queues))) for q in queues if i < len(q)][:LANDMARKS]
        held = np.unique(np.concatenate([places[k] for k in marks]))
        #: the row of each place; the last row is that of places without a landmark
        self.row = np.full(GRAM_SPACE, len(held), np.int32)
        self.row[held] = np.arange(len(held))
        landmarks = np.zeros((len(held) + 1, len(marks)), np.float32)
        for j, k in enumerate(marks):
            landmarks[self.row[places[k]], j] = 1 / np.sqrt(len(places[k]))
        kernel = np.array([landmarks[self.row[places[k]]].sum(0, dtype=np.float64) / np.sqrt(len(places[k])) for k in rows_ok])
        at = {k: i for i, k in enumerate(rows_ok)}
        value, vector = np.linalg.eigh(kernel[[at[k] for k in marks]])
        keep = value > 1e-6 * value.max()
        half = vector[:, keep] / np.sqrt(value[keep])
        x = np.concatenate([kernel @ half, np.ones((len(rows_ok), 1))], 1)
        y = np.array([[1.0 if rows[k][2] == lang else -1.0 for lang in self.languages] for k in rows_ok])
        # each language weighs the same, however often it occurs
        weight = np.zeros(len(rows_ok))
        for j in range(len(self.languages)):
            weight[y[:, j] > 0] = len(rows_ok) / (len(self.languages) * max(1, (y[:, j] > 0).sum()))
        solved = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * len(x) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
        self.table = (landmarks @ (half @ solved[:-1])).astype(np.float32)
        self.offset = solved[-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        mark = np.zeros(GRAM_SPACE, bool)
        places = [present(t, mark) for t in texts]
        at = [k for k, p in enumerate(places) if len(p)]
        if at:
            f = np.array([self.table[self.row[places[k]]].sum(0, dtype=np.float64) / np.sqrt(len(places[k])) for k in at]) + self.offset
            e = np.exp(SHARP * (f - f.max(1, keepdims=True)))
            best = f.argmax(1)
            for k, b, p in zip(at, best.tolist(), (e / e.sum(1, keepdims=True)).tolist(), strict=True):
                out[k] = self.languages[b], min(1.0, p[b])
        return out


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, max_chars: int = MAX_CHARS) -> Kernel:
    """A kernel from the rows whose id satisfies `learn` and that have a language."""
    return Kernel(labelled_sample(docs, docs, learn, lang_col, id_col, text_col, rows, max_chars))


def identify(docs: DataFrame, kernel: Kernel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    import pyarrow as pa

    spark = session(docs)
    python_workers(spark)
    sent = spark.sparkContext.broadcast(kernel)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def predicted(batches: Iterator[Any]) -> Iterator[Any]:
        model = sent.value
        for b in batches:
            out = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

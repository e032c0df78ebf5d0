"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Every n-gram of an item is a seed, however
many or few documents hold it: a document that shares one with an item is compared with it by
a word-level Smith-Waterman alignment around the seeds. 1 is a verbatim copy; substitutions,
insertions and deletions lower the score. Where two upper bounds of the alignment's score,
from the words that the item and the stretch of text share, stay below the least score, the
alignment itself is left out, which changes no result.

A copy so edited that no SEED of its words in a row are left, such as one with every third
word replaced, shares no seed and is not found.

Test items are handled in blocks of BLOCK_ITEMS or BLOCK_CHARS, and a block's items are
what is broadcast; a larger benchmark means more blocks, not a larger broadcast.

Edge cases: null and empty texts and items match nothing; items with fewer words than a
seed are one seed and must be held whole; texts of any length are read whole; repeated
rows with equal ids are read as one document that holds what any of them holds; null ids
are a document of their own; empty tables give an empty result; further columns are not
read (`drop_leaks` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import broadcastable, fresh, python_workers, session, staged

#: Words in a seed; scores of an alignment; least score for a leak. A leak also has to
#: match as many words as LEAST_WORDS alone would, or the whole item if it is shorter.
SEED, HIT, MISS, GAP, LEAST = 3, 2, -1, -1, 0.4
#: Items in a block, and characters of all their texts, about: what the driver holds and broadcasts at once
#: (some 9 bytes a character in all).
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
LEAST_WORDS = 8
#: Words around a seed's expected place, as a share of the item, that the alignment sees.
SLACK = 0.5
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Places:
    """Where the items hold each n-gram: items[starts[g] : starts[g + 1]] and the offsets there, as plain arrays."""

    def __init__(self, grams: np.ndarray, items: np.ndarray, offsets: np.ndarray, total: int):
        order = np.lexsort((offsets, items, grams))
        self.items, self.offsets = items[order].astype(np.int32), offsets[order].astype(np.int32)
        self.starts = np.concatenate([[0], np.bincount(grams, minlength=total).cumsum()])

    def __getitem__(self, gram: int) -> list[tuple[int, int]]:
        part = slice(self.starts[gram], self.starts[gram + 1])
        return list(zip(self.items[part].tolist(), self.offsets[part].tolist(), strict=True))

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into `grams`, item, offset) of every place of each of them."""
        first, n = self.starts[grams], self.starts[grams + 1] - self.starts[grams]
        which = np.repeat(np.arange(len(grams)), n)
        at = np.arange(len(which)) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
        return which, self.items[at].astype(np.int64), self.offsets[at].astype(np.int64)


class Items:
    """A block of test items: numbered words, and the places of their n-grams.

    The runs of n words that items hold are numbered by their rank among the codes (number
    of the run without its last word, last word), so codes are exact however many words
    there are.
    """

    def __init__(self, items: list[tuple[Any, str | None]]):
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words_of(t)], np.int64) for _, t in items]
        self.mark = np.empty(0, bool)
        self.base = len(self.number)
        lengths = np.array([len(w) for w in self.words], np.int64)
        seeds = np.minimum(lengths, SEED)
        self.lengths = sorted(set(seeds[seeds > 0].tolist()))
        flat = np.concatenate([np.empty(0, np.int64), *self.words])
        item = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(flat)) - np.repeat(lengths.cumsum() - lengths, lengths)
        #: runs[n]: the sorted codes of runs of n words (of one word: their numbers); before[n]: n-grams of fewer words.
        self.runs: dict[int, np.ndarray] = {}
        self.before: dict[int, int] = {}
        at, rank, total, found = np.arange(len(flat)), flat, 0, []
        for n in range(1, max(self.lengths, default=0) + 1):
            if n > 1:
                whole = offset[at] + n <= lengths[item[at]]
                at, rank = at[whole], rank[whole]
                self.runs[n], rank = np.unique(rank * self.base + flat[at + n - 1], return_inverse=True)
            self.before[n] = total
            seed = seeds[item[at]] == n
            found.append((rank[seed] + total, item[at[seed]], offset[at[seed]]))
            total += len(self.runs[n]) if n > 1 else self.base
        self.places = Places(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else [()] * 3)), total)

    def numbered(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, -1 where no item holds the word."""
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def found(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram numbers, word positions) of the item n-grams in a text of numbered words."""
        ns, ats = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.flatnonzero(w >= 0)
        rank = w[at]
        for n in range(1, max(self.lengths, default=0) + 1):
            if n > 1:
                at, rank = at[at + n <= len(w)], rank[at + n <= len(w)]
                known = w[at + n - 1] >= 0
                at, rank = at[known], rank[known]
                code, runs = rank * self.base + w[at + n - 1], self.runs[n]
                place = np.searchsorted(runs, code)
                place[place == len(runs)] = 0
                hit = runs[place] == code
                at, rank = at[hit], place[hit]
            if n in self.lengths:
                ns.append(rank + self.before[n])
                ats.append(at)
        return np.concatenate(ns), np.concatenate(ats)

    def unmarked(self) -> np.ndarray:
        """False for every word number and one more; made once in a worker, and left False by those who use it."""
        if not len(self.mark):
            self.mark = np.zeros(self.base + 1, bool)
        return self.mark


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first word, end word) in `text`.

    Row by row; gaps along the text are a running maximum, so a row is a few vector
    operations. Where each best path began is carried along.
    """
    n = len(text)
    ramp = np.arange(n, dtype=np.int64) * -GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        hit = row[:-1] + np.where(text == w, HIT, MISS)
        gap = row[1:] + GAP
        cell = np.maximum(np.maximum(hit, gap), 0)
        came = np.where(cell == 0, np.arange(1, n + 1), np.where(hit >= gap, start[:-1], start[1:]))
        lifted = cell + ramp
        top = np.maximum.accumulate(lifted)
        left = np.maximum.accumulate(np.where(lifted == top, np.arange(n), 0))
        cell, came = top - ramp, came[left]
        row, start = np.concatenate([[0], cell]), np.concatenate([[0], came])
        k = int(cell.argmax()) if n else 0
        if n and cell[k] > best[0]:
            best = int(cell[k]), int(came[k]), k + 1
    return best


def _run(hit: np.ndarray) -> int:
    """The best sum of a stretch of words, HIT for each marked one and the lighter penalty for each other."""
    sums = np.concatenate([[0], np.where(hit, HIT, max(MISS, GAP)).cumsum()])
    return int((sums - np.minimum.accumulate(sums)).max())


def _bound(item: np.ndarray, text: np.ndarray, mark: np.ndarray) -> int:
    """No alignment of `item` and `text` scores more: each word that it passes over is matched or costs.

    `mark` holds False for every word number and one more, and does so again afterwards.
    """
    mark[item] = True
    top = _run(mark[text])
    mark[item] = False
    mark[text] = True
    mark[-1] = False
    top = min(top, _run(mark[item]))
    mark[text] = False
    return top


def _windows(at: np.ndarray, offset: np.ndarray, length: int, total: int) -> list[tuple[int, int]]:
    """Word ranges of a text that the seeds point to, merged where they overlap."""
    slack = int(length * SLACK) + 3
    out: list[tuple[int, int]] = []
    for s in np.unique(at - offset).tolist():
        lo, hi = max(0, s - slack), min(total, s + length + slack)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[Any, str | None]]]:
    """The items in blocks, by a hash; only one block is at the driver at a time."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars")).first()
    n = max(-(-size.items // BLOCK_ITEMS), -(-(size.chars or 0) // BLOCK_CHARS))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: documents that hold an edited or verbatim copy of an item."""
    spark = session(docs)
    python_workers(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind, item_kind = rows.schema["doc_id"].dataType, benchmark.schema[item_id].dataType
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        part = _leaks_of_block(rows, Items(block), id_kind, item_kind)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _found_schema(id_kind, item_kind)) if out is None else out


def _found_schema(id_kind: T.DataType, item_kind: T.DataType) -> T.StructType:
    more = [("score", T.DoubleType()), ("first_word", T.LongType()), ("end_word", T.LongType())]
    return T.StructType([T.StructField(k, x) for k, x in [("doc_id", id_kind), ("item_id", item_kind), *more]])


def _leaks_of_block(rows: DataFrame, items: Items, id_kind: T.DataType, item_kind: T.DataType) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = session(rows)
    arrow = to_arrow_type(item_kind)
    sent = spark.sparkContext.broadcast(items)

    def aligned(batches: Iterator[Any]) -> Iterator[Any]:
        block = sent.value
        for b in batches:
            ids, found = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for leak in leaks_in(block, t):
                    ids.append(k)
                    found.append(leak)
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array([block.ids[i] for i in cols[0]], arrow), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                names=["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return rows.mapInArrow(aligned, _found_schema(id_kind, item_kind))


def leaks_in(block: Items, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word): the best alignment of each item that shares a seed with the text."""
    words = block.numbered(text)
    found, at = block.found(words)
    which, items, offsets = block.places.of(found)
    if not len(items):
        return []
    order = np.argsort(items, kind="stable")
    items, ats, offsets = items[order], at[which[order]], offsets[order]
    ends = np.append(np.flatnonzero(items[1:] != items[:-1]) + 1, len(items)).tolist()
    mark = block.unmarked()
    out = []
    for begin, end in zip([0, *ends], ends, strict=False):
        k, a, offset = int(items[begin]), ats[begin:end], offsets[begin:end]
        item = block.words[k]
        least = max(LEAST * HIT * len(item), HIT * min(LEAST_WORDS, len(item)))
        best = (0, 0, 0)
        for lo, hi in _windows(a, offset, len(item), len(words)):
            top = _bound(item, words[lo:hi], mark)
            if top < least - 1e-6 or top <= best[0]:
                continue
            score, first, last = align(item, words[lo:hi])
            if score > best[0]:
                best = score, lo + first, lo + last
        share = best[0] / (HIT * len(item))
        if share >= LEAST and best[0] >= HIT * min(LEAST_WORDS, len(item)):
            out.append((k, share, best[1], best[2]))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a leak, with their own columns."""
    leak_id = fresh(docs, "_leak_id")
    leaks = find_leaks(docs, benchmark, id_col, text_col, item_id, item_text).select(F.col("doc_id").alias(leak_id)).distinct()
    leaks = staged(leaks, "leaks")
    return docs.join(F.broadcast(leaks) if broadcastable(leaks) else leaks, F.col(id_col).eqNullSafe(F.col(leak_id)), "left_anti")

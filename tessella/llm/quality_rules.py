"""Quality rules combined by weak supervision.

Each rule looks at statistics of a whole text and votes good, bad or abstains. The votes
of all documents that pass the two base rules (fewest words, most repeats) are counted by pattern (at most 3 ** rules of them, whatever the corpus),
expectation-maximisation on these counts estimates how often each rule is right on good
and on bad documents and how common good ones are, and each document gets the posterior
probability of being good. Documents that fail the two base rules are never kept.

The texts are read twice: once for the counts, once to score. Nothing is shuffled but
the pattern counts.

Edge cases: a null text has no words; texts of any length are read whole; rows with equal
or null ids each give a row; on an empty table the estimates are the starting values and
the result is empty; further columns are kept by `score_documents` and unread by `judge`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import python_workers, session

#: White space between words, and symbols.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5
RIGHT_GOOD, RIGHT_BAD, PRIOR_VOTES = 0.97, 0.4, 20
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_NOT_LOWER = bytes(set(range(256)) - set(_LOWER))
_ASCII, _WIDE = bytes(range(128)), bytes(range(128, 256))
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in BLANKS + ".,;:?'\"()-")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_marks", "n_wide", "n_odd")
BASE_STATS = STATS[:5]


def text_stats(text: str | None) -> tuple[int, ...]:
    """The STATS of a whole text, in order."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the ASCII blanks
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), *[0] * (len(STATS) - 3))
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids, len(number)),
        len(lines),
        len(number),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_LOWER)),
        text.count("!"),
        len(text) - len(raw.translate(None, _WIDE)),
        len(raw.translate(None, _WIDE + _PLAIN)),
    )


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of three words that the text holds twice or more."""
    if len(ids) < 4:
        return 0
    if distinct >= 2_000_000:  # three numbers would not fit into 63 bits
        _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        codes = pairs[:-1] * distinct + ids[2:]
    else:
        codes = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(len(ids), bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        again[hit + k] = True
    return int(again.sum())


def _vote(share: float, good: float, bad: float) -> int:
    """Good up to `good`, bad from `bad` on, else no vote."""
    return 1 if share <= good else -1 if share >= bad else 0


#: Rules: name and vote (1 good, -1 bad, 0 abstains) on the STATS of a text that has words.
RULES = (
    ("length", lambda s: 1 if s["n_words"] >= 80 else -1 if s["n_words"] < MIN_WORDS else 0),
    ("word_length", lambda s: 1 if 3 <= s["word_chars"] / s["n_words"] <= 10 else -1),
    ("symbols", lambda s: _vote(s["n_symbols"] / s["n_words"], 0.05, 0.2)),
    ("dup_lines", lambda s: _vote(s["n_dup_lines"] / max(1, s["n_lines"]), 0.1, 0.3)),
    ("repeats", lambda s: _vote(s["n_repeat_words"] / s["n_words"], 0.15, 0.4)),
    ("variety", lambda s: -_vote(math.log(1 + s["n_distinct"]) / math.log(1 + s["n_words"]), 0.62, 0.75)),
    ("capitals", lambda s: _vote(s["n_upper"] / max(1, s["n_upper"] + s["n_lower"]), 0.15, 0.4)),
    ("marks", lambda s: _vote(s["n_marks"] / s["n_words"], 0.05, 0.25)),
    ("letters", lambda s: _vote(1 - (s["n_upper"] + s["n_lower"] + s["n_wide"]) / s["word_chars"], 0.07, 0.12)),
    ("odd", lambda s: _vote(s["n_odd"] / s["n_words"], 0.06, 0.2)),
)


def pattern(stats: tuple[int, ...]) -> int:
    """The votes of all rules as one number in base 3. A text without words gets a bad vote of each."""
    s = dict(zip(STATS, stats, strict=True))
    out = 0
    for _, rule in RULES:
        out = out * 3 + 1 + (rule(s) if s["n_words"] else -1)
    return out


def votes(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def estimate(counts: dict[int, int], rounds: int = 60) -> dict:
    """Expectation-maximisation over pattern counts.

    Each rule that votes is right with one probability on good and one on bad documents.
    They start at RIGHT_GOOD and RIGHT_BAD: rules seldom blame a good document, and each
    is blind to much of what is bad. A prior of PRIOR_VOTES votes there ties the classes
    to the votes' meaning and makes the result defined for any counts.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    v = np.array([votes(c) for c in codes]).reshape(len(codes), len(RULES))
    start = {1: RIGHT_GOOD, -1: RIGHT_BAD}
    right = {y: np.full(len(RULES), p) for y, p in start.items()}
    share = 0.8
    for _ in range(rounds if len(codes) else 0):
        p = _posterior(v, share, right)
        share = (float(n @ p) + 8) / (n.sum() + 10)
        for y, w in ((1, n * p), (-1, n * (1 - p))):
            hit, said = w @ (v == y), w @ (v != 0)
            right[y] = np.clip((hit + start[y] * PRIOR_VOTES) / (said + PRIOR_VOTES), 0.5 if y > 0 else 0.01, 0.995)
    return {"share": share, "right_good": right[1].tolist(), "right_bad": right[-1].tolist()}


def _posterior(v: np.ndarray, share: float, right: dict[int, np.ndarray]) -> np.ndarray:
    logs = {}
    for y, prior in ((1, share), (-1, 1 - share)):
        logs[y] = np.log(prior) + (v == y) @ np.log(right[y]) + (v == -y) @ np.log(1 - right[y])
    return 1 / (1 + np.exp(np.clip(logs[-1] - logs[1], -500, 500)))


def posterior(model: dict, codes: list[int]) -> np.ndarray:
    v = np.array([votes(c) for c in codes]).reshape(len(codes), len(RULES))
    return _posterior(v, model["share"], {1: np.array(model["right_good"]), -1: np.array(model["right_bad"])})


def fit(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> dict:
    """The estimates from the votes on all documents that the base rules do not settle."""
    import pyarrow as pa

    python_workers(session(docs))

    def patterns(batches: Iterator[Any]) -> Iterator[Any]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            for s in map(text_stats, b.column(0).to_pylist()):
                if not base_failed(s, min_words):
                    seen[pattern(s)] += 1
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select(text_col).mapInArrow(patterns, "pattern bigint, n bigint")
    return estimate({r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def score_documents(docs: DataFrame, text_col: str = "text", model: dict | None = None, prefix: str = "", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with STATS, base_failed, quality (the posterior) and kept appended, named with `prefix`."""
    import pyarrow as pa

    python_workers(session(docs))
    model = model or fit(docs, text_col, min_words)
    at = docs.columns.index(text_col)
    added = [T.StructField(prefix + s, T.LongType()) for s in STATS] + [T.StructField(prefix + "base_failed", T.BooleanType()), T.StructField(prefix + "quality", T.DoubleType()), T.StructField(prefix + "kept", T.BooleanType())]
    names = [*docs.columns, *(f.name for f in added)]

    def scored(batches: Iterator[Any]) -> Iterator[Any]:
        known: dict[int, float] = {}
        for b in batches:
            stats = [text_stats(t) for t in b.column(at).to_pylist()]
            codes = [pattern(s) for s in stats]
            fresh = sorted(set(codes) - known.keys())
            known.update(zip(fresh, posterior(model, fresh).tolist(), strict=True))
            quality = [known[c] for c in codes]
            failed = [base_failed(s, min_words) for s in stats]
            kept = [not f and q >= KEEP_AT for f, q in zip(failed, quality, strict=True)]
            new = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array(failed, pa.bool_()), pa.array(quality, pa.float64()), pa.array(kept, pa.bool_())], names=names)

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, *added]))


def base_failed(stats: tuple[int, ...], min_words: int = MIN_WORDS) -> bool:
    return stats[0] < min_words or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, quality."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_documents(rows).select("doc_id", *BASE_STATS, "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, text_col: str = "text", min_words: int = 1) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns.

    A text of few words is not rejected for that alone: length is one vote among others.
    """
    mark = "_q_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return score_documents(docs, text_col, prefix=mark, min_words=min_words).where(F.col(mark + "kept")).select(*docs.columns)

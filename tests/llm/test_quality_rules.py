import collections
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality_rules as qr
from tests.conftest import SF
from tests.llm.helpers import hard_documents, no_documents


def brute(text):
    """The five base statistics, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    again = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_base_statistics_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in qr.judge(docs).collect()}
    for d in docs.collect():
        r, b = got[d.doc_id], brute(d.text)
        assert tuple(r[k] for k in qr.BASE_STATS) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x85\xa0#|é\x1c", max_size=60))
def test_base_statistics_of_any_text(text):
    assert qr.text_stats(text)[:5] == brute(text)


def test_many_distinct_words_do_not_overflow():
    import numpy as np

    ids = np.array([1, 2, 3, 9, 1, 2, 3, 7])
    assert qr.repeat_words(ids, 10) == qr.repeat_words(ids, 3_000_000) == 6


def test_patterns_round_trip():
    for code in (0, 1, 3 ** len(qr.RULES) - 1, 1234):
        out = 0
        for v in qr.votes(code):
            out = out * 3 + v + 1
        assert out == code


def test_estimates_recover_planted_accuracies():
    import numpy as np

    r = np.random.default_rng(4)
    right = np.linspace(0.7, 0.95, len(qr.RULES))
    truth = np.where(r.random(20_000) < 0.7, 1, -1)
    voted = np.where(r.random((20_000, len(right))) < right, truth[:, None], -truth[:, None])
    voted[r.random(voted.shape) < 0.2] = 0
    counts = collections.Counter(int("".join(str(v + 1) for v in row), 3) for row in voted)
    model = qr.estimate(counts)
    assert abs(model["share"] - 0.7) < 0.03
    assert np.abs(np.array(model["right_good"]) - right).max() < 0.03
    p = qr.posterior(model, sorted(counts))
    of = dict(zip(sorted(counts), p, strict=True))
    said = np.array([of[int("".join(str(v + 1) for v in row), 3)] >= 0.5 for row in voted])
    assert (said == (truth > 0)).mean() > 0.97


def test_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in qr.judge(docs).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in got if labels[r.doc_id]]
    assert sum(good) >= 0.99 * len(good)


def test_hard_rows_and_columns(spark):
    docs = hard_documents(spark, [(60, " ".join(f"word{k} is here" for k in range(90)))])
    assert qr.judge(docs).count() == docs.count()
    kept = qr.keep_good(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 60 in ids and not ids & {1, 2, 3, 7, 8}
    assert {r.doc_id for r in qr.keep_good(docs, min_words=50).collect()} == {60}


def test_short_texts_are_judged_by_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in qr.keep_good(docs).collect()}
    for good, least, most in ((1, 0.99, 1), (0, 0, 0.05)):
        share = [d in kept for d, y in labels.items() if y == good]
        assert least <= sum(share) / len(share) <= most


def test_variety_has_a_vote_at_any_length():
    rule = dict(qr.RULES)["variety"]
    stats = lambda n, distinct: {"n_words": n, "n_distinct": distinct}
    for n in (50, 500, 5_000, 500_000):
        assert rule(stats(n, int(n**0.9))) == 1 and rule(stats(n, int(n**0.7))) == 0 and rule(stats(n, int(n**0.5))) == -1
    assert rule(stats(1, 1)) == 1


def test_empty_table(spark):
    assert qr.judge(no_documents(spark)).collect() == []
    assert qr.keep_good(no_documents(spark)).collect() == []


def test_no_counts_give_the_starting_values():
    assert qr.estimate({})["share"] == pytest.approx(0.8)

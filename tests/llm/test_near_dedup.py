import collections
import random
import re

import numpy as np
import pytest

from tessella.llm import near_dedup as nd
from tests.llm.helpers import hard_documents, no_documents, texts_of

SF1 = "/root/testdata/sf0.1"


def brute(rows, words):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in holders[g] if j > i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def linked(docs, words=2):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.link_documents(docs, words).collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_equals_brute_force_on_all_documents(spark, words):
    """10,000 documents: every link and no other, a recall of 1."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    assert linked(docs, words) == brute(texts_of(SF1), words)


def test_chains_large_groups_and_short_texts(spark):
    r = random.Random(1)
    rows, vocabulary = [], [f"w{k}" for k in range(2000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    for k in range(300):  # a drifting chain: neighbours are close, ends are not
        base = list(base)
        base[r.randrange(120)] = r.choice(vocabulary)
        rows.append((k, " ".join(base)))
    hot = [r.choice(vocabulary) for _ in range(200)]
    for k in range(300, 700):  # many different texts close to one
        copy = list(hot)
        for _ in range(r.randrange(12)):
            copy[r.randrange(200)] = r.choice(vocabulary)
        rows.append((k, " ".join(copy)))
    for k in range(700, 1000):  # short texts that share a frequent pair
        rows.append((k, " ".join(["of", "the", *(r.choice(vocabulary[:40]) for _ in range(r.randrange(1, 12)))])))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs) == brute(sorted(rows), 2)


def test_hard_rows(spark):
    out = nd.link_documents(hard_documents(spark), 2).collect()
    assert len(out) == 15
    got = {r.doc_id: r for r in out}
    assert all(got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3))
    assert got[5].component_id == got[6].component_id == 5 and not got[6].kept
    assert got[7].component_id == got[8].component_id == 7
    assert sorted(r.component_id for r in out if r.doc_id in (9, 10)) == [9, 9, 10, 10]
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]


def test_empty_table_and_columns(spark):
    assert nd.link_documents(no_documents(spark), 2).collect() == []
    docs = hard_documents(spark)
    kept = nd.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "5", "7", "9", "10", "11"])


def test_registers_estimate_similarity():
    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        js = []
        for _ in range(30):
            common, rest = r.integers(0, 2**63, 1000, np.uint64), r.integers(0, 2**63, 2000, np.uint64)
            n = int(1000 * share)
            other = round((1000 - n) / 2)
            a, b = (np.unique(np.concatenate([common[:n], x])) for x in (rest[:other], rest[1000 : 1000 + other]))
            js.append(nd.estimated(nd.registers(a)[None], nd.registers(b)[None])[0])
        assert abs(np.mean(js) - share) < 0.04


def test_difference():
    a = np.array([1, 3, 5], np.uint64)
    assert nd.difference(a, np.array([3, 4, 5, 9], np.uint64)).tolist() == [1, 4, 9]
    assert nd.difference(a, np.empty(0, np.uint64)).tolist() == [1, 3, 5]
    assert nd.difference(a, a).tolist() == []


def test_small_sets_fill_their_registers():
    r = np.random.default_rng(4)
    for n in (1, 2, 9, 40, 300):
        s = np.unique(r.integers(0, 2**63, n, np.uint64))
        assert (nd.registers(s) > 0).all()
        assert (nd.registers(s) == nd.registers(s[::-1].copy())).all()
    js = []
    for _ in range(60):  # 8 of 10 elements in common: as likely to agree as large sets
        both = r.integers(0, 2**63, 10, np.uint64)
        js.append(nd.estimated(nd.registers(both[:9])[None], nd.registers(both[1:])[None])[0])
    assert abs(np.mean(js) - 0.8) < 0.03


def edited_copies(copies, length=80, edits=(1, 2, 3, 4), seed=5, deletions=False):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    rows = []
    for k in range(copies):
        copy = list(base)
        for at in sorted(r.sample(range(length), r.choice(edits)), reverse=True):
            copy[at : at + 1] = [] if deletions and r.random() < 0.5 else [f"e{r.randrange(10**9)}"]
        rows.append((k, " ".join(copy)))
    return rows


def test_edited_copies_of_one_text_equal_brute_force(spark):
    for words in (2, 5):
        for deletions in (False, True):
            rows = edited_copies(400, deletions=deletions)
            assert linked(spark.createDataFrame(rows, "doc_id long, text string"), words) == brute(rows, words)


def test_pairs_of_edited_copies_do_not_grow_with_the_square(spark, monkeypatch):
    made = []
    kept = nd._of_differences
    monkeypatch.setattr(nd, "_of_differences", lambda *a: made.append(kept(*a)) or made[-1])
    seen = []
    for copies in (400, 800):
        made.clear()
        counted = []
        close = nd._close
        monkeypatch.setattr(nd, "_close", lambda pairs, *a: (counted.append(pairs.count()), close(pairs, *a))[1])
        linked(spark.createDataFrame(edited_copies(copies), "doc_id long, text string"), 5)
        monkeypatch.setattr(nd, "_close", close)
        seen.append(counted[-1])
    assert seen[1] <= 2 * seen[0] + 1000


def test_unlike_texts_around_one_passage_equal_brute_force(spark):
    r = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(250):  # half of each text is one passage, and some are close copies of others
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        rows.append((3 * k, " ".join(passage + own)))
        if k % 3 == 0:
            own[r.randrange(60)] = "other"
            rows.append((3 * k + 1, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs, 5) == brute(rows, 5)


def test_texts_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " more"), (3, b + " more"), (7, "alone"), (7, "alone"), (8, None), (8, "some words")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(3, 40, 3, True), (5, 39, 3, False), (5, 39, 3, False), (6, 40, 3, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (8, 1, 8, True)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in nd.keep_first(docs, 2).collect()) == [3, 7, 8]

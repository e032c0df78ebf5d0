import random

import pytest

from tessella.llm import decontam as dc
from tests.conftest import SF
from tests.llm.helpers import hard_documents, no_documents, texts_of


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def slow_score(item, text):
    """Smith-Waterman cell by cell."""
    row, best = [0] * (len(text) + 1), 0
    for w in item:
        new = [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (dc.HIT if w == x else dc.MISS), row[j + 1] + dc.GAP, new[j] + dc.GAP))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_the_plain_recurrence():
    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        item, text = ([r.randrange(6) for _ in range(r.randrange(1, 20))] for _ in range(2))
        score, first, end = dc.align(np.array(item), np.array(text))
        assert score == slow_score(item, text)
        if score:
            assert slow_score(item, text[first:end]) == score


def test_finds_every_verbatim_item_and_nothing_else(spark, benchmark):
    """Brute force: every item against every text as runs of words."""
    items = {r.item_id: " ".join(dc.words_of(r.text)) for r in benchmark.collect()}
    want = {(i, k) for i, t in texts_of(SF) for k, x in items.items() if f" {x} " in f" {' '.join(dc.words_of(t))} "}
    got = dc.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), benchmark).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in got if r.score == 1} == want
    assert len(got) - len(want) <= 2


def edits(words, how, r):
    noise = lambda: f"zz{r.randrange(10**6)}"
    if how == "replace":
        return [noise() if k % 7 == 3 else w for k, w in enumerate(words)]
    if how == "drop":
        return [w for k, w in enumerate(words) if k % 8 != 5]
    if how == "insert":
        return [x for k, w in enumerate(words) for x in ([w, noise()] if k % 6 == 2 else [w])]
    return [w.upper() + "!!" for w in words]


@pytest.mark.parametrize("how", ["replace", "drop", "insert", "shout"])
def test_finds_edited_copies(spark, benchmark, how):
    r = random.Random(how)
    hosts = [t for _, t in texts_of(SF, 40)]
    items = benchmark.orderBy("item_id").collect()
    rows = [(k, f"{h[:400]} {' '.join(edits(i.text.split(), how, r))} {h[400:900]}") for k, (i, h) in enumerate(zip(items, hosts, strict=True))]
    got = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    found = {r.doc_id for r in got if r.item_id == items[r.doc_id].item_id}
    assert len(found) >= 38


def partly(words, how):
    if how == "half":
        return words[: (len(words) + 1) // 2]
    return [f"zz{k}" if k % how == how - 1 else w for k, w in enumerate(words)]


@pytest.mark.parametrize("beside", [False, True])
@pytest.mark.parametrize("how", [4, 5, "half"])
def test_finds_copies_that_lack_an_items_rarer_half(spark, benchmark, how, beside):
    """Every 4th or 5th word replaced, or half of the item quoted; alone or where another document holds the item verbatim."""
    hosts = [t for _, t in texts_of(SF, 40)]
    items = [(r.item_id, dc.words_of(r.text)) for r in benchmark.orderBy("item_id").collect()]
    edited = [(k, f"{h[:400]} {' '.join(partly(w, how))} {h[400:900]}") for k, ((_, w), h) in enumerate(zip(items, hosts, strict=True))]
    whole = [(100 + k, f"{h[:300]} {' '.join(w)}") for k, ((_, w), h) in enumerate(zip(items, hosts, strict=True))] if beside else []
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(edited + whole, "doc_id long, text string"), benchmark).collect()}
    want = {(k, i) for k, (i, w) in enumerate(items) if slow_score(w, partly(w, how)) >= dc.HIT * max(dc.LEAST * len(w), min(dc.LEAST_WORDS, len(w)))}
    assert len(want) >= 20 and want <= got


def test_bounds_leave_out_no_alignment():
    import numpy as np

    r = random.Random(5)
    mark = np.zeros(13, bool)
    for _ in range(500):
        item = np.array([r.randrange(12) for _ in range(r.randrange(1, 20))])
        text = np.array([r.randrange(-1, 12) for _ in range(r.randrange(1, 40))])
        assert dc._bound(item, text, mark) >= dc.align(item, text)[0] and not mark.any()


def test_every_pair_with_a_shared_seed_is_judged_as_by_whole_alignment(benchmark):
    block = dc.Items([(r.item_id, r.text) for r in benchmark.orderBy("item_id").collect()])
    pairs = 0
    for _, t in texts_of(SF):
        words = block.numbered(t)
        near = {k for g in block.found(words)[0].tolist() for k, _ in block.places[g]}
        pairs += len(near)
        want = set()
        for k in near:
            item = block.words[k]
            if dc.align(item, words)[0] >= dc.HIT * max(dc.LEAST * len(item), min(dc.LEAST_WORDS, len(item))) - 1e-6:
                want.add(k)
        assert {k for k, *_ in dc.leaks_in(block, t)} == want
    assert pairs > 30


def test_an_item_in_a_third_of_all_rows_is_still_found(spark, benchmark):
    item = benchmark.where("item_id = 3").first()
    rows = [(k, f"{t[:300]} {item.text}" if k % 3 == 0 else t[:300]) for k, (_, t) in enumerate(texts_of(SF, 300))]
    got = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {r.doc_id for r in got.where("item_id = 3").collect()} == {k for k in range(300) if k % 3 == 0}


def test_blocks_give_the_same(spark, benchmark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, dc.find_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 15)
    assert sorted(map(tuple, dc.find_leaks(docs, benchmark).collect())) == whole


def test_hard_rows(spark, benchmark):
    item = benchmark.first()
    docs = hard_documents(spark, [(50, item.text), (None, f"so: {item.text}")])
    tests = spark.createDataFrame([(item.item_id, item.text), (None, None), (7000, ""), (7001, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, tests).collect()}
    assert {(50, item.item_id), (None, item.item_id)} <= got and (4, 7001) in got
    kept = dc.drop_leaks(docs, tests.where(f"item_id = {item.item_id}"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(1, 12))


def test_empty_tables(spark, benchmark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert dc.find_leaks(no_documents(spark), benchmark).collect() == []
    assert dc.find_leaks(docs, benchmark.where("false")).collect() == []
    assert dc.drop_leaks(docs, benchmark.where("false")).count() == docs.count()


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "string", "date"])
def test_item_ids_of_any_type(spark, kind):
    from pyspark.sql import functions as F

    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([("2020-01-01" if kind == "date" else "7", passage)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([(1, f"and {passage} then"), (2, "nothing")], "doc_id long, text string")
    got = dc.find_leaks(docs, items)
    assert dict(got.dtypes)["item_id"] == kind and [(r.doc_id, r.item_id) for r in got.collect()] == [(1, items.first().item_id)]


def test_blocks_are_bounded_in_characters(spark, monkeypatch, benchmark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(dc.find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 4000)
    assert len(list(dc._blocks(benchmark, "item_id", "text"))) > 1
    assert sorted(dc.find_leaks(docs, benchmark).collect()) == whole


def test_recall_against_full_alignment(spark, benchmark):
    """Every item aligned with every whole document of a sample that holds edited copies: what scores enough is found."""
    import numpy as np

    r = random.Random(11)
    items = {x.item_id: x.text for x in benchmark.collect()}
    docs = texts_of(SF)[::12]
    for n, (k, t) in enumerate(sorted(items.items())[:24]):
        copy = edits(t.split(), ("replace", "drop", "insert", "shout")[n % 4], r)
        docs.append((10_000 + n, f"{docs[n][1]} {' '.join(copy)} {docs[n + 1][1]}"))
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in dc.words_of(t)], np.int64)
    codes = {k: coded(t) for k, t in items.items()}
    want = {}
    for i, t in docs:
        text = coded(t)
        for k, item in codes.items():
            if len(item) and len(text) and np.isin(item, text).sum() >= dc.LEAST * len(item):  # else no alignment scores enough
                score = dc.align(item, text)[0]
                if score >= max(dc.LEAST * dc.HIT * len(item), dc.HIT * min(dc.LEAST_WORDS, len(item))):
                    want[i, k] = score / (dc.HIT * len(item))
    got = {(x.doc_id, x.item_id): x.score for x in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert len(want) >= 24 and set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert sum(abs(got[p] - want[p]) < 1e-9 for p in got) >= 0.95 * len(got)

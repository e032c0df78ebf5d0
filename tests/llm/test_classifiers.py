"""The three learned scorers: held-out accuracy, exactness of their inner parts, hard rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import langid, quality_cnn, queries, toxicity
from tests.conftest import SF
from tests.llm.helpers import LONG, hard_documents, no_documents

SF1 = "/root/testdata/sf0.1"


def labels_of(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}


def held(rows, k, rest):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == rest)
        assert 0 <= r.score <= 1
    return [r for r in rows if r.held_out]


def test_toxicity_held_out(spark):
    rows = held(queries.op3_toxicity(spark, SF1).collect(), 3, 1)
    label = labels_of(spark, "toxic")
    said = [(label[r.doc_id], r.predicted, r.score) for r in rows if r.doc_id in label]
    assert len(rows) > 3000 and all(p == (s >= 0.7) for _, p, s in said)
    found = [p for y, p, _ in said if y]
    assert np.mean(found) > 0.8
    assert sum(p for y, p, _ in said if not y) <= 3


def plain_vector(e, text):
    """{term number: weight} of a text by plain counting, of length 1."""
    count = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for t in (w, *(w[:n] + "-" for n in (4, 5, 6, 7) if len(w) > n)):
            count[t] += 1
    out = {}
    for t, n in count.items():
        if t in e.place:
            first, most = int(e.first[e.place[t]]), int(e.most[e.place[t]])
            out |= {first + k: e.weight[first + k] for k in range(min(n, most))}
    norm = math.sqrt(sum(w * w for w in out.values()))
    return {k: w / norm for k, w in out.items()}


def plain_nearest(vector, vectors, leave=-1):
    cosine = [round(sum(w * u.get(t, 0) for t, w in vector.items()), 9) for u in vectors]
    return sorted((-c, j) for j, c in enumerate(cosine) if c > 0 and j != leave)[: toxicity.K]


def test_toxicity_neighbours_are_exact():
    r = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("vile", "rude", "kind", "calm", "fair") for b in "abcdefgh"] + [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = []
    for k in range(900):
        y = int(r.random() < 0.4)
        bag = [*r.choice(words[: 16 if y else 40], r.integers(1, 9)), *r.choice(words[40:], r.integers(0, 6))]
        rows.append((k, " ".join(bag), y))
    e = toxicity.Examples(rows)
    assert e.n_blocks > 5 and e.tied and len(e.ids) == 900 and len(e.post_example) and e.dense.shape[1]
    text = dict((k, t) for k, t, _ in rows)
    vectors = [plain_vector(e, text[i]) for i in e.ids]
    got = e.nearest([e.terms[e.starts[k] : e.starts[k + 1]].astype(np.int64) for k in range(900)], list(range(900)))
    for k in range(0, 900, 7):
        want = plain_nearest(vectors[k], vectors, k)
        assert np.allclose([c for _, c in got[k]], [-c for c, _ in want], atol=1e-8)
        sure = {j for c, j in want if -c > -want[-1][0] + 1e-8}
        assert sure <= {j for j, _ in got[k]}


def test_toxicity_scores_equal_plain_votes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    e = toxicity.fit(docs, labels, queries._learn(3, 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    vectors = [plain_vector(e, text[i]) for i in e.ids]
    x, y = zip(*e.steps, strict=True)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, e).collect()}
    assert len(got) == len(text)
    for i in sorted(text)[::5]:
        if not re.search(r"[^\W\d_]", text[i] or ""):
            continue
        near = plain_nearest(plain_vector(e, text[i]), vectors)
        weight = [1 / (max(0, 1 + c) + toxicity.NEAR) for c, _ in near]
        m = toxicity.PRIOR_VOTES / (1 + toxicity.NEAR)
        vote = (sum(w * e.labels[j] for w, (_, j) in zip(weight, near, strict=True)) + m * e.prior) / (sum(weight) + m)
        cosines = [float(s.split(":")[2]) for s in got[i].evidence.split(", ")]
        assert np.allclose(cosines, [-c for c, _ in near[:3]], atol=6e-4)
        if len({c for c, _ in near}) == len(near):  # ties at the last place may fall either way
            assert got[i].score == pytest.approx(float(np.interp(vote, x, y)), abs=1e-4)
    assert all(r.evidence for r in got.values() if any(w in e.place for w in toxicity.words_of(text[r.doc_id])))


def test_toxicity_holds_every_term_and_occurrence():
    words = [a + b + c for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstvwxyz"]
    e = toxicity.Examples([(k, " ".join(words) if k % 2 else "calm", k % 2) for k in range(80)])
    assert len(words) == 480 and {(w, 1) for w in words} == set(e.tied) and {*words, "calm"} == set(e.place)
    e = toxicity.Examples([(k, "vile " * (7 if k % 2 else 4), k % 2) for k in range(80)])
    assert set(e.tied) == {("vile", 5), ("vile", 6), ("vile", 7)} and e.place == {"vile": 0} and e.most.tolist() == [7]
    (bad, said), (good, _), (none, bare) = toxicity.Scorer(e).scores(["vile " * 7, "vile " * 4, "unknown"])
    assert bad > 0.7 > 0.3 > good and said and none == e.bare and not bare


def test_quality_held_out(spark):
    rows = held(queries.op4_quality_classifier(spark, SF1).collect(), 5, 0)
    label = labels_of(spark, "quality")
    said = [(label[r.doc_id], r.predicted) for r in rows if r.doc_id in label]
    assert np.mean([p for y, p in said if y]) > 0.97
    assert np.mean([p for y, p in said if not y]) < 0.25


def test_chunks_cover_whole_texts():
    for n in (0, 1, 7, 8, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(33 + k % 90) for k in range(n))
        chunks, windows = quality_cnn.chunks_of(text)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        back = bytearray(chunks[0].tobytes())
        for c in chunks[1:]:
            back += c.tobytes()[quality_cnn.OVERLAP :]
        assert bytes(back[:n]) == text.encode() and not any(back[n:])
        assert len(chunks) == 1 + max(0, -(-(n - quality_cnn.CHUNK) // step)) and (windows >= 1).all()


def test_network_gradients_are_right():
    net = quality_cnn.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = [quality_cnn.chunks_of(t) for t in ("some words here " * 60, "!!! $$$ ab", "")]
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        z = np.array([net.logits(c, n).mean() for c, n in data])
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum() / len(data))

    grads = net._gradients(data, y, w)
    r = np.random.default_rng(2)
    for name, at in [("out", (3,)), ("base", (0,)), ("bias", (5,)), ("filters", (17, 4)), ("filters", (40, 9)), ("embed", (ord("s"), 2)), ("embed", (ord("$"), 6))]:
        old, step = net.p[name][at], 1e-6 * (1 + r.random())
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_network_equals_a_plain_convolution(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality_cnn.fit(docs, labels, queries._learn(5, 0), rows=120)
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    texts = [r.text for r in docs.orderBy("doc_id").limit(4).collect()] + ["", None, "kurz", "x" * 513, "é" * 300]

    def plain(text):
        raw, logits = (text or "").encode(), []
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        for lo in range(0, max(1, len(raw) - quality_cnn.OVERLAP), step):
            chunk = raw[lo : lo + quality_cnn.CHUNK] + bytes(max(0, lo + quality_cnn.CHUNK - len(raw)))
            best = [-math.inf] * quality_cnn.FILTERS
            for at in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STEP):
                if at and lo + at >= len(raw):
                    break
                x = [v for byte in chunk[at : at + quality_cnn.WIDTH] for v in p["embed"][byte]]
                for f in range(quality_cnn.FILTERS):
                    best[f] = max(best[f], sum(a * w[f] for a, w in zip(x, p["filters"], strict=True)))
            logits.append(sum(math.tanh(b + c) * o for b, c, o in zip(best, p["bias"], p["out"], strict=True)) + p["base"][0])
        z = net.scale * sum(logits) / len(logits) + net.shift
        return 1 / (1 + math.exp(-z))

    assert np.allclose(net.score(texts), [plain(t) for t in texts], atol=1e-4)


def test_scores_do_not_depend_on_the_batch():
    net = quality_cnn.Network(3)
    texts = ["a b c", LONG[:70_000], None, "x" * 2000]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)


def test_language_held_out(spark):
    rows = held(queries.op8_language_id(spark, SF1).collect(), 4, 2)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.99


def test_kernel_is_shared_presence():
    grams = lambda t: np.unique(np.concatenate([np.empty(0, np.uint32), *langid.gram_places(t)]))
    assert len(grams("123 !? ")) == 0 and len(grams(None)) == 0
    assert set(grams("Über")) == set(grams("über")) and len(grams("ab")) == 3
    assert len(grams("a1b")) == len(grams("a  b")) == len(grams("a b"))
    long = "grüße und küsse " * 90_000
    assert set(grams(long)) >= set(grams("grüße und küsse "))


def plain_grams(text):
    """Places of the n-grams of a text by plain string handling."""
    low = re.sub(" +", " ", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text))
    out = set()
    for n in range(1, 5):
        for k in range(len(low) - n + 1):
            code = 0
            for m, c in enumerate(low[k : k + n], 1):
                code = (code * 0x9E3779B1 + ord(c) + m) % 2**32
            out.add(code * 0x9E3779B1 % 2**32 >> 14)
    return out if any(c.isalpha() for c in text) else set()


def test_languages_equal_a_plain_kernel_and_ridge(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500 and lang is not null").orderBy("doc_id").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs[:80]]
    model = langid.Kernel(rows)
    grams = [plain_grams(t) for _, t, _ in rows]
    ok = [k for k, g in enumerate(grams) if g]
    langs = sorted({rows[k][2] for k in ok})
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    queues = [[k for k in ok if rows[k][2] == x] for x in langs]
    marks = [q[i] for i in range(80) for q in queues if i < len(q)][:20]
    value, vector = np.linalg.eigh(np.array([[kernel(grams[a], grams[b]) for b in marks] for a in marks]))
    keep = value > 1e-6 * value.max()
    half = vector[:, keep] / np.sqrt(value[keep])
    mapped = lambda g: np.append(np.array([kernel(g, grams[b]) for b in marks]) @ half, 1)
    x = np.array([mapped(grams[k]) for k in ok])
    w = np.array([len(ok) / (len(langs) * sum(rows[j][2] == rows[k][2] for j in ok)) for k in ok])
    y = np.array([[1 if rows[k][2] == lang else -1 for lang in langs] for k in ok])
    solved = np.linalg.solve(x.T @ (x * w[:, None]) + langid.RIDGE * len(ok) * np.eye(x.shape[1]), x.T @ (y * w[:, None]))
    texts = [r.text for r in docs[80:]] + ["", None, "123"]
    for t, (lang, score) in zip(texts, model.predict(texts), strict=True):
        g = plain_grams(t or "")
        if not g:
            assert (lang, score) == ("und", 0.0)
            continue
        f = mapped(g) @ solved
        e = np.exp(langid.SHARP * (f - f.max()))
        assert lang == langs[int(f.argmax())] and score == pytest.approx(e.max() / e.sum(), abs=1e-4)


def test_hard_rows(spark):
    docs, n = hard_documents(spark), 15
    examples = toxicity.Examples([(k, t, y) for k, (t, y) in enumerate([("you vile thing", 1), ("a calm day", 0), (None, 0), ("", 0)] * 8)])
    got = toxicity.score_documents(docs, examples).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    net = quality_cnn.Network().train([(k, t, y) for k, (t, y) in enumerate([("words", 1), ("!!", 0), (None, 0)])])
    assert len(quality_cnn.score_documents(docs, net).collect()) == n
    kernel = langid.Kernel([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "...", "xx")])
    pred = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, kernel).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= pred and kernel.languages == ["de", "en"]


def test_nothing_to_learn_from(spark):
    docs = hard_documents(spark)
    assert {r.score for r in toxicity.score_documents(docs, toxicity.Examples([])).collect()} == {0.5}
    assert {r.score for r in quality_cnn.score_documents(docs, quality_cnn.Network().train([])).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(docs, langid.Kernel([])).collect()} == {"und"}
    for one in (0, 1):
        toxicity.Examples([(1, "a b", one)]), quality_cnn.Network().train([(1, "a b", one)])


def test_empty_tables(spark):
    docs = no_documents(spark)
    assert toxicity.score_documents(docs, toxicity.Examples([])).collect() == []
    assert quality_cnn.score_documents(docs, quality_cnn.Network()).collect() == []
    assert langid.identify(docs, langid.Kernel([])).collect() == []


def test_sample_is_bounded_and_skips_nulls(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "t" * k) for k in range(100)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 if k % 5 else None) for k in range(100)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, F.lit(True), "toxic", "doc_id", "text", 20, 50)
    assert len(got) <= 20 and all(i % 5 and i <= 50 and y == i % 2 for i, _, y in got)

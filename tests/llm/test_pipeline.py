"""Each stage against plain Python on its own input, and the run as a whole."""

import hashlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as cp
from tessella.llm import decontam, quality_rules, secret_scan, sp_codec
from tests.conftest import SF
from tests.llm.helpers import hard_documents, no_documents
from tests.llm.test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(cp.STAGES):
        place = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, str(SF)).write.parquet(place)
        out.append((docs, spark.read.parquet(place)))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [b.columns for _, b in stages[:-1]] == [names] * 4
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]


def test_quality_stage(stages):
    before, after = map(texts, stages[0])
    stats = {i: quality_rules.text_stats(t) for i, t in before.items()}
    counts = {}
    for s in (s for s in stats.values() if not quality_rules.base_failed(s, 1)):
        counts[quality_rules.pattern(s)] = counts.get(quality_rules.pattern(s), 0) + 1
    model = quality_rules.estimate(counts)
    want = {i for i, s in stats.items() if not quality_rules.base_failed(s, 1) and quality_rules.posterior(model, [quality_rules.pattern(s)])[0] >= 0.5}
    assert set(after) == want and len(want) > 0.7 * len(before)


def test_near_dedup_stage(stages):
    before, after = map(texts, stages[1])
    assert set(after) == {i for i, (_, c) in brute(sorted(before.items()), 5).items() if i == c}


def test_decontamination_stage(spark, stages):
    before, after = map(texts, stages[2])
    items = [" ".join(decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verbatim = {i for i, t in before.items() if any(f" {x} " in f" {' '.join(decontam.words_of(t))} " for x in items)}
    assert verbatim and set(after) <= set(before) - verbatim and len(set(before) - verbatim - set(after)) <= 2


def test_secret_stage(stages):
    before, after = map(texts, stages[3])
    assert set(before) == set(after)
    for i, t in before.items():
        spans = secret_scan.brute_spans(t)
        assert (after[i] == t) == (not spans) and not secret_scan.brute_spans(after[i])
    assert all(r.n_chars == len(r.text) for r in stages[3][1].collect())


def test_encode_stage(stages):
    before, after = texts(stages[4][0]), {r.doc_id: r for r in stages[4][1].collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=sp_codec.default_model())
    assert set(after) == set(before)
    for i, t in before.items():
        assert after[i].ids_sha256 == hashlib.sha256(np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(cp.run(spark, str(SF)).collect()) == sorted(stages[-1][1].collect())


def test_hard_rows_pass_all_stages(spark):
    words = " ".join(f"word{k} is here" for k in range(90))
    docs = hard_documents(spark, [(None, words), (70, words + " token = abcdefgh12345"), (71, words + " token = abcdefgh12345")])
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, str(SF))
    ids = sorted(str(r.doc_id) for r in docs.collect())
    assert {"70", "None"} <= set(ids) and not {"1", "2", "3", "7", "8", "71"} & set(ids) and ids.count("9") <= 1
    assert "[SECRET]" in docs.where("doc_id = 70").first().text
    assert cp.STAGES[-1][1](spark, docs, str(SF)).count() == len(ids)


def test_empty_documents_pass_all_stages(spark):
    docs = no_documents(spark)
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, str(SF))
        assert out.columns == docs.columns
        docs = out
    assert cp.STAGES[-1][1](spark, docs, str(SF)).collect() == []

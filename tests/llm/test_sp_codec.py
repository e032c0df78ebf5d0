import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import sp_codec as sc
from tests.conftest import SF
from tests.llm.helpers import hard_documents, no_documents, texts_of

MODEL = open(sc.default_model(), "rb").read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def same(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    got = sc.prefix_table(MODEL).encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert sc.prefix_table(MODEL).decode(got) == library.decode(ids)


def test_all_documents_as_the_library(spark, library):
    got = {r.doc_id: r for r in sc.encode_decode_digests(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for i, text in texts_of(SF):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="   ▁\n\t\x00éabthe inngo<s>À漢字\U0001f600123_#=", max_size=80) | st.text(max_size=40))
def test_any_text_as_the_library(library, text):
    same(library, text)


@pytest.mark.parametrize("text", ["", None, " ", "  ", " " * 17, " " * 40 + "x", "x" + " " * 33, "▁", "\n\n", "a\nb", "　", "<s></s><unk><0x41>", "a" * 5000, "aab" * 3000, "\U0001f468‍\U0001f469"])
def test_odd_texts(library, text):
    same(library, text)


def test_compatibility_is_merging_from_scratch(library):
    table = sc.prefix_table(MODEL)
    r = np.random.default_rng(1)
    ids = sorted(table.halves)
    tokens = [i for i, p in enumerate(table.piece) if i in table.halves or p in table.chars]
    del ids
    for a, b in zip(r.choice(tokens, 3000).tolist(), r.choice(tokens, 3000).tolist(), strict=True):
        assert table._stays_apart(a, b) == (table._merged(table.piece[a] + table.piece[b]) == [table.piece[a], table.piece[b]])


def test_hard_rows(spark, library):
    docs = hard_documents(spark)
    got = sc.encode_decode(docs).collect()
    want = sorted((str(r.doc_id), np.array(library.encode(r.text or "", add_bos=True, add_eos=True), "<u4").tobytes()) for r in docs.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    assert sc.encode_decode(no_documents(spark)).collect() == []


def test_caches_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(sc, "CACHED_CUTS", 50)
    monkeypatch.setattr(sc, "CACHED_PAIRS", 20)
    monkeypatch.setattr(sc, "SLICE", 10)
    table = sc.PrefixTable(MODEL)
    for _, text in texts_of(SF, 20):
        assert np.frombuffer(table.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(table.cuts) <= 60 and len(table.pairs) <= 21

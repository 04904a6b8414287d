import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = T.Counter(PATH, T.whole_tokens(MODEL), 40_000)
ODD = [None, "", " ", "  ", "   a", "a ", "a  b", " \n ", "\n", "▁a▁▁b", "<s> </s> <unk> <0x0A>", "x" * 5000, "日本 語😀", "a\tb\r\nc\x00d", "the the  the", "\xa0a　b"]


def test_the_model_can_be_split():
    assert T.splits_at_blanks(MODEL)
    assert len(T.whole_tokens(MODEL)) > 10_000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n▁<s>0xAtheing.,|é日\x00\r"), max_size=40))
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


@pytest.mark.parametrize("entries", [10**6, 1])
def test_rows(spark, entries):
    T._held.clear()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 2), (3, "a b", 2)], "doc_id long, text string, n_tokens int")
    got = T.token_counts(docs, PATH, limit=3, entries=entries).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(MODEL.encode(r.text or "")), n > 3) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert T.token_counts(docs.limit(0), PATH).count() == 0


def test_query(spark, sf):
    want = {r.doc_id: len(MODEL.encode(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = T.op1_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)

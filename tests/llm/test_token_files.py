import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadloom.llm import common
from leadloom.llm import token_files as T
from leadloom.llm import word_ids as word_ids_module
from leadloom.llm.common import new_path
from leadloom.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "It's DON'T we'll 'S x's", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "ΣΑΣ Σ İstanbul ß ﬁ", "é ́x a.̸ ≠",
    "tab\tnext\x0bv\x0c\x1c\x85\xa0z w", "日本語テキスト 12,345.67 ½ ²", "thor, thor. THOR!! (and) $%& ...", "\x00\x01 ￿ 😀😀 a😀b", "word" * 300, "co-op,- e.g. x.y,", "naïve, Ünter. ǅ, ª.",
]


def expected(texts, end):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_cached_ids_are_the_librarys(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    coder = WordIds(PATH, entries=20_000)
    assert coder.splits
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, coder.dtype).tolist() == expected([text], 0)[0][:-1], text


def test_letters_that_give_marks_keep_their_punctuation():
    """U+0130 lower-cased and U+095C composed give combining marks, which the tokenizer joins with what follows; and every letter there is, before a full stop."""
    texts = ["\u0130.", "\u091c\u095c,", "x\u0130!! \u0130stanbul. a\u095c)"] + [chr(c) + "." for c in range(0x110000) if chr(c).isalpha()]
    coder, library = WordIds(PATH), Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids, w in zip(texts, coder.encode(texts), want) if np.frombuffer(ids, coder.dtype).tolist() != w]
    assert not wrong, (len(wrong), wrong[:20])


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 200):
        counts = {i: int(c) for i, c in enumerate(rng.integers(1, 10**6, n) ** 2)}
        lengths = T.code_lengths(counts)
        if n > 1:
            assert sum(2.0**-b for b in lengths.values()) == 1
        short = T.code_lengths(counts, 8)
        assert max(short.values()) <= 8 and sum(2.0**-b for b in short.values()) <= 1
    assert sorted(T.code_lengths({0: 5, 1: 2, 2: 1, 3: 1}).values()) == [1, 2, 3, 3]
    with pytest.raises(ValueError):
        T.code_lengths(dict.fromkeys(range(9), 1), 3)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 49000)
    lengths = T.code_lengths({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True))})
    data, checkpoints = T.pack(ids, *T.canonical_codes(lengths, max(lengths) + 1))
    assert T.unpack(data, checkpoints, n, T.decode_tables(lengths)).tolist() == ids.tolist()


def test_files_give_every_document_back(spark, monkeypatch):
    texts = ODD + ["same", "same"]
    rows = [(i * 3 if i != 5 else None, t, "x") for i, t in enumerate(texts)] + [(0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    path = new_path(spark, "t")
    T.write_token_files(docs, path, PATH, end_id=1)
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = expected([r[1] for r in ordered], 1)
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == np.cumsum([0] + [len(i) for i in ids[:-1]]).tolist()


def test_empty_table(spark):
    path = new_path(spark, "t")
    T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=1)
    assert T.read_token_files(spark, path).count() == 0


def test_query_matches_the_library(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    start = 0
    want = {}
    for d, ids in zip(docs, expected([d.text for d in docs], 1)):
        want[d.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.op8_token_files(spark, sf).collect()} == want


def test_slices_keep_every_row_in_order(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["", None, "a" * 25, "bb", "ccc", None, "d" * 9, "e", "", "f" * 10]
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], ["text", "n"])
    cut = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), "text"))
    assert [n for b in cut for n in b.column("n").to_pylist()] == [*range(10), 3, 4, 5, 6]
    assert all(sum(len(t or "") for t in b.column("text").to_pylist()[:-1]) < 10 for b in cut)


def test_groups_and_long_pieces_give_the_library_s_ids(monkeypatch):
    monkeypatch.setattr(word_ids_module, "GROUP_CHARS", 40)
    coder = WordIds(PATH, entries=5)
    texts = ["İ, ok", "a" * 300 + " " + "b!" * 90, None, "", "x\n\ny", " ", "word, Word. WORD", "a" * 300, "word"]
    for _ in range(2):
        assert coder.encode(texts) == coder.fresh([t or "" for t in texts])
    assert max(map(len, coder.pieces)) <= word_ids_module.CACHE_CHARS

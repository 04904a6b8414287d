import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leadloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_keys_walk_through_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = P.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def held(rows, texts, length, end):
    """Checks rows against texts (a list of (doc_id, text)); gives the number of sequences."""
    tok = Tokenizer.from_file(PATH)
    docs = sorted((str(d), tuple(tok.encode(t or "", add_special_tokens=False).ids + [end])) for d, t in texts)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    stream = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream.append(r)
        assert at == length or s == max(by_seq)
        assert by_seq[s][0].pad == (0 if at & (at - 1) == 0 else length - at) and by_seq[s][0].sequence_tokens == at
    whole, got = [], None
    for r in stream:
        if r.start == 0:
            got = (str(r.doc_id), [], r.doc_tokens)
            whole.append(got)
        assert got[0] == str(r.doc_id) and len(got[1]) == r.start
        got[1].extend(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted((d, tuple(i)) for d, i, _ in whole) == docs and all(len(i) == n for _, i, n in whole)
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_each_id_lies_in_one_piece(spark):
    texts = [(1, None), (2, ""), (2, ""), (3, "a long text, again " * 40), (None, "no id"), (5, "same words"), (6, "same words"), (2, "x\ny")]
    docs = spark.createDataFrame([(d, t, 9) for d, t in texts], "doc_id long, text string, key int")
    rows = P.packed(docs, PATH, end_id=2, length=16).collect()
    held(rows, texts, 16, 2)


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0


def test_query_packs_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = P.packed(spark.read.parquet(f"{sf}/documents.parquet"), PATH, 2).collect()
    held(rows, docs, 4096, 2)
    assert P.op6_packing(spark, sf).count() == len(rows)


def test_pieces_kept_do_not_change_the_result(spark, monkeypatch):
    """The bound is a setting, and the query has its own, larger one."""
    docs = spark.createDataFrame([(i, f"some words of text {i} and {i % 3}, again") for i in range(40)], "doc_id long, text string")
    assert sorted(P.packed(docs, PATH, 2, 16, kept=3).collect()) == sorted(P.packed(docs, PATH, 2, 16).collect())
    asked = []
    monkeypatch.setattr(P, "packed", lambda docs, *a, **kw: asked.append(kw["kept"]) or docs.withColumn("ids", docs.text))
    P.op6_packing(spark, "/root/testdata/sf0.001")
    assert asked == [P.KEPT] and P.KEPT > P.CACHE_ENTRIES

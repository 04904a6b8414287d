import os
import re
import sys

import public_tokenizers
from test_decontamination import brute as contaminated
from test_near_dedup import brute as near
from test_packing import held
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as C  # noqa: E402
from leadloom.llm import quality  # noqa: E402
from leadloom.llm.common import shared_dir, written  # noqa: E402


def test_each_stage_does_its_work(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r.predicted for r in quality.op2_quality(spark, sf).collect()}
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        got = [r.doc_id for r in docs.collect()]
        assert len(got) == len(set(got))
        if name == "quality":
            want = {d for d in before if score[d]}
        elif name == "exact_dedup":
            best = {}
            for d, t in before.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(t or ""), d))
            want = {d for _, d in best.values()}
        elif name == "near_dedup":
            want = {d for d, _, _, kept in near(list(before.items())) if kept}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = {d for d, _, hit, _ in contaminated(list(before.items()), items) if not hit}
        assert set(got) == want and 0 < len(want) < len(before), name
        before = {d: before[d] for d in got}
    rows = C.STAGES[-1][1](spark, docs, sf).collect()
    held(rows, list(before.items()), 4096, 2)
    assert C.run(spark, sf).count() == len(rows)
    assert Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))


def folders(spark):
    """Top folders of our tables in the shared place."""
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {d for d in os.listdir(root) if not d.startswith(".")}


TEXTS = [None, "", "one two three", "one two  three", "The ring is red and it was sold to a shop in the old town by the river. " * 6, "The ring is red and it was sold to a shop in the old town by the river. " * 6 + "x"]


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    columns = "doc_id long, text string, row string, row_key int, item_id long, score double"
    rows = [(i if i != 2 else None, t, None, i, 5, 0.5) for i, t in enumerate(TEXTS)] * 2
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "never seen words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), folders(spark)
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    kept = {r.text for r in docs.collect()}
    # one of the empty ones, one of the short ones, the longer of the near copies or the first one
    assert len(docs.collect()) == len(kept) == 3 and None in kept | {None if "" in kept else 0}
    pieces = C.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    left = {d for d in folders(spark) - before if d.split("-")[0] in {f.__name__ for _, f in C.STAGES}}
    assert {d.split("-")[0] for d in left} == {"pack"} and len(left) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0

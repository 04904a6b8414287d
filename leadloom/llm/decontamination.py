"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: each segment (a batch of training documents) is one row that holds, for each of its
terms, the sorted positions of the term's words in the segment, and the documents' ids and word counts. Positions skip
GAP between documents, so that nothing matches across two. Terms outside the test vocabulary are left out while that
vocabulary is small enough to send along; otherwise every term is indexed.

A phrase is searched from its rarest term in the whole corpus on: each term's positions, less its place in the phrase,
are intersected in turn, until none or exact occurrences are left. A proximity search, beside it, asks for all distinct
terms, in any order, among `slop` words more than the phrase has; its finds are columns of their own. The test set is
searched in blocks of bounded size, each of which gives the documents with finds alone.

Words: runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII. Null and empty texts have no words;
a null item_id counts as ''; items are told apart by id, so rows that repeat an id are one item; repeated documents are
judged one by one; other columns are ignored or, in decontaminated(), returned as they are. Without documents there are
no rows, without items no finds; a text of any length is one document of one segment.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, fresh, text_or_empty, with_row_key, written

#: Words of a window; words that positions skip between documents (more than any window with its slop).
WINDOW, GAP = 10, 256
#: Words more than a window has among which the query looks for its terms.
SLOP = 2
#: Bytes of test text searched at a time; bytes of test vocabulary up to which the index is restricted to it.
TEST_BYTES, VOCABULARY_BYTES = 8 << 20, 64 << 20

#: Bytes to blanks, but for digits, letters (to lower case) and bytes of characters beyond ASCII.
TO_WORDS = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SEGMENTS = "segment long, rows array<long>, doc_ids array<long>, n_words array<long>, terms array<binary>, postings array<binary>"
SPANS = "array<struct<start: long, end: long>>"
HITS = f"row long, items array<string>, spans {SPANS}, near_items array<string>, near_spans {SPANS}"


def words(text: str | None) -> list[bytes]:
    """A text's words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def windows(text: str | None, n: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of n words; a shorter text is one window; a text without words has none."""
    found = words(text)
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def build_index(docs: DataFrame, vocabulary: set[bytes] | None) -> DataFrame:
    """The index of docs (row, doc_id, text), written: a row for each segment."""
    terms = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))})

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            ids = {} if terms.value is None else terms.value
            found, n_words = [], []
            for text in batch.column("text").to_pylist():
                own = words(text)
                if terms.value is None:
                    for w in own:
                        ids.setdefault(w, len(ids))
                n_words.append(len(own))
                found.append(np.fromiter(map(ids.get, own, repeat(-1)), np.int32, len(own)))
            term = np.concatenate(found) if found else np.zeros(0, np.int32)
            n = np.array(n_words, np.int64)
            at = np.arange(len(term)) + np.repeat(np.arange(len(n)) * GAP, n)
            at, term = at[term >= 0], term[term >= 0]
            order = np.argsort(term, kind="stable")
            at, term = at[order].astype("<u4" if len(at) == 0 or at[-1] < 1 << 32 and at.max() < 1 << 32 else "<u8"), term[order]
            used, starts = np.unique(term, return_index=True)
            names = list(ids)
            row = {
                "segment": part << 32 | k,
                "rows": batch.column("row").to_pylist(),
                "doc_ids": batch.column("doc_id").to_pylist(),
                "n_words": n_words,
                "terms": [names[i] for i in used.tolist()],
                "postings": [bytes([at.itemsize]) + x.tobytes() for x in np.split(at, starts[1:])] if len(used) else [],
            }
            yield pa.RecordBatch.from_pylist([row], segment_schema)

    segment_schema = pa.schema([("segment", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("postings", pa.list_(pa.binary()))])
    return written(docs.select("row", "doc_id", "text").mapInArrow(segments, SEGMENTS), "index")


def positions(posting: bytes) -> np.ndarray:
    """A term's positions in its segment."""
    return np.frombuffer(posting, f"<u{posting[0]}", offset=1).astype(np.int64)


def phrase_starts(phrase: tuple[bytes, ...], lists: dict[bytes, np.ndarray], counts: dict[bytes, int]) -> np.ndarray:
    """Where the phrase occurs: offset-adjusted lists, intersected from the rarest term on."""
    found = None
    for w, offset in sorted(zip(phrase, range(len(phrase))), key=lambda x: (counts[x[0]], x)):
        starts = lists[w] - offset
        if found is None:
            found = starts
        else:
            at = np.searchsorted(starts, found).clip(max=len(starts) - 1)
            found = found[starts[at] == found]
        if not len(found):
            break
    return found


def near_spans(phrase: tuple[bytes, ...], lists: dict[bytes, np.ndarray], counts: dict[bytes, int], slop: int, known: dict) -> list[tuple[int, int, int]]:
    """Spans of len(phrase) + slop words that hold every distinct term, with the place of the rarest term by which each was found.

    known: for each rarest term of a segment the last next rarest one and the places near it, which overlapping phrases share.
    """
    terms = sorted(set(phrase), key=lambda w: (counts[w], w))
    width, places = len(phrase) + slop, lists[terms[0]]
    for k in range(1, len(terms)):
        # places with the term near enough, before any span is looked at
        w, held = lists[terms[k]], known.get((width, terms[0])) if k == 1 else None
        if held and held[0] == terms[1]:
            near = held[1]
        else:
            near = places[np.searchsorted(w, places + width) > np.searchsorted(w, places - width, "right")]
            if k == 1:
                known[width, terms[0]] = terms[1], near
        places = near
        if not len(places):
            return []
    found = []
    for back in range(width):
        starts = places - back
        for w in terms[1:]:
            starts = starts[np.searchsorted(lists[w], starts + width) > np.searchsorted(lists[w], starts)]
        found += [(s, s + width, s + back) for s in starts.tolist()]
    return found


def search(index: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Documents with finds of a block of test items: which items, and the merged spans of hit words; the same for proximity, if slop is not 0."""
    spark = index.sparkSession
    of: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for phrase in windows(text, window):
            of.setdefault(phrase, set()).add(item)
    if of and max(map(len, of)) + slop >= GAP:
        raise ValueError(f"window and slop reach {GAP} words")
    asked = {w for phrase in of for w in phrase}

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, postings in zip(batch.column("terms").to_pylist(), batch.column("postings").to_pylist()):
                n = {w: (len(p) - 1) // p[0] for w, p in zip(terms, postings) if w in asked}
                yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    # a row for each word of the block of test items at most
    counts = {bytes(r.term): r.n for r in index.select("terms", "postings").mapInArrow(sizes, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    phrases = [(p, sorted(of[p])) for p in sorted(of) if all(w in counts for w in p)]
    asked_for = spark.sparkContext.broadcast((phrases, counts))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, counts = asked_for.value
        from_rarest: dict[bytes, list[tuple]] = {}
        for phrase, ids in phrases:
            from_rarest.setdefault(min(phrase, key=lambda w: (counts[w], w)), []).append((phrase, ids))
        for batch in batches:
            for seg in batch.to_pylist():
                lists = {w: positions(p) for w, p in zip(seg["terms"], seg["postings"]) if w in counts}
                n = np.array(seg["n_words"], np.int64)
                begins = np.cumsum(n + GAP) - n - GAP
                found: tuple[dict, dict] = {}, {}
                known: dict[tuple, np.ndarray] = {}

                def book(kind: int, start: int, end: int, place: int, ids: list[str]) -> None:
                    """A span belongs to the document of the place, and is cut to it."""
                    doc = int(np.searchsorted(begins, place, "right")) - 1
                    held, spans = found[kind].setdefault(doc, (set(), []))
                    held.update(ids)
                    spans.append((max(0, start - int(begins[doc])), min(end - int(begins[doc]), int(n[doc]))))

                for first in lists.keys() & from_rarest.keys():
                    for phrase, ids in from_rarest[first]:
                        if not all(w in lists for w in phrase):
                            continue
                        for start in phrase_starts(phrase, lists, counts).tolist():
                            book(0, start, start + len(phrase), start, ids)
                        for start, end, place in near_spans(phrase, lists, counts, slop, known) if slop else ():
                            book(1, start, end, place, ids)
                rows = []
                for d in sorted(found[0].keys() | found[1].keys()):
                    row = {"row": seg["rows"][d]}
                    for kind, name in enumerate(("", "near_")):
                        held, spans = found[kind].get(d, ((), []))
                        row |= {f"{name}items": sorted(held), f"{name}spans": [{"start": a, "end": b} for a, b in merged(spans)]}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, hit_schema)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    hit_schema = pa.schema([("row", pa.int64()), ("items", pa.list_(pa.string())), ("spans", spans), ("near_items", pa.list_(pa.string())), ("near_spans", spans)])
    return index.mapInArrow(look_up, HITS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, test_bytes: int = TEST_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """Each of docs (row, doc_id, text) with the items of benchmark (item_id, text) found in it, its hit words and their spans; near_items and near_spans are what proximity finds (slop not 0)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // test_bytes) or 1

    def block(k: int) -> list[tuple[str, str]]:
        """A bounded share of the test set."""
        return [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()]

    vocabulary: set[bytes] | None = set()
    for k in range(n_blocks):
        vocabulary |= {w for _, text in block(k) for w in words(text)}
        if sum(map(len, vocabulary)) > vocabulary_bytes:
            vocabulary = None
            break
    index = build_index(docs, vocabulary)
    found = reduce(DataFrame.union, [search(index, block(k), window, slop) for k in range(n_blocks)])
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    each = found.groupBy("row").agg(*[F.array_sort(all_of(c)).alias(c) for c in ("items", "spans", "near_items", "near_spans")])
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))
    rows = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("doc")).select("doc.rows", "doc.doc_ids", "doc.n_words").toDF("row", "doc_id", "n_words")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    every = rows.join(each, "row", "left").select("row", "doc_id", "n_words", none("items", "array<string>"), none("spans", SPANS), none("near_items", "array<string>"), none("near_spans", SPANS))
    return every.withColumn("n_hit", F.aggregate("spans", zero, step, lambda acc: acc["n"]))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a window of a test item occurs."""
    key = fresh(docs, "row_key")
    rows = written(with_row_key(docs, key), "rows")
    clean = hits(rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).filter("n_hit = 0").select(F.col("row").alias(key))
    return rows.join(clean, key, "left_semi").drop(key)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, its hit words, the items that they come from, and how many items proximity finds."""
    docs = with_row_key(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "row")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    ids = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    n = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", n("items").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), n("near_items").alias("n_near_items"))

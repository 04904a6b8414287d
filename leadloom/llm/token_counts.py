"""Token counts of whole texts under a SentencePiece BPE model, with a shortcut for whole tokens.

A piece of such a model holds the blank mark only at its front (or is blanks alone), so no merge crosses from a word
to the blanks that follow it, and a text's count is the sum over its pre-tokens: a run of blanks with what follows up
to the next blank. The driver proves once, by encoding each vocabulary string alone, which pre-tokens are a single
token; executors count those directly and merge only the rest, keeping the counts of rests they have met within a bound.
A model whose pieces do not have that form is applied to whole texts instead.

Null and empty texts have no tokens; repeated rows are counted one by one; an empty table gives an empty result; a text of
any length is one row of one task; other columns are ignored.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import text_or_empty

MARK = "▁"
LIMIT = 4096
#: Counts of rests that a worker keeps; characters up to which a rest is kept, so that texts without blanks do not fill the memory.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_blanks(model) -> bool:
    """Whether pre-tokens are independent: no piece has a blank mark after something else, and a blank is put before each text."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)]
    return all(re.fullmatch(f"{MARK}[^{MARK}]*|[^{MARK}]+|{MARK}+", p) for p in pieces) and model.encode("a  b ", out_type=str)[0].startswith(MARK) and "".join(model.encode(" a  b ", out_type=str)) == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"


def whole_tokens(model) -> list[str]:
    """The words that, after one blank, are proven to be a single token: each is encoded alone."""
    words = [p[1:] for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return [w for w, ids in zip(words, model.encode(words, num_threads=1)) if len(ids) == 1]


class Counter(dict):
    """Tokens of a word after one blank. Whole tokens stand in it from the start; others are merged when first met."""

    def __init__(self, path: str, whole: list[str], entries: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole, self.entries = processor(path), whole, entries
        self.lone_blank = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def __missing__(self, word: str) -> int:
        if len(word) > CACHE_CHARS:
            return len(self.model.encode(word, num_threads=1))
        if len(self) > self.entries:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[word] = n = len(self.model.encode(word, num_threads=1))
        return n

    def count(self, text: str) -> int:
        """The tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        n = 0
        for run in re.findall(r" +[^ ]*", " " + text):
            # further blanks stay in front of the word, as a text of its own would get one more
            n += self.lone_blank if run == " " else self[run[1:]]
        return n


_held: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text)."""
    model = processor(model_path)
    independent = splits_at_blanks(model)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(model) if independent else [])  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _held:
            _held[model_path] = Counter(model_path, whole.value, entries)
        counter = _held[model_path]
        each = counter.count if independent else lambda t: len(counter.model.encode(t, num_threads=1))
        for batch in batches:
            n = [each(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

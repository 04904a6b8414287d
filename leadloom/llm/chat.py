r"""Chat formatting in budgeted windows.

A turn is written `### role: text </turn>` and a line end; backslash, `###` and `</turn>` inside texts (and `:` inside
roles) get a backslash in front, so what was written can be read back. Prefix sums of the turns' tokens place every turn
in a conversation; turns that start in the same stretch of `span` tokens form one window's new turns. A window opens with
the conversation's leading system turn, then repeats those turns of the window before that start in its last `history`
tokens, then has its new turns. Its loss mask covers the texts of new assistant turns alone, so each is a target once. A
window has at most span + history tokens, the system turn, and what its last turn has beyond the span.

Prefix sums are taken over ranges of (conversation, turn) with a carry from range to range, so that a conversation of any
length is spread over tasks. Rows are in order of turn, role, text, nulls first. Null roles and texts count as empty; a
null conv_id is a conversation of its own; repeated rows are turns of their own; other columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, written
from leadloom.llm.word_ids import word_ids

SPAN, HISTORY = 1024, 256
TURN_END = " </turn>\n"

CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.DOTALL)

WINDOWS = "conv_id long, window long, formatted string, n_repeated int, loss_spans array<struct<start: int, end: int>>"


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    """A backslash in front of each control string."""
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Undo escape(): each backslash goes, what follows it stays."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def header(role: str) -> str:
    return f"### {escape(role, ROLE_CONTROL)}: "


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def placed_turns(rows: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """Turns with the tokens of their conversation before them, in order, and the written table behind them.

    Columns: conv_id, part and seq (order), at (tokens before), first (leads its conversation), role, shown, n_tokens.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        last: tuple | None = None
        run = 0
        for batch in batches:
            convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            shown = [header(r) + escape(t) + TURN_END for r, t in zip(roles, texts)]
            n = [len(x) // encoder.width for x in encoder.encode(shown)]
            runs = []
            for conv, k in zip(convs, n):
                if last != (conv,):
                    last, run = (conv,), 0
                runs.append(run)
                run += k
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))), batch.column("conv_id"), pa.array(runs, pa.int64()), pa.array(n, pa.int64()), batch.column("role"), pa.array(shown, pa.string())], ["part", "seq", "conv_id", "run", "n_tokens", "role", "shown"])
            seq += len(n)

    sorted_rows = (
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    table = written(sorted_rows.mapInArrow(measure, "part int, seq long, conv_id long, run long, n_tokens long, role string, shown string"), "turns")
    # one row for each range: its first and last conversation, and the last one's tokens in it
    ends = table.groupBy("part").agg(F.min_by(F.struct("conv_id"), "seq").alias("first"), F.max_by(F.struct("conv_id", (F.col("run") + F.col("n_tokens")).alias("tokens")), "seq").alias("last"))
    carries, conv, carry = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        first, last = (r["first"].conv_id,), (r["last"].conv_id,)
        carries.append((r.part, carry if first == conv else 0, first[0], first == conv))
        carry = r["last"].tokens + (carry if first == last == conv else 0)
        conv = last
    carried = table.sparkSession.createDataFrame(carries, "part int, carry long, carried_conv long, goes_on boolean")
    same = F.col("conv_id").eqNullSafe(F.col("carried_conv"))
    turns = table.join(F.broadcast(carried), "part").select(
        "conv_id", "part", "seq", (F.col("run") + F.when(same, F.col("carry")).otherwise(0)).alias("at"), "n_tokens", "role", "shown",
        ((F.col("run") == 0) & ~(same & F.col("goes_on")) & ((F.col("n_tokens") > 0))).alias("first"),
    )
    return turns, table


def chat_windows(rows: DataFrame, tokenizer: str, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """The windows of rows (conv_id, turn, role, text), written: formatted text, how many turns at its front are repeats, and the loss mask as spans of code points."""
    turns, table = placed_turns(rows, tokenizer)
    own = F.floor(F.col("at") / span)
    piece = F.struct("part", "seq", "role", "shown").alias("piece")
    new = turns.select("conv_id", own.alias("window"), F.lit(2).alias("kind"), piece)
    again = turns.filter((F.pmod("at", F.lit(span)) >= span - history)).select("conv_id", (own + 1).alias("window"), F.lit(1).alias("kind"), piece)
    system = turns.filter(F.col("first") & (F.col("role") == "system")).select("conv_id", own.alias("system_window"), piece)
    windows = new.select("conv_id", "window").distinct()
    lead = windows.join(system, windows.conv_id.eqNullSafe(system.conv_id) & (windows.window > system.system_window)).select(windows.conv_id, "window", F.lit(0).alias("kind"), "piece")
    # the system turn of the first window may start late enough to be history of the second; it stands there once, at the front
    again = again.join(system.select(F.col("piece").alias("lead")), F.col("piece") == F.col("lead"), "left_anti")
    grouped = new.union(again).union(lead).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("kind", "piece"))).alias("turns"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["turns"][-1]["kind"] != 2:
                    continue  # repeats of turns after which nothing comes
                parts, at, spans = [], 0, []
                for t in r["turns"]:
                    role, shown = t["piece"]["role"], t["piece"]["shown"]
                    if t["kind"] == 2 and role == "assistant":
                        spans.append({"start": at + len(header(role)), "end": at + len(shown) - len(TURN_END)})
                    parts.append(shown)
                    at += len(shown)
                out.append({"conv_id": r["conv_id"], "window": r["window"], "formatted": "".join(parts), "n_repeated": sum(t["kind"] < 2 for t in r["turns"]), "loss_spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int32()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    out = written(grouped.mapInArrow(build, WINDOWS), "windows")
    discard(table)
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """What a trainer finds in windows, by conversation. Windows stream through in order; no conversation is held whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, turns, loss_chars, loss, chars = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        done: list[tuple] = []

        def close() -> None:
            if conv is not None:
                done.append((conv[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for r in batch.to_pylist():
                if conv != (r["conv_id"],):
                    close()
                    conv, n, turns, loss_chars, loss, chars = (r["conv_id"],), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in turns_of(r["formatted"])[r["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"] : s["end"]])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(r["formatted"])
            yield batch_of(done)
            done.clear()
        close()
        yield batch_of(done)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, formatted, written and read back."""
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(rows.union(added), public_tokenizers.path("word_bpe_49k.json")))

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import chat as C

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet=st.sampled_from("\\#</turn>: \nab"), max_size=25)] * 2), max_size=4))
def test_turns_can_be_read_back(turns):
    assert C.turns_of("".join(C.header(r) + C.escape(t) + C.TURN_END for r, t in turns)) == turns


ROWS = (
    [*C.ADDED, (1, 0, "system", "Be brief."), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (2, 1, "assistant", ""), (None, 0, "assistant", "no conv"), (None, 1, "user", "x")]
    + [(3, 0, "system", "S </turn>\n### assistant: no")] + [(3, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 7)) for i in range(1, 120)]
    + [(4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (4, 5, "user", "tie"), (5, 0, "user", "long " * 5000), (5, 1, "assistant", "é😀" * 3000), (6, 0, "system", "only")]
)


@pytest.mark.parametrize("span,history", [(16, 8), (40, 40), (1024, 256)])
def test_windows(spark, span, history):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, window string, part int").repartition(3)
    windows = C.chat_windows(df, PATH, span, history)
    assert got(C.read_back(windows)) == brute(ROWS)
    rows = windows.collect()
    three = sorted((r for r in rows if r.conv_id == 3), key=lambda r: r.window)
    if span < 1000:
        assert len(three) > 10 and any(r.n_repeated > 1 for r in three)
    assert all(C.turns_of(r.formatted)[0] == ("system", "S </turn>\n### assistant: no") for r in three)
    assert all(C.turns_of(r.formatted).count(("system", "S </turn>\n### assistant: no")) == 1 for r in three)
    for a, b in zip(three, three[1:]):
        own, again = C.turns_of(a.formatted)[a.n_repeated :], C.turns_of(b.formatted)[1 : b.n_repeated]
        assert again == own[len(own) - len(again) :] or again == []


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.chat_windows(df, PATH)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(C.op7_chat(spark, sf)) == brute(rows + C.ADDED)

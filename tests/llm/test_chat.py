import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tonguemap.llm import chat

BITS = [*chat.CONTROLS, "\\", "\\\\", "<", "s>", "[", "INST]", "/", " ", "é😀", "x", "\n", "</", "<\\s>"]
ODD = st.lists(st.sampled_from(BITS), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a [/ROLE] b", "<s>[INST] "]), ODD), min_size=1, max_size=8), st.integers(0, 3))
def test_round_trip(turns, cut):
    first = sorted({0, *([min(cut, len(turns) - 1)] if cut else [])})
    rows, starts, ends = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), __import__("numpy").array(first))
    got, loss = [], []
    for data, s, e in zip(rows.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        got += [(r.decode(), t.decode()) for r, t in chat.parse(data)]
        loss += [chat.unescape(data[a:b]).decode() for a, b in zip(s, e)]
        assert data.count(b"<s>") == len(chat.parse(data))
    assert got == turns
    assert loss == [t for r, t in turns if r == "assistant"]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool<s>"]), "".join(rng.choices(BITS, k=rng.randrange(9))) or None) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)]  # one hot conversation
    rows += [(78, 3, "user", f"tie {i % 1500}") for i in range(9000)]  # more turns of one number than a piece takes
    rows += [(79, None, "user", "n"), (79, 1, "user", "é" * 200_000), (None, 1, "assistant", "lost"), (None, 0, "user", None), rows[0]]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert got == brute(rows)
    parts = chat.format_chats(turns).select("conv_id", "part", "piece", "n_turns").collect()
    assert len([r for r in parts if r.conv_id == 77]) == 12 and max(r.n_turns for r in parts) <= chat.PIECE_TURNS + chat.SLICE_TURNS
    assert len({r.piece for r in parts if r.conv_id == 78}) > 1
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0

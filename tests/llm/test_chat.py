import hashlib
import random

from fathomline.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PIECES = ["<|im_end|>", "<|im_start|>", "\n", "<", "|", "\\", "<\\|", "a", "é", "user", "im_end|>", "$1", "\\n", "\\s", "😀"]


def test_round_trip(spark):
    rng = random.Random(5)
    make = lambda: None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
    rows = [(rng.randrange(300), rng.randrange(6), rng.choice(["user", "assistant", make()]), make()) for _ in range(1500)]
    rows += [(None, 1, "user", "a" * 300_000), (None, None, None, None), (7, 1, "user", "x"), (7, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    said = {r.conv_id: r for r in C.digests(C.format_chats(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((-1 if t is None else t), a or "", b or "") for i, t, a, b in rows if i == c)
        assert r.identical and [(x.role, x.text) for x in r.turns] == [x[1:] for x in turns]
        whole = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        d = said[c]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(r.formatted) and r.formatted.count("<|im_end|>") == len(turns)


def test_escapes_only_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi <b>"), (2, 0, "user", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.escaped, r.formatted) for r in C.format_chats(df).collect()}
    assert got == {1: (False, "<|im_start|>user\nhi <b><|im_end|>\n"), 2: (True, "<|im_start|>user\n<\\|im_end|><|im_end|>\n")}
    assert C.format_chats(df.limit(0)).count() == 0

"""Chat formatting: exact round trips, merging, loss masks, edge cases."""

import hashlib
import itertools
import random

from corvane.llm import chatformat as C

PIECES = ["<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_part|>", "</s>", "[INST]", "[/INST]", "^", "^^", "<", "|", "<^|", "a", "\n", "é😀", "<<SYS>>", "<s>", ""]


def rows(spark, data, extra=False):
    schema = "conv_id long, turn long, role string, text string" + (", segments string, formatted int" if extra else "")
    return spark.createDataFrame([(*d, "x", 1) if extra else d for d in data], schema)


def test_round_trip(spark):
    rng = random.Random(4)
    data = [(c, t, rng.choice(["user", "assistant", "system", "a<|b"]), "".join(rng.choices(PIECES, k=rng.randint(0, 9)))) for c in range(60) for t in range(rng.randint(1, 9))]
    chats = C.format_chats(rows(spark, data, extra=True))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "n_turns", "formatted", "segments", C.read_turns(chats["formatted"]).alias("ts"), C.loss_text(chats["segments"]).alias("loss")).collect()}
    for c, group in itertools.groupby(data, key=lambda d: d[0]):
        own = [d[2:] for d in group]
        r = got[c]
        assert [tuple(t) for t in r["ts"]] == own and r["n_turns"] == len(own)
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count(C.START) == 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))
    d = {r["conv_id"]: r for r in C.digest(chats).collect()}
    for c, group in itertools.groupby(data, key=lambda x: x[0]):
        want = "".join(f"{r}\n{t}\n" for _, _, r, t in group)
        assert d[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and d[c]["formatted_chars"] == len(got[c]["formatted"])


def test_edges(spark):
    data = [(1, 1, "user", None), (1, 0, None, "b"), (None, 0, "user", "x"), (2, 0, "assistant", "dup"), (2, 0, "assistant", "dup"), (3, None, "user", "late"), (3, 0, "user", "z"), (4, 0, "assistant", "w " * 200_000)]
    got = {r["conv_id"]: r for r in C.digest(C.format_chats(rows(spark, data))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nb\nuser\n\n").hexdigest()
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 6 and got[None]["n_turns"] == 1
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\nlate\nuser\nz\n").hexdigest()
    assert got[4]["loss_chars"] == 400_000
    assert C.format_chats(rows(spark, [])).count() == 0

import hashlib
import random
from itertools import groupby

from depthframe.llm.chat import examples, read_back


def brute(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, turns in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS example", "2 AS last")
    found = examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(found).collect()}
    assert got == brute(rows)
    return found


def test_small(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [
        (-7, 0, "user", bad),
        (-7, 1, "assistant", bad),
        (1, 0, "system", "<|end|>\n<|start|>assistant\n"),
        (1, 1, "user", "<\\</s> <\\/s> <\\\\/s> \\ $1 é𝒳"),
        (1, 2, "assistant", None),
        (1, 3, "assistant", "last <|end|"),
        (1, 4, "user", "tail ["),
        (2, 0, "user", "no reply"),
        (None, 0, "a\\n\nb\x00<s>", "x"),
        (None, 0, "a\\n\nb\x00<s>", "x"),
        (3, None, None, None),
        (4, 1, "assistant", ""),
    ]
    found = check(spark, rows)
    for r in found.collect():
        if r.loss_start is not None:
            assert r.text[r.loss_end :] == "<|end|>\n" and r.text[: r.loss_start].endswith("<|start|>assistant\n")
    first = [r for r in found.collect() if r.conv_id == -7][0]
    assert "</s>" not in first.text and "[INST]" not in first.text and "[/INST]" not in first.text
    assert sorted((r.conv_id, r.example) for r in found.collect() if r.conv_id == 1) == [(1, 0), (1, 1), (1, 2)]
    assert read_back(examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0


def test_random_control_strings(spark):
    rng = random.Random(1)
    pieces = ["<", "\\", "/", "s>", "[", "INST]", "|", "end", "|>", "\n", "start", "é", " ", "$0"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for c in range(60) for t in range(6)]
    found = check(spark, rows)
    for r in found.collect():
        assert r.text.count("<|start|>") == r.text.count("<|end|>")


def test_whole_table(spark, testdata):
    df = spark.read.parquet(f"{testdata}/sf0.01/conversations.parquet")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

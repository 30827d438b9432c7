"""Chat formatting round trips, exact top-k, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodgemetrics.llm import chat, topk

PIECES = ["<|im_end|>", "<|im_start|>", "<|im_next|>", "\\", "<", "|", "\n", "\\n", "<\\|", "é", "🙂", "a b", ""]


def read_back(df):
    rows = chat.format_conversations(df).select("conv_id", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
    return {r["conv_id"]: r for r in rows.collect()}


def test_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a\nb\\n<|", ""])
            rows.append((conv, turn, role, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))))
    got = read_back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for conv, r in got.items():
        want = [(x[2], x[3]) for x in sorted(rows) if x[0] == conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(x[0] == "assistant" for x in want)


def test_same_role_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")],
                               "conv_id long, turn long, role string, text string")
    text = read_back(df)[1]["formatted"]
    assert text == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, None, 5), (1, 1, "assistant", "x", 6), (1, 1, "assistant", "x", 7),
                                (None, 0, "user", "y", 8)],
                               "conv_id long, turn long, role string, text string, segments long")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute(vectors, queries, k):
    import math

    v = {i: [math.floor(256 * c) for c in x] for i, x in vectors if x and all(c is not None and math.isfinite(c) for c in x)}
    out = set()
    for q in queries:
        if q in v:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "scaled"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(5)
    scale = (lambda: rng.choice([0.1, 1.0, 30.0])) if kind == "scaled" else (lambda: 1.0)
    draw = (lambda s: float(rng.randint(-1, 1))) if kind == "ties" else (lambda s: rng.gauss(0, 1) * s)
    data = []
    for i in range(400):
        s = scale()
        data.append((i, [draw(s) for _ in range(8)]))
    data += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [0.0] * 8), (550, [1.0, 2.0])]
    df = topk.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    assert {tuple(r) for r in got.collect()} == brute(data, [i for i, _ in data if i % 50 == 0], 5)


def test_top_k_with_a_dominating_coordinate(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    rng = random.Random(11)
    data = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]  # long and dense: the first buckets
    for i in range(300, 900):  # shorter, nearly along one axis of either sign
        x = [rng.gauss(0, 0.02) for _ in range(16)]
        x[i % 4] = (1 if i % 8 < 4 else -1) * rng.uniform(2.0, 3.0)
        data.append((i, x))
    df = topk.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = topk.top_k(df, df.filter("vec_id % 25 = 0"), 5)
    assert {tuple(r) for r in got.collect()} == brute(data, [i for i, _ in data if i % 25 == 0], 5)


def test_top_k_of_nothing(spark):
    df = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert topk.top_k(df, df, 5).count() == 0

"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodgemetrics.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_words_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcé🙂"
    counts = {}
    for _ in range(350):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7)))
        counts[w] = rng.choice([1, 2, 3, 30, 31, 400, 5000, 60000])
    got = spelling.variants(spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form long"))
    assert rows_of(got) == brute(counts)


def test_long_chain_of_forms(spark):
    counts = {"a" * 8 + "b" * i: 10 ** i for i in range(14)}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert all(r["root"] == "a" * 8 + "b" * 13 for r in got.values())
    assert got["a" * 8]["form"] == "a" * 8 + "b" and got["a" * 8]["form_n"] == 10


def test_odd_words(spark):
    words = [("", 1), (None, 2), ("a\x00b", 500), ("ab", 30), ("a", 3)]
    got = rows_of(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert got == {("", None, "", 1, 0, None), (None, None, None, 2, 0, None), ("a\x00b", None, "a\x00b", 500, 0, None),
                   ("ab", None, "ab", 30, 1, None), ("a", "ab", "ab", 3, 1, 30)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_counts_and_planted_typos(spark):
    rng = random.Random(9)
    vocabulary = ["Zusammen", "regarder", "ÉCOLIERS", "elephant", "elephants", "sixteen", "Überall", "aaaaaaaab", "short"]
    texts = [(i if i % 5 else None, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "1", "×"]) for _ in range(60)), "x")
             for i in range(60)] + [(7, None, "y"), (8, "", "z")]
    counts = Counter()
    for d, t, _ in texts:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 3 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    want = {w: n for w, n in counts.items() if n >= 2}
    df = spark.createDataFrame(texts, "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, typo_every=3).collect()}
    assert got == want and len(want) > 10
    assert spelling.word_counts(df.limit(0)).count() == 0

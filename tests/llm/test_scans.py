"""Packing, decontamination, secret and personal-data scans, toxicity and the pipeline on small cases."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodgemetrics.llm import decontaminate, packing, pii, secrets, toxicity
from lodgemetrics.llm.queries import vocabulary

TEXTS = [None, "", " ", "Hello, World! It's 2024 — naïve café", "<|endoftext|> is text", "ÀÉ ß İstanbul ΣΑΣ",
         "x" * 5000, "can't we'll 12345 %%% $$$", "日本語 text", "á é", "tab\tnew\nline\x0bvt\x85"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit(1))


def test_tokens_match_the_library():
    words = packing.Words(vocabulary())
    texts = [t or "" for t in TEXTS] + [" ".join(random.Random(1).choices(TEXTS[3].split(), k=50))]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == want == words.encode(texts)


def test_tokens_match_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS] + ["end of page <|endoftext|> next", "<|startoftext|>a<|endoftext|>b", "<|ENDOFTEXT|> x",
                                        "naïve<|endoftext|>日本語", "<| endoftext |>", "a <|endoftext|>" * 40]
    fresh = Tokenizer.from_file(vocabulary())
    want = [np.asarray(e.ids, "<u4").tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]
    words = packing.Words(vocabulary())
    assert words.encode(texts) == want == words.encode(texts)
    assert len(np.frombuffer(words.encode(["end of page <|endoftext|> next"])[0], "<u4")) == 5


def test_packing(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["stay", "room", "night"], k=rng.choice([3, 90, 700, 4095, 9000]))) for _ in range(60)]
    texts += ["same text"] * 50
    rows = packing.packed(frame(spark, texts), vocabulary(), with_ids=True)
    placed = [r.asDict() for r in rows.collect()]
    tokenizer = packing.words(vocabulary()).tokenizer
    mine = defaultdict(list)
    for r in placed:
        mine[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(mine[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in placed)
    assert len(sequences) <= 1.06 * total / 4096 + 2
    whole = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(rows).collect()}
    assert sum(whole.values()) == total
    assert packing.packed(frame(spark, ["x"]).limit(0), vocabulary()).count() == 0


def first_fit_decreasing(sizes, counts, room):
    free: list[int] = []
    for s, n in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        for _ in range(n):
            k = next((i for i, f in enumerate(free) if f >= s), None)
            if k is None:
                free.append(room)
                k = len(free) - 1
            free[k] -= s
    return len(free)


def test_cutting_patterns():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sizes = np.unique(rng.integers(1, 257, 30))
        counts = rng.integers(1, 60, len(sizes))
        got = packing.cutting_patterns(sizes, counts, 256)
        assert all((p * sizes).sum() <= 256 for p, _ in got)
        assert sum(p * n for p, n in got).tolist() == counts.tolist()
        assert sum(n for _, n in got) <= first_fit_decreasing(sizes, counts, 256) + 3


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else f"w{rng.randint(0, 500)}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(n) for n in (5, 12, 30, 30, 57)] + ["of the", "", None]
    docs = []
    for i in range(60):
        leak = (items[i % 5] or "").split() if i % 2 else []
        if leak and i % 3 == 0:  # edits at its ends
            leak = leak[1:] if i % 4 == 1 else leak[:-1] + ["changed"]
        docs.append(f"{text(rng.randint(0, 40)).upper()}. {', '.join(leak)} {text(rng.randint(0, 9))}")
    docs += ["", None, "Of the!", "of the of"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            w, x = words(d), words(t)
            if not x or (len(x) < 5 and len(w) != len(x)):
                continue
            for k in range(len(w) - len(x) + 1):
                a, b = grams(w[k:k + len(x)]), grams(x)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and s > want.get((i, j), (0,))[0]:
                    want[i, j] = (s, k)
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k]["similarity"] - s) < 1e-9 and got[k]["start_word"] == p for k, (s, p) in want.items())
    plan = decontaminate.find_leaks(frame(spark, docs), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    left = decontaminate.remove_leaks(frame(spark, docs), bench)
    assert left.columns == ["doc_id", "text", "length"] and left.count() == len(docs) - len({i for i, _ in want})
    assert decontaminate.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_leaks_at_the_ends_of_texts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    items = [text(n) for n in (9, 9, 10, 11, 12, 14, 30, 57)] + ["w1 w2", "zz", "zz yy xx vv"]
    docs = []
    for t in items[:8]:
        w = t.split()
        for cut in (w, w[1:], w[:-1], w[1:-1], w[3:], w[:-4], w[:4]):
            docs += [" ".join(cut), text(6) + " " + " ".join(cut), " ".join(cut) + " " + text(70), "x " + " ".join(cut)]
    docs += ["zz", "a zz yy zz yy xx vv", "w1 w2", "w9 w1 w2 w1 w2", "yy", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.find_leaks(frame(spark, docs), bench, short_windows=True).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in rows}
    grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            w, x = (d or "").split(), t.split()
            for k in range(1 - len(x), len(w)):
                a, b = grams(w[max(k, 0):k + len(x)]), grams(x)
                s, full = sum((a & b).values()) / sum((a | b).values()), 0 <= k <= len(w) - len(x)
                if s >= 0.8 and (full, s) > want.get((i, j), (False, 0))[:2]:
                    want[i, j] = (full, s, max(k, 0))
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[k][0] - s) < 1e-9 and got[k][1] == p for k, (_, s, p) in want.items())
    assert all(r["start_word"] + r["n_words"] <= len(docs[r["doc_id"]].split()) for r in rows)


def test_clean_rows_of_a_bad_id_stay(spark, monkeypatch):
    import corpus_pipeline

    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, item), (None, "clean"), (1, item), (1, "also clean"), (2, item), (2, item), (3, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = {(None, "clean"), (1, "also clean"), (3, None)}
    assert {tuple(r) for r in decontaminate.remove_leaks(docs, bench).collect()} == clean
    terms = np.full(toxicity.BUCKETS, -1, np.int32)
    machine = toxicity.Machine(terms, -9.0, np.zeros(0), np.zeros((0, toxicity.FACTORS)))
    assert toxicity.score(docs, machine).columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.score(docs, machine, with_key=True).count() == 7
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    monkeypatch.setattr(toxicity, "train", lambda *a: None)
    monkeypatch.setattr(toxicity, "score", lambda d, m, **k: corpus_pipeline.toxicity.keyed(d).withColumn(
        "predicted", F.coalesce(F.col("text") == item, F.lit(False)).cast("int")))
    assert {tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, "").collect()} == clean


SECRETS = ['token = "abcdefghijkl"', "Password: short", "pwd=Tr0ub4dor&3xyzQ!w9", "password: password123", "AKIA" + "A" * 16,
           "AKIAshort", "f" * 16 + "g", "f" * 15, "token: secret=abcdefghijklmnop", "token: password : verylongvalue123",
           "ſecret=abcdefghijklmnop", "api_key='0123456789ab'", "APIKEY=abcdefghijkl=", "é token=abcdefghijkl", None, ""]


def test_secrets(spark):
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame(spark, SECRETS)).collect()}
    for i, t in enumerate(SECRETS):
        t = t or ""
        a = [("assign", m.start(), m.end()) for m in re.finditer(
            r"(?a:(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", t) if len(m[2]) >= 12]
        k = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        h = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert {(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] != "guess"} == {*a, *k, *h}
    assert [s["kind"] for s in got[2]] == ["guess"] and not got[3]


def test_guess_cost():
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("password") < 1
    assert secrets.guess_cost("qwertyuiop") < 4 and secrets.guess_cost("aaaaaaaaaaaa") < 4
    assert secrets.guess_cost("19991231") < secrets.guess_cost("83716204")
    assert secrets.guess_cost("P4ssword") < secrets.guess_cost("xkqjzvbw") < secrets.guess_cost("xkQj9vbw!")


def brute_pii(t):
    luhn = lambda s: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(
        [int(c) for c in s if c.isdigit()][::-1])) % 10 == 0
    digits = lambda s: sum(c in "0123456789" for c in s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= digits(m[0]) <= 19 and luhn(m[0])]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= digits(m[0]) <= 15]


def test_base_spans():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(["@", ".", "a", "b1", "+", "1", "23", "4111 1111 1111 1111", " ", "-", "(", "1.2.3.4", "é", "x@y.z"])
                    for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t)
    assert not pii.base_spans("9" * 200_000 + "a" * 200_000)  # in linear time


def test_pii(spark):
    rng = random.Random(7)
    texts = []
    for i in range(120):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        texts.append(rng.choice(["mail bob.{}@host{}.example.com now", "call +1 ({}) 555-{} today", "from {}.{}.7.8 seen",
                                 "just {} rooms and {}"]).format(d(2), d(4) if i % 4 else "12"))
    texts += ["", None, "+1 (212) 555-0100 and a@b.co"]
    docs = frame(spark, texts)
    model = pii.fit(docs)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, model).collect()}
    exact = 0
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == brute_pii(t or "")
        decoded = []
        for lo, hi in pii.candidate_regions(t or ""):
            tokens = list(pii._TOKEN.finditer(t, lo, hi))
            decoded += [(k, tokens[a].start(), tokens[b - 1].end()) for k, a, b in model.decode([m[0] for m in tokens])]
        exact += sorted(decoded) == sorted(brute_pii(t or ""))
    assert exact >= 0.9 * len(texts)  # the field alone finds the boundaries and types it was fitted on
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[len(texts) - 1] == "[phone] and [email]" and clean[121] is None and clean[120] == ""
    assert pii.find_pii(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_factorization_machine_learns_a_pair():
    """Insult and group word together are toxic, either alone is not: their interaction must be positive."""
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(8)] + ["fool"] * a + ["group"] * b
        texts.append(" ".join(words))
        labels.append(float(a and b))
    row, bucket = toxicity.terms(pa.array(texts))
    model = toxicity.fit(row, bucket, np.array(labels))
    score = model.score(pa.array(["fool group", "fool", "group", "", "ak bl"]))
    assert score[0] > 0.7 and max(score[1:]) < 0.5
    places = [model.place[toxicity.terms(pa.array([w]))[1][0]] for w in ("fool", "group")]
    assert min(places) >= 0 and model.factors[places[0]] @ model.factors[places[1]] > 0


def test_terms_are_counted_in_lots():
    """Choosing terms takes memory for few of them at once (the driver holds them all as four-byte buckets)."""
    n, each = 4000, 500
    row = np.repeat(np.arange(n, dtype=np.int32), each)
    bucket = np.random.default_rng(2).integers(0, toxicity.BUCKETS, n * each).astype("<i4")
    tracemalloc.start()
    machine = toxicity.fit(row, bucket, np.zeros(n))  # no label, so no term is chosen
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(machine.linear)
    assert peak < 55e6


def test_toxicity(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('qrst')}" for _ in range(rng.randint(3, 40))]
        texts.append(" ".join(words + [rng.choice(["idiot", "Scum,", "fool!"])] * bad))
        labels.append((i, int(bad)))
    docs = frame(spark, texts + ["", None])
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r["predicted"], labels[i][1]) for i, r in got.items() if r["held_out"] and i < 900]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    flat = toxicity.train(docs, lab.limit(0))
    assert {r["score"] for r in toxicity.score(docs, flat).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents").withColumn("extra", F.lit(1)).withColumn("rejected", F.lit(2))
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, docs, sf)
        if name != "packing":
            assert nxt.columns == docs.columns
            docs = corpus_pipeline.staged(nxt, "test")
            now = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert now <= seen and len(now) > 0.8 * len(seen)
            seen = now
        else:
            assert {r["doc_id"] for r in nxt.select("doc_id").collect()} == seen
    text = " ".join(r["text"] or "" for r in docs.select("text").collect())
    assert not re.search(r"@mail\d", text)


def test_similar_rows_go_by_id_and_text(spark):
    import corpus_pipeline

    base = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, base), (2, base + " more"), (2, other), (None, base), (None, other), (3, other), (3, None), (4, ""), (1, base)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, key string, component_id long")
    got = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, base), (1, base), (2, other), (None, base), (None, other), (3, None), (4, "")], key=str)

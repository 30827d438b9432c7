"""Repeated substrings, similar groups and components against brute force, with hot groups and edge cases."""

import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

from lodgemetrics.llm import jaccard_join, shared, substring_dedup, suffix_dedup
from lodgemetrics.llm.components import components
from lodgemetrics.llm.shared import sliding_min

WORDS = ["the", "of", "and", "hotel", "room", "Éa", "x", "stay", "night", "rate"]


def corpus(seed, n=60):
    """Texts with shared passages, copies, near copies, a hot passage in a third of them, odd blanks and nulls."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(k))
    hot, shared = text(30), [text(25) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        if i % 3 == 0:
            parts += [hot, text(5)]
        if i % 4 == 0:
            parts += [rng.choice(shared), text(rng.randint(0, 9))]
        rows.append(rng.choice([" ", "\n", "\t  "]).join(parts))
    for i in range(12):
        words = rows[i].split(" ")
        if len(words) > 4 and i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
    rows += ["", None, " \t ", "one two", "ONE two", "a" * 300, "b c " * 200]
    return list(enumerate(rows))


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n long, key string")
    return df.repartition(3)


def covered(symbols, window, count):
    gone = [False] * len(symbols)
    for i in range(len(symbols) - window + 1):
        if count[tuple(symbols[i:i + window])] > 1:
            gone[i:i + window] = [True] * window
    return gone


def brute_remove(rows, split, window):
    parts = [(i, split(t or "")) for i, t in rows]
    count = Counter(tuple(p[k:k + window]) for _, p in parts for k in range(len(p) - window + 1))
    return sorted((i, len(p), [x for x, g in zip(p, covered(p, window, count)) if not g]) for i, p in parts)


def test_word_windows(spark):
    rows = corpus(1) + [(3, corpus(1)[3][1])]  # a repeated row
    got = substring_dedup.remove_repeats(frame(spark, rows), window=8, k=3)
    want = [(i, n, n - len(k), " ".join(k)) for i, n, k in
            brute_remove(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 8)]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("hot", [200, 3])
def test_byte_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus(2)
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=40, k=12)
    want = [(i, n, bytes(k)) for i, n, k in brute_remove(rows, str.encode, 40)]
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got.collect()) == want
    for r in got.collect():
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


@pytest.mark.parametrize("crowded", [5, 25])
def test_crowded_anchors(spark, monkeypatch, crowded):
    from lodgemetrics.llm import anchors

    monkeypatch.setattr(anchors, "CROWDED", crowded)
    rows = corpus(5) + [(900 + i, corpus(5)[0][1]) for i in range(30)]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=8, k=3)
    want = [(i, n, n - len(k), " ".join(k)) for i, n, k in
            brute_remove(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 8)]
    assert sorted(map(tuple, got.collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.similar_groups(none).count() == 0


def test_previous_factors():
    rng = np.random.default_rng(1)
    for window in (3, 7, 20):
        text = rng.integers(0, 3, 300)
        starts = np.arange(0, len(text) - window + 1)
        got = suffix_dedup.previous_factors(text, starts, window)
        seen: dict[tuple, int] = {}
        for i in starts:
            w = tuple(text[i:i + window])
            assert (got[i] >= 0) == (w in seen)
            if got[i] >= 0:
                assert got[i] < i and tuple(text[got[i]:got[i] + window]) == w
            seen.setdefault(w, i)


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 50, 101)
    for w in (1, 2, 7, 101):
        assert sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(len(x) - w + 1)]


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_similar_groups(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "LISTED", 6)
    rng = random.Random(9)
    rows = corpus(4)
    base = rows[0][1].split(" ") + [f"w{k}" for k in range(60)]
    for _ in range(40):  # a hot group of near copies, some of them only linked through others
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
        rows.append((len(rows), " ".join(words)))
    got = jaccard_join.similar_groups(frame(spark, rows), jaccard_join.Rule(n, percent))
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, n, percent)


def test_signatures_are_shared():
    """Random pairs within the rule share a signature at every size."""
    rng = np.random.default_rng(4)
    for size in [1, 2, 5, 6, 7, 9, 13, 20, 40, 90, 200, 700]:
        for _ in range(30):
            a = rng.integers(0, 2 ** 63, size).astype(np.uint64)
            drop = rng.integers(0, size + 1)
            b = np.concatenate([a[:size - min(drop, size * 15 // 185)], rng.integers(0, 2 ** 63, size * 8 // 185).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            row, sig = jaccard_join.signatures(jaccard_join.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert np.intersect1d(sig[row == 0], sig[row == 1]).size


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (None, 4), (20, 21)] + [(k, k + 1) for k in range(30, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), **dict.fromkeys([20, 21], 20), **dict.fromkeys(range(30, 61), 30)}


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """No plan that a round writes holds a table more than twice, and no links take no round: driver memory follows plans."""
    scans, plain = [], shared.staged

    def spy(df, tag):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return plain(df, tag)

    monkeypatch.setattr(shared, "staged", spy)
    monkeypatch.setattr(sys.modules[components.__module__], "staged", spy)
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0 and len(scans) == 1
    got = dict(map(tuple, components(spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")).collect()))
    assert got == dict.fromkeys(range(7), 0)
    assert len(scans) > 2 and max(scans) <= 2


def test_tiles_of_large_sets_are_smaller(spark, monkeypatch):
    """Blocks are bounded by shingles as well as by classes; results do not change."""
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 300)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(2, 7)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    blocks, plain = [], jaccard_join.staged

    def spy(df, tag):
        out = plain(df, tag)
        if tag == "blocks":
            blocks.append(out.select("component", "block").distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", spy)
    got = jaccard_join.similar_groups(frame(spark, rows), jaccard_join.Rule(4, 85))
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, 4, 85)
    assert blocks and blocks[0] > 1


def brute_links(rows, n, percent):
    """Links between different sets and how many other rows each row is linked to."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    linked = {(i, j) for i in sets for j in sets if i != j and sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    return sets, linked


@pytest.mark.parametrize("listed, tile", [(64, 64), (3, 7)])
def test_every_link_and_its_count(spark, monkeypatch, listed, tile):
    monkeypatch.setattr(jaccard_join, "LISTED", listed)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(5)
    rows = corpus(6)
    for size in (30, 90):
        base = [f"w{size}x{k}" for k in range(size)]
        for _ in range(25):
            words = list(base) + [f"more{k}" for k in range(rng.randint(0, 6))]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, rows[-1][1]) for k in range(3)]
    rule = jaccard_join.Rule(5, 80)
    sets, linked = brute_links(rows, 5, 80)
    members, found, _ = jaccard_join.links(frame(spark, rows), rule)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert set(got) == {(of[i], of[j]) for i, j in linked if of[i] < of[j]}
    told = jaccard_join.similar_groups(frame(spark, rows), rule, count_links=True)
    assert {r["doc_id"]: r["n_links"] for r in told.collect()} == {i: sum(a == i for a, _ in linked) for i in sets}


def test_sets_do_without_their_spare_signatures():
    """Linkable sets share more signatures of a scheme than either may do without."""
    rng = np.random.default_rng(7)
    for size in [60, 90, 200, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[size * 7 // 100:], rng.integers(0, 2 ** 63, size * 6 // 100).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            x = jaccard_join.signed(jaccard_join.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
            good = False
            for scheme in np.intersect1d(x.scheme[x.row == 0], x.scheme[x.row == 1]).tolist():
                p, q = ((x.row == r) & (x.scheme == scheme) for r in (0, 1))
                shared = len(np.intersect1d(x.sig[p], x.sig[q]))
                good |= shared > max(x.spare[p].max(), x.spare[q].max())
            assert good


def test_sketches_lose_no_lot(spark):
    """More partitions in the mapped plan than the number told."""
    from lodgemetrics.llm import sketch
    from lodgemetrics.llm.shared import mix

    rows = spark.range(0, 4000, 1, 97).selectExpr("id % 2500 AS v")
    test = None

    def run(batches):
        parts = [mix(b["v"].to_numpy().astype(np.uint64)) for b in batches]
        yield sketch.partition_sketch(parts, 20)

    for told in (1, 60, 97, 5000):
        test = sketch.merged(rows.mapInArrow(run, sketch.SCHEMA), 20, told)
        assert test(mix(np.arange(1500, dtype=np.uint64))).all() and test(mix(np.arange(1500, 2500, dtype=np.uint64))).mean() < 0.1


def test_windows_of_rows_behind_an_adaptive_skewed_join(spark):
    """The sketch and its second pass read a plan whose partitions are only told at run time."""
    rows = corpus(3)
    names = spark.createDataFrame([(i, i % 2) for i, _ in rows], "id long, side long")
    text = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                                   "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("1", "1", "-1")):
            spark.conf.set(k, v)
        joined = text.repartition(9).join(names, text["doc_id"] == names["id"]).select("doc_id", "text")
        got = substring_dedup.remove_repeats(joined, window=8, k=3)
        want = [(i, n, n - len(k), " ".join(k)) for i, n, k in
                brute_remove(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 8)]
        assert sorted(map(tuple, got.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_task_sketches_in_lots(spark, monkeypatch):
    """What a task holds does not follow its rows, and hashes that meet in two of its lots are told."""
    from lodgemetrics.llm import sketch
    from lodgemetrics.llm.shared import mix

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(sketch, "TaskContext", Task)
    monkeypatch.setattr(sketch, "LOT", 120)
    lots, hashes, found = sketch.Lots(20), mix(np.arange(2000, dtype=np.uint64)), []
    for part in [*np.split(hashes, 40), hashes[:300]]:
        found += lots.add(part)
        assert lots.many < 120
    found += lots.rest()
    assert len(found) >= 13
    rows = [tuple(r.values()) for batch in found for r in batch.to_pylist()]
    test = sketch.merged(spark.createDataFrame(rows, sketch.SCHEMA), 20, 1)
    assert test(hashes[:300]).all() and test(hashes[300:]).mean() < 0.05

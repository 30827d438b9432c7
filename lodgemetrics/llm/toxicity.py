"""Toxicity: a factorization machine over hashed terms, fitted on labelled rows and applied to every text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm.shared import LETTERS, LOWER, SpanHash, buffers, byte_symbols, give_back_memory, keyed, row_slices, word_bounds

#: Hash buckets of terms, terms the model keeps, latent factors.
BUCKETS, TERMS, FACTORS = 1 << 20, 4096, 8
#: Labelled rows the model is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Distinct labelled texts a term must occur in to count.
LEAST_TEXTS = 4
THRESHOLD = 0.7
#: Gradient steps at least, so that few labelled rows are fitted as well; terms counted at once, as the driver's memory is small.
LEAST_STEPS, LOT = 3000, 1 << 18


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct term (letters, A-Z lower-cased) of each text."""
    raw, offsets = buffers(column)
    rows, ids = [], []
    for a, b in row_slices(offsets):
        part = LOWER[raw[offsets[a]:offsets[b]]]
        start, end, first = word_bounds(part, offsets[a:b + 1] - offsets[a], LETTERS)
        hashed = (SpanHash(byte_symbols(part)).spans(start, end) >> np.uint64(44)).astype(np.int64)
        row = np.repeat(np.arange(a, b), np.diff(first))
        pair = np.unique(row * BUCKETS + hashed)
        rows.append(pair // BUCKETS)
        ids.append(pair % BUCKETS)
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(ids or [none])


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + pair interactions <v_i, v_j>) over the kept terms of a text."""

    place: np.ndarray  # of each hash bucket: its term's place, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid of n rows with the given (row, term place) pairs."""
        out = self.bias + np.bincount(row, self.linear[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        row, bucket = terms(column)
        place = self.place[bucket]
        keep = place >= 0
        z = self.raw(row[keep], place[keep], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, epochs: int = 60, rate: float = 0.1,
        decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss; terms are those most associated with the label.

    Texts with equal term sets count once when terms are chosen, so copies of one text cannot vote many times.
    """
    n = len(label)
    place = np.full(BUCKETS, -1, np.int32)
    rng = np.random.default_rng(seed)
    if n == 0:
        return Machine(place, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    sets: dict[tuple[int, int], int] = {}
    mark = np.zeros(n, bool)
    sums, df, pos = np.zeros(n), np.zeros(BUCKETS), np.zeros(BUCKETS)
    lots = [slice(a, a + LOT) for a in range(0, len(row), LOT)]  # whole numbers, so lots add up to the same
    for lot in lots:
        sums += np.bincount(row[lot], ((bucket[lot].astype(np.int64) * 2654435761) % 1000003).astype(float), n)
    for i, s in enumerate(zip(np.bincount(row, minlength=n), sums)):
        if s not in sets:
            sets[s] = i
            mark[i] = True
    y1, n1 = label[mark].sum(), mark.sum()
    for lot in lots:
        use = mark[row[lot]]
        df += np.bincount(bucket[lot][use], minlength=BUCKETS)
        pos += np.bincount(bucket[lot][use], label[row[lot][use]], BUCKETS)
    rate1 = y1 / n1
    chi = np.where(df >= LEAST_TEXTS, (pos - df * rate1) ** 2 / np.maximum(df * rate1 * (1 - rate1), 1e-9), 0.0)
    chosen = np.argsort(-chi, kind="stable")[:TERMS]
    chosen = chosen[chi[chosen] > 10.83]  # 0.1 % level of one degree of freedom
    place[chosen] = np.arange(len(chosen))
    del sets, sums, df, pos, chi
    keep = place[bucket] >= 0
    row, term = row[keep], place[bucket[keep]]
    prior = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m = Machine(place, float(np.log(prior / (1 - prior))), np.zeros(len(chosen)),
                rng.normal(0, 0.01, (len(chosen), FACTORS)))
    g0, gw, gv = 1e-8, np.full(len(chosen), 1e-8), np.full((len(chosen), FACTORS), 1e-8)
    if not len(chosen):
        return m
    order = np.argsort(row, kind="stable")
    row, term = row[order], term[order]
    first = np.searchsorted(row, np.arange(n + 1))
    block = 256
    for _ in range(max(epochs, -(-LEAST_STEPS * block // n))):
        for lot in np.array_split(rng.permutation(n), max(1, n // block)):
            place_of = np.argsort(lot)  # terms of the lot's rows, by row
            own = lot[place_of]
            many = first[own + 1] - first[own]
            r = np.repeat(place_of, many)
            t = term[np.arange(len(r)) + np.repeat(first[own] - np.cumsum(many) + many, many)]
            p = 1 / (1 + np.exp(-np.clip(m.raw(r, t, len(lot)), -30, 30)))
            err = p - label[lot]
            d0 = err.mean()
            dw = np.bincount(t, err[r], len(chosen)) / len(lot) + decay * m.linear
            dv = np.empty_like(m.factors)
            for f in range(FACTORS):
                v = m.factors[t, f]
                dv[:, f] = np.bincount(t, err[r] * (np.bincount(r, v, len(lot))[r] - v), len(chosen)) / len(lot)
            dv += decay * m.factors
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            m.bias -= rate * d0 / np.sqrt(g0)
            m.linear -= rate * dw / np.sqrt(gw)
            m.factors -= rate * dv / np.sqrt(gv)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Machine:
    """Fit on at most ``rows`` labelled rows outside the held-out third (crc32 of the id modulo 3 is 1).

    Rows with a null id or label are left out; of several labels of one id the highest counts; without any labelled
    row every score is 0.5. Only hashed terms of the chosen rows reach the driver.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lab = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("double").alias("label")) \
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held) \
        .groupBy("doc_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = keyed(docs, doc_id, text).select("doc_id", "text").join(F.broadcast(lab), "doc_id")  # at most ``rows`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = terms(batch["text"])
            cut = np.searchsorted(row, np.arange(1, batch.num_rows))
            sets = [x.astype("<i4").tobytes() for x in np.split(bucket, cut)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(sets[:batch.num_rows], pa.binary())],
                                             ["doc_id", "label", "terms"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    got = sorted(((r["doc_id"], r["terms"], r["label"]) for r in joined.select("doc_id", "text", "label").mapInArrow(
        run, f"doc_id {kind}, label double, terms binary").toLocalIterator()), key=lambda r: r[:2])
    label_ = np.array([float(r[2] > 0) for r in got])
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r[1]) // 4 for r in got])
    bucket = np.frombuffer(b"".join(r[1] for r in got), "<i4")
    del got
    machine = fit(row, bucket, label_)
    del row, bucket
    give_back_memory()
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, doc_id: str = "doc_id",
          text: str = "text", with_key: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (and ``key``) of every row, from its whole text alone.

    Null and empty texts get the score of a text without known terms; repeated rows are answered each; an empty
    table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, doc_id, text)
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bound: BUCKETS places and TERMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(model.value.score(batch["text"]))],
                                             ["doc_id", "key", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.mapInArrow(run, f"doc_id {kind}, key long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        *["key"] * with_key)

"""Hard negatives by exact scores: anchors' subset-sum tables, looked up by the candidates' packed bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodgemetrics.llm.shared import staged

#: Anchors broadcast at once; anchors whose tables are held at once; candidates scored at once.
CHUNK, TABLES, ROWS = 16_384, 64, 2048
#: Hits held for each slot before they are reduced to the best.
HELD = 4


def quantized(df: DataFrame, label: Column, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, label, v``: integer vectors floor(scale * x). Rows with a null id, label or vector, or with a null or
    non-finite component, take no part. A component must stay under 2**53 after scaling."""
    x = F.transform(df[embedding].cast("array<double>"), lambda c: F.when(F.abs(c) < float("inf"), c))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return df.select(df[vec_id].cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")) \
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", lambda c: c.isNull()))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def bit_planes(v: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit i of eight dimensions each, two's complement; the last plane counts negative."""
    padded = np.zeros((len(v), -(-v.shape[1] // 8) * 8), np.int64)
    padded[:, :v.shape[1]] = v
    return np.stack([np.packbits(((padded >> i) & 1).astype(np.uint8), axis=1, bitorder="little") for i in range(bits)], axis=1)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for eight dimensions at a time, the sum of each subset of an anchor's components."""
    n, dim = anchors.shape
    padded = np.zeros((n, -(-dim // 8) * 8), kind)
    padded[:, :dim] = anchors
    by_group = padded.T.reshape(-1, 8, n)
    out = np.zeros((len(by_group), 256, n), kind)
    for k in range(8):
        out[:, 1 << k:2 << k] = out[:, :1 << k] + by_group[:, k, None]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: from the highest plane down, double what is there and add the table entries."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    entry = np.empty_like(total)
    for i in range(bits - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[:, i, g], axis=0, out=entry, mode="clip")
            total += entry
        if i == bits - 1:
            np.negative(total, out=total)
    return total


class Best:
    """The ``k`` highest scores of each slot, ties to the smaller id, of all hits added so far."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, np.iinfo(np.int64).min)  # what a further hit must reach
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Hits of a block: ``score`` (rows, slots) where ``fits``."""
        fits = fits & (score >= self.least[slots])
        if fits.sum() > 4 * self.k * len(slots) and len(score) > self.k:  # cut each column down to its own best
            low = np.where(fits, score, np.iinfo(score.dtype).min)
            fits &= score >= np.partition(low, len(low) - self.k, axis=0)[len(low) - self.k]
        row, col = np.nonzero(fits)
        if len(row):
            self.hits.append((slots[col], score[row, col].astype(np.int64), ids[row]))
            self.held += len(row)
            if self.held > HELD * self.k * len(self.least) + 100_000:
                self.reduced()

    def reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of the best hits."""
        none = np.zeros(0, np.int64)
        slot, score, ids = (np.concatenate([none, *x]) for x in zip(*self.hits)) if self.hits else (none,) * 3
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        keep = place < self.k
        full = place == self.k - 1
        self.least[slot[full]] = score[full]
        self.hits, self.held = [(slot[keep], score[keep], ids[keep])], int(keep.sum())
        return self.hits[0]


class Anchors(NamedTuple):
    """A chunk of anchors of one dimension; ``slot`` numbers them within the chunk."""

    dim: int
    slot: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    v: np.ndarray


def _anchors(table: pa.Table) -> list[Anchors]:
    ids, label, dim = (table[c].to_numpy() for c in ("vec_id", "label", "dim"))
    out = []
    for d in np.unique(dim).tolist():
        own = np.flatnonzero(dim == d)
        out.append(Anchors(d, own, ids[own], label[own], matrix(table["v"].take(pa.array(own)), d)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, labels, planes) of at most ROWS candidates each, sorted by label within a batch."""
    for batch in batches:
        dim = batch["dim"].to_numpy()
        for d in np.unique(dim).tolist():
            own = np.flatnonzero(dim == d)
            label = batch["label"].to_numpy()[own]
            own = own[np.argsort(label, kind="stable")]
            for c in range(0, len(own), ROWS):
                rows = pa.array(own[c:c + ROWS])
                raw = np.frombuffer(b"".join(batch["planes"].take(rows).to_pylist()), np.uint8)
                yield (d, batch["vec_id"].take(rows).to_numpy(), batch["label"].take(rows).to_numpy(),
                       raw.reshape(len(rows), bits, -(-d // 8)))


def _positives(blocks, chunk: list[Anchors], kind: type, k: int, slots: int) -> Best:
    """The k best other rows of each anchor's own label: candidates meet anchors of their label only."""
    best = Best(slots, k)
    for dim, ids, label, planes in blocks:
        for own in chunk:
            if own.dim != dim:
                continue
            for value in np.intersect1d(label, own.label).tolist():
                rows, mine = np.flatnonzero(label == value), np.flatnonzero(own.label == value)
                for c in range(0, len(mine), TABLES):
                    part = mine[c:c + TABLES]
                    found = scores(planes[rows], subset_sums(own.v[part], kind))
                    best.add(own.slot[part], found, ids[rows], ids[rows][:, None] != own.ids[part])
    return best


def _negatives(blocks, chunk: list[Anchors], kind: type, k: int, low: np.ndarray, high: np.ndarray) -> Best:
    """For each anchor and each of its positives (slots anchor * width + place), the k best rows of other labels with a
    score from ``low`` to ``high`` (anchors, width; low above high: no positive there)."""
    width = low.shape[1]
    best = Best(low.size, k)
    for dim, ids, label, planes in blocks:
        for own in chunk:
            if own.dim != dim:
                continue
            for c in range(0, len(own.ids), TABLES):
                slot = own.slot[c:c + TABLES]
                found = scores(planes, subset_sums(own.v[c:c + TABLES], kind))
                other = (label[:, None] != own.label[c:c + TABLES]) & (ids[:, None] != own.ids[c:c + TABLES])
                for place in range(width):
                    best.add(slot * width + place, found, ids,
                             other & (found >= low[slot, place]) & (found <= high[slot, place]))
    return best


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each slot; each task brought at most k."""
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _hits(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in best.reduced()], ["slot", "score", "vec_id"])


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50,
         most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` and ``anchors`` come from ``quantized``. An anchor's positives are the ``positives`` other vectors of
    its label with the highest inner products; for each of them, the negatives are the ``negatives`` highest rows of
    other labels with least * positive <= 100 * negative <= most * positive. Ties go to the smaller id; ``rank`` counts
    from 1. Only vectors of the anchor's dimension are compared. Rows with the anchor's id are not its positives or
    negatives; a repeated anchor row is answered each time; empty tables give no rows; other columns are ignored.
    ValueError if scores may not fit in 64 bits.

    Every pair of anchor and vector is scored once: in a first pass those of one label, in a second those of
    different ones. Vectors are packed once and stay where they are; anchors go to them in broadcast chunks of about
    CHUNK rows, as do the chunk's ``positives`` scores for the second pass. A task keeps the best of each slot, so it
    sends on as many rows as the chunk has slots, however many vectors it met.
    """
    spark = vectors.sparkSession
    sized = vectors.select("vec_id", "label", "v", F.size("v").alias("dim")).filter("dim > 0")
    own = staged(anchors.select("vec_id", "label", "v", F.size("v").alias("dim"),
                                F.monotonically_increasing_id().alias("row")).filter("dim > 0"), "anchors")
    span = sized.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"), F.max("dim").alias("dim")).first()
    mine_ = own.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if span["dim"] is None or not mine_["n"]:
        return spark.createDataFrame([], schema)
    size, reach = (max(abs(int(x["lo"])), abs(int(x["hi"]))) for x in (span, mine_))
    bits = max(int(span["hi"]).bit_length(), (-int(span["lo"]) - 1).bit_length() if span["lo"] < 0 else 0) + 1
    bound = max(1, reach) * max(1, size) * 4 * span["dim"]  # sums of planes stay under twice a score's bound
    if bound * 100 >= 2 ** 63:
        raise ValueError("scores do not fit in 64 bits")
    kind = np.int32 if bound < 2 ** 31 else np.int64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch["dim"].to_numpy()
            for d in np.unique(dim).tolist():
                rows = pa.array(np.flatnonzero(dim == d))
                part = batch.take(rows)
                data = [x.tobytes() for x in bit_planes(matrix(part["v"], d), bits)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], part["dim"], pa.array(data, pa.binary())],
                                                 ["vec_id", "label", "dim", "planes"])

    packed = staged(sized.mapInArrow(pack, "vec_id long, label long, dim int, planes binary"), "planes")
    chunks = -(-mine_["n"] // CHUNK)
    out = None
    for c in range(chunks):
        table = own.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).select("vec_id", "label", "dim", "v").toArrow()
        if not table.num_rows:
            continue
        found = staged(_chunk(packed, table, kind, bits, positives, negatives, least, most), "negatives")
        out = found if out is None else out.unionByName(found)
    return out


def _chunk(packed: DataFrame, table: pa.Table, kind: type, bits: int, positives: int, negatives: int, least: int,
           most: int) -> DataFrame:
    """The negatives of one chunk of anchors."""
    context = packed.sparkSession.sparkContext
    held = context.broadcast(_anchors(table))
    slots = table.num_rows
    hit = "slot long, score long, vec_id long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _hits(_positives(_blocks(batches, bits), held.value, kind, positives, slots))

    top = _ranked(packed.mapInArrow(first, hit), positives).toArrow()  # at most positives * CHUNK rows
    slot, place = top["slot"].to_numpy(), top["rank"].to_numpy() - 1
    score, positive = (np.zeros((slots, positives), np.int64) for _ in range(2))
    score[slot, place], positive[slot, place] = top["score"].to_numpy(), top["vec_id"].to_numpy()
    low, high = np.ones((slots, positives), np.int64), np.zeros((slots, positives), np.int64)
    low[slot, place] = -(-least * score[slot, place] // 100)
    high[slot, place] = most * score[slot, place] // 100
    limits = context.broadcast((low, high))
    names = context.broadcast((table["vec_id"].to_numpy(), positive, score))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _hits(_negatives(_blocks(batches, bits), held.value, kind, negatives, *limits.value))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, positive, score = names.value
        for batch in batches:
            slot = batch["slot"].to_numpy()
            anchor, place = slot // positives, slot % positives
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[anchor]), pa.array(positive[anchor, place]), batch["rank"], batch["vec_id"],
                 pa.array(score[anchor, place]), batch["score"]],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return _ranked(packed.mapInArrow(second, hit), negatives).mapInArrow(
        named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

"""Repeated byte strings by suffix arrays: longest-previous-factor arrays over the places where texts may repeat."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm import anchors
from lodgemetrics.llm.shared import buffers, keyed

#: Bytes of a string and of an anchor; bytes sorted in one suffix array; blocks of an anchor beyond which they are
#: split into slabs of windows and grouped by hashes instead (exact as well), so that no task meets an unbounded group.
WINDOW, ANCHOR, SORTED, HOT, SLAB = 400, 200, 1 << 18, 200, 16


class Ranks(NamedTuple):
    """Ranks of all suffixes by their first ``step`` symbols, and by the first half of ``whole`` of them."""

    step: int
    part: np.ndarray
    whole: np.ndarray


def suffix_ranks(text: np.ndarray, window: int) -> Ranks:
    """Suffix order by prefix doubling, from packed symbols below 512 on, until it covers ``window`` symbols.

    ``part`` holds the last ranks by at most ``window`` symbols, ``whole`` those that cover them.
    """
    n, step = len(text), min(7, window)
    packed = np.zeros(n, np.int64)
    for i in range(step):
        packed *= 512
        packed[:max(0, n - i)] += text[i:]
    order = np.argsort(packed)
    part = rank = _ranks(packed, order)
    part_step = step
    while step < window:
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 1) + after
        rank = _ranks(pair, np.argsort(pair))
        step *= 2
        if step <= window:
            part, part_step = rank, step
    return Ranks(part_step, part, rank)


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
    return rank


def _smaller(order: np.ndarray) -> np.ndarray:
    """Slot of the nearest value before each slot that is smaller (-1: none): candidates jump along found links."""
    at = np.arange(len(order)) - 1
    wrong = np.flatnonzero((at >= 0) & (order[np.maximum(at, 0)] > order))
    while len(wrong):
        at[wrong] = at[at[wrong]]
        there = at[wrong]
        wrong = wrong[(there >= 0) & (order[np.maximum(there, 0)] > order[wrong])]
    return at


def previous_factors(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The array of longest previous factors, up to ``window``: for each of the positions ``starts`` (rising), an
    earlier one of them with which it shares ``window`` symbols, or -1 where the longest previous factor is shorter.

    In suffix order, an earlier position with the longest match is the previous or the next smaller one.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(text, window)
    mine = ranks.whole[starts]
    order = np.argsort(mine * (len(text) + 1) + starts)  # suffix order, ties by position
    before = _smaller(order)
    after = len(order) - 1 - _smaller(order[::-1])[::-1]
    source = np.full(len(starts), -1)
    for slot in (before, after):
        there = np.flatnonzero((slot >= 0) & (slot < len(order)))
        a, b = order[there], order[slot[there]]
        same = np.ones(len(a), bool)
        for at in range(0, window - ranks.step + 1, ranks.step):
            same &= ranks.part[starts[a] + at] == ranks.part[starts[b] + at]
        same &= ranks.part[starts[a] + window - ranks.step] == ranks.part[starts[b] + window - ranks.step]
        source[a[same]] = b[same]
    return source


def _repeats(data: list[bytes], window: int, keep_first: bool) -> list[np.ndarray]:
    """Of each string: its positions whose ``window`` bytes also stand at another position of the strings.

    keep_first leaves out positions that have no earlier match."""
    sizes = np.array([len(d) for d in data])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.full(int(at[-1]), 256, np.int64)  # ends of strings; no window holds one
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(data)), sizes)] = np.frombuffer(b"".join(data), np.uint8)
    windows = np.maximum(0, sizes - window + 1)
    first = np.concatenate([[0], np.cumsum(windows)])
    starts = np.arange(first[-1]) - np.repeat(first[:-1], windows) + np.repeat(at[:-1], windows)
    source = previous_factors(text, starts, window)
    hit = source >= 0
    if not keep_first:
        hit[source[source >= 0]] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(first[:-1], first[1:])]


def _block_bytes(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``gram, doc_id, key, start, single, data``: the bytes of each span (start, n windows)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["gram", "doc_id", "key", "start", "single", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            row, spans = [], []
            for i, x in enumerate(batch["spans"].to_pylist()):
                row += [i] * len(x)
                spans += x
            take = pa.array(row, pa.int64())
            data = [raw[offsets[i] + s["start"]:offsets[i] + s["start"] + s["n"] - 1 + window].tobytes()
                    for i, s in zip(row, spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s["gram"] for s in spans], pa.int64()), batch["doc_id"].take(take), batch["key"].take(take),
                 pa.array([s["start"] for s in spans], pa.int64()), pa.array([s["single"] for s in spans], pa.bool_()),
                 pa.array(data, pa.binary())], names)

    return anchors.with_lists(rows, spans, "start", "n", "gram", "single").mapInArrow(
        run, f"gram long, doc_id {kind}, key long, start long, single boolean, data binary")


def _factor_repeats(blocks: DataFrame, window: int) -> DataFrame:
    """``doc_id, key, start, n`` of repeated windows, from suffix arrays over whole groups of one anchor hash."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "start", "n"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hits = _repeats(rows["data"].to_pylist(), window, False)
        single = rows["single"].to_pylist()
        start = rows["start"].to_pylist()
        row, place = [], []
        for i, h in enumerate(hits):
            if single[i] and len(h):
                row.append(np.full(len(h), i))
                place.append(h + start[i])
        if row:
            take = pa.array(np.concatenate(row))
            at = np.concatenate(place)
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].take(take).combine_chunks(), rows["key"].take(take).combine_chunks(), pa.array(at),
                 pa.array(np.ones(len(at), np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # whole groups, and the one that may go on in the next batch
        for batch in batches:  # sorted by gram
            table = pa.Table.from_batches([batch])
            size = np.cumsum(pc.binary_length(table["data"]).to_numpy())
            gram = table["gram"].to_numpy()
            begun = sum(t.nbytes for t in held)
            last = 0
            for cut in [0, *(np.flatnonzero(np.diff(gram)) + 1).tolist()]:
                if cut == 0 and held and held[-1]["gram"][-1].as_py() == gram[0]:
                    continue
                if begun + size[cut - 1] * (cut > 0) - size[last - 1] * (last > 0) >= SORTED:
                    held.append(table.slice(last, cut - last))
                    yield from solve(pa.concat_tables(held))
                    held, begun, last = [], 0, cut
            held.append(table.slice(last))
        if held:
            yield from solve(pa.concat_tables(held))

    return blocks.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        run, f"doc_id {kind}, key long, start long, n long")


def repeated_spans(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``doc_id, key, start, n``: n windows of bytes from ``start`` on that also start elsewhere, of keyed rows."""
    known = anchors.sorted_out(anchors.staged(anchors.find_blocks(rows, window, k, False), "byte-blocks"), "byte-repeats")
    whole = known.filter("copies > 1").select("doc_id", "key", "start", "n")
    open_ = known.filter("first and kinds > 1").select(
        "doc_id", "key", "start", "n", "lead", "gram", "kinds", (F.col("copies") == 1).alias("single"))
    few = _factor_repeats(_block_bytes(rows, open_.filter(F.col("kinds") <= HOT), window), window)
    slabs = anchors.sorted_out(anchors.staged(anchors.find_slabs(rows, open_.filter(F.col("kinds") > HOT), window, SLAB),
                                              "byte-slabs"), "slab-repeats")
    alike = slabs.filter("copies > 1").select("doc_id", "key", "start", "n")
    left = slabs.filter("first and kinds > 1").select("doc_id", "key", "start", "n", (F.col("copies") == 1).alias("single"))
    many = anchors.repeated_windows(rows, left, window, False, "byte-windows")
    return whole.unionByName(few).unionByName(alike).unionByName(many)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed (start, end), kept``: each text's bytes outside repeated strings of ``window`` bytes.

    Texts are taken as UTF-8 bytes, so ``kept`` is binary: a cut may fall inside a character. Null and empty texts
    have no bytes; texts shorter than the window keep all; repeated rows are repeats of each other; an empty table
    gives no rows; other columns are ignored.
    """
    rows = keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            size, removed, kept = np.diff(offsets), [], []
            for i, spans in enumerate(batch["spans"].to_pylist()):
                mine = raw[offsets[i]:offsets[i + 1]]
                if not spans:
                    removed.append([])
                    kept.append(mine.tobytes())
                    continue
                gone = anchors.covered(spans, window, len(mine))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(mine[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(removed, spans_type),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return anchors.with_lists(rows, repeated_spans(rows, window, k), "start", "n", how="left").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))

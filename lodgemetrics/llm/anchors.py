"""Repeated windows of symbols (words or bytes), found by anchors.

A window's anchor is the position of its least k-symbol hash (the leftmost, if several). It depends on the window's
symbols alone, so equal windows have equal anchors at equal places. Consecutive windows of one text with one anchor
form a block. Windows repeat only between blocks whose anchors have the same hash: whole blocks are compared first,
windows only where one anchor hash stands in different blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm.shared import (
    SLICE, SpanHash, buffers, byte_symbols, drop_staged, mix, row_slices, second, sliding_min, staged, word_bounds)

_PLACE = np.uint64((1 << 22) - 1)  # a slice has fewer symbols


class Slice(NamedTuple):
    """Symbols of texts row, row + 1, ... that begin at ``first``; of one long text from symbol ``shift`` on."""

    row: int
    shift: int
    symbols: np.ndarray
    first: np.ndarray


def word_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each text's first word."""
    start, end, first = word_bounds(raw, offsets)
    return SpanHash(byte_symbols(raw)).spans(start, end), first


def slices(column: pa.Array, window: int, words: bool) -> Iterator[Slice]:
    """All texts as symbols, in slices of bounded size; parts of a long text overlap by a window less one."""
    raw, offsets = buffers(column)
    for a, b in row_slices(offsets):
        part, off = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if not words:
            if len(part) <= SLICE + window:
                yield Slice(a, 0, byte_symbols(part), off)
            else:
                for c in range(0, len(part) - window + 1, SLICE):
                    piece = part[c:c + SLICE + window - 1]
                    yield Slice(a, c, byte_symbols(piece), np.array([0, len(piece)]))
            continue
        if len(part) <= SLICE + window:
            yield Slice(a, 0, *word_symbols(part, off))
            continue
        symbols = long_text_words(part)
        for c in range(0, max(1, len(symbols) - window + 1), SLICE):
            piece = symbols[c:c + SLICE + window - 1]
            yield Slice(a, c, piece, np.array([0, len(piece)]))


def long_text_words(part: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, hashed in pieces that end between words (or a word longer than a slice whole)."""
    space = np.flatnonzero((part == 0x20) | ((part >= 0x09) & (part <= 0x0D)))
    out, a = [], 0
    while a < len(part):
        b = len(part)
        if b - a > SLICE:
            k = int(np.searchsorted(space, a + SLICE, "right")) - 1
            if k >= 0 and space[k] > a:
                b = int(space[k])
            elif k + 1 < len(space):
                b = int(space[k + 1])
        out.append(word_symbols(part[a:b], np.array([0, b - a]))[0])
        a = b
    return np.concatenate(out)


class Blocks(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # first window, in symbols of its text
    n: np.ndarray  # windows
    lead: np.ndarray  # symbols from the first window to the anchor
    gram: np.ndarray  # hash at the anchor
    one: np.ndarray  # 128-bit hash of the block's symbols
    two: np.ndarray


def blocks(part: Slice, window: int, k: int) -> Blocks:
    """Blocks of a slice."""
    n = len(part.symbols) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, none, *(none.view(np.uint64),) * 3)
    hashed = SpanHash(part.symbols)
    gram = hashed.every(k)
    least = sliding_min((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), window - k + 1)
    ends = np.repeat(part.first[1:], np.diff(part.first))[:n]
    at = np.flatnonzero(np.arange(window, window + n) <= ends)
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    a = at[new]
    size = np.diff(np.append(new, len(at)))
    row = np.searchsorted(part.first, a, "right") - 1
    end = a + size - 1 + window
    return Blocks(row + part.row, a - part.first[row] + part.shift, size, anchor[new] - a, mix(gram[anchor[new]]),
                  hashed.spans(a, end), second(part.symbols).spans(a, end))


def windows(part: Slice, window: int, lists: list, at: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, start, one, two): 128-bit hash of each window of the listed (start, n) ranges of each row."""
    hashed, other = SpanHash(part.symbols), second(part.symbols)
    entry, start = [], []
    for row in range(part.row, part.row + len(part.first) - 1):
        base = int(part.first[row - part.row])
        size = int(part.first[row - part.row + 1]) - base
        for s, n, e in zip(lists[row][0], lists[row][1], at[row]):
            lo, hi = max(0, s - part.shift), min(s + n - part.shift, size - window + 1)
            if hi > lo:
                entry.append(np.full(hi - lo, e))
                start.append(np.arange(lo, hi) + base)
    none = np.zeros(0, np.int64)
    e, p = np.concatenate([none, *entry]), np.concatenate([none, *start])
    row = np.searchsorted(part.first, p, "right") - 1
    return e, p - part.first[row] + part.shift, hashed.spans(p, p + window), other.spans(p, p + window)


BLOCK_NAMES = ["doc_id", "key", "start", "n", "lead", "gram", "one", "two", "at"]
BLOCK_SCHEMA = "doc_id {}, key long, start long, n long, lead long, gram long, one long, two long, at long"


def find_blocks(rows: DataFrame, window: int, k: int, words: bool, keep=None) -> DataFrame:
    """Blocks of keyed rows; ``at`` numbers a block by its place. keep: a broadcast test of anchor hashes."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = BLOCK_NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch["key"]).view(np.uint64)
            for part in slices(batch["text"], window, words):
                b = blocks(part, window, k)
                if keep is not None:
                    use = keep.value(b.gram)
                    b = Blocks(*(x[use] for x in b))
                if len(b.row):
                    yield _block_batch(batch, keys, b)

    return rows.mapInArrow(run, BLOCK_SCHEMA.format(kind))


def _block_batch(batch: pa.RecordBatch, keys: np.ndarray, b: Blocks) -> pa.RecordBatch:
    at = mix(keys[b.row] + b.start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    take = pa.array(b.row)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(take), batch["key"].take(take), pa.array(b.start), pa.array(b.n), pa.array(b.lead),
         *(pa.array(x.view(np.int64)) for x in (b.gram, b.one, b.two, at))], BLOCK_NAMES)


def find_slabs(rows: DataFrame, spans: DataFrame, window: int, slab: int) -> DataFrame:
    """The blocks ``spans`` (start, n, lead) of byte rows, cut into slabs of windows: offsets from the anchor that
    share one quotient by ``slab``. All windows of a slab hold its core, ``window - slab + 1`` bytes; a slab's hash at
    the core takes the place of the anchor's. So an anchor that stands in many different blocks is split up: only
    slabs with the same core, hence with that many bytes in common, are compared further.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch["key"]).view(np.uint64)
            lists = batch["spans"].to_pylist()
            for part in slices(batch["text"], window, False):
                hashed, other = SpanHash(part.symbols), second(part.symbols)
                found = []
                for row in range(part.row, part.row + len(part.first) - 1):
                    base = int(part.first[row - part.row])
                    size = int(part.first[row - part.row + 1]) - base
                    for s in lists[row]:
                        lo, hi = max(0, s["start"] - part.shift), min(s["start"] + s["n"] - part.shift, size - window + 1)
                        anchor = s["start"] + s["lead"] - part.shift
                        while lo < hi:
                            q = (anchor - lo) // slab
                            end = min(hi, anchor - q * slab + 1)
                            found.append((row, base, lo, end - lo, anchor - q * slab, q))
                            lo = end
                if not found:
                    continue
                row, base, start, n, core, q = np.array(found, np.int64).T
                a, c = base + start, base + core
                gram = mix(hashed.spans(c, c + window - slab + 1) + q.astype(np.uint64))
                end = a + n - 1 + window
                yield _block_batch(batch, keys, Blocks(row, start + part.shift, n, core - start, gram,
                                                       hashed.spans(a, end), other.spans(a, end)))

    return with_lists(rows, spans, "start", "n", "lead").mapInArrow(run, BLOCK_SCHEMA.format(kind))


#: Blocks of one anchor hash that a task reads in order; anchors in more of them are counted by joins.
CROWDED = 100_000
_KNOWN = ["doc_id", "key", "start", "n", "lead", "gram", "copies", "kinds", "first"]


def sorted_out(found: DataFrame, tag: str) -> DataFrame:
    """Of the staged blocks ``found`` (deleted here) those that matter, staged: ``copies`` of the whole block, ``kinds``
    of different blocks at its anchor hash (1 where none of them is single, so that none has anything to find), and
    ``first``, true for one row of each block. Blocks whose anchor stands nowhere else are left out.

    Blocks go once to the task of their anchor hash and are read there in order. Anchors in more than CROWDED blocks, of
    which there are at most the number of blocks divided by that, are told apart first and take plain joins, which the
    engine can split.
    """
    crowded = staged(found.groupBy("gram").count().filter(F.col("count") > CROWDED).select(F.col("gram").alias("g")), tag + "-crowded")
    hot = F.broadcast(crowded)
    rest = found.join(hot, found["gram"] == hot["g"], "left_anti")
    kind = found.schema["doc_id"].dataType.simpleString()

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        gram, one, two = (table[c].to_numpy() for c in ("gram", "one", "two"))
        new_gram = np.append(True, np.diff(gram) != 0)
        new_block = new_gram | np.append(True, (np.diff(one) != 0) | (np.diff(two) != 0))
        block = np.cumsum(new_block) - 1
        copies = np.bincount(block)
        of_block = np.flatnonzero(new_gram[new_block])  # each anchor's first block
        kinds = np.diff(np.append(of_block, len(copies)))
        kinds = np.where(np.minimum.reduceat(copies, of_block) == 1, kinds, 1)
        at = np.cumsum(new_gram) - 1
        use = np.bincount(at)[at] > 1
        out = table.select(_KNOWN[:6]).append_column("copies", pa.array(copies[block])).append_column(
            "kinds", pa.array(kinds[at])).append_column("first", pa.array(new_block))
        yield from out.filter(pa.array(use)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch["gram"].to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))  # the batch's last anchor may go on
            if held and (last > 0 or held[-1]["gram"][-1].as_py() != gram[0]):
                yield from solve([*held, batch.slice(0, last)])
                held = []
            elif last > 0:
                yield from solve([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from solve(held)

    ordered = rest.select(*_KNOWN[:6], "one", "two", "at").repartition("gram").sortWithinPartitions("gram", "one", "two", "at")
    whole = ordered.mapInArrow(run, f"doc_id {kind}, key long, start long, n long, lead long, gram long, copies long, kinds long, first boolean")
    out = staged(whole.unionByName(_joined(found.join(hot, found["gram"] == hot["g"], "left_semi"))), tag)
    drop_staged(found)
    return out


def _joined(found: DataFrame) -> DataFrame:
    """The same for crowded anchors: counts combine before each shuffle, and joins may be split."""
    same = found.groupBy("gram", "one", "two").agg(F.count("*").alias("copies"), F.min("at").alias("least"))
    kinds = same.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total"), F.min("copies").alias("least_copies")) \
        .filter(F.col("total") > 1).select("gram", F.when(F.col("least_copies") == 1, F.col("kinds")).otherwise(1).alias("kinds"))
    known = same.join(kinds, "gram")
    known = known.select(F.col("gram").alias("g"), F.col("one").alias("o"), F.col("two").alias("t"), "copies", "least", "kinds")
    both = found.join(known, (found["gram"] == known["g"]) & (found["one"] == known["o"]) & (found["two"] == known["t"]))
    return both.select(*_KNOWN[:6], "copies", "kinds", (F.col("at") == F.col("least")).alias("first"))


def with_lists(rows: DataFrame, spans: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Keyed rows joined with the lists of their spans (as many as the text is long, at most)."""
    lists = spans.groupBy(spans["doc_id"].alias("span_doc"), spans["key"].alias("span_key")).agg(
        F.collect_list(F.struct(*columns)).alias("spans"))
    return rows.join(lists, rows["doc_id"].eqNullSafe(lists["span_doc"]) & (rows["key"] == lists["span_key"]), how) \
        .select("doc_id", "key", "text", "spans")


def find_windows(rows: DataFrame, spans: DataFrame, window: int, words: bool) -> DataFrame:
    """``doc_id, key, start, one, two, single`` of every window in the given spans (start, n, single)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "start", "one", "two", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [([s["start"] for s in x], [s["n"] for s in x]) for x in batch["spans"].to_pylist()]
            single = np.array([s["single"] for x in batch["spans"].to_pylist() for s in x], bool)
            at, done = [], 0
            for x in lists:
                at.append(range(done, done + len(x[0])))
                done += len(x[0])
            row_of = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
            for part in slices(batch["text"], window, words):
                entry, start, one, two = windows(part, window, lists, at)
                if len(entry):
                    take = pa.array(row_of[entry])
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(take), batch["key"].take(take), pa.array(start),
                         pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(single[entry])], names)

    return with_lists(rows, spans, "start", "n", "single").mapInArrow(
        run, f"doc_id {kind}, key long, start long, one long, two long, single boolean")


def repeated_windows(rows: DataFrame, spans: DataFrame, window: int, words: bool, tag: str) -> DataFrame:
    """``doc_id, key, start, n`` of the windows in ``spans`` that stand in at least two of them, where single."""
    found = staged(find_windows(rows, spans, window, words), tag)
    twice = found.groupBy("one", "two").count().filter(F.col("count") > 1).select(
        F.col("one").alias("o"), F.col("two").alias("t"))
    mine = found.filter("single")
    return mine.join(twice, (mine["one"] == twice["o"]) & (mine["two"] == twice["t"]), "left_semi") \
        .select("doc_id", "key", "start", F.lit(1).cast("long").alias("n"))


def covered(spans: list[dict], window: int, length: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a window that starts in one of the spans."""
    step = np.zeros(length + 1, np.int64)
    if spans:
        start = np.array([s["start"] for s in spans])
        np.add.at(step, start, 1)
        np.add.at(step, start + np.array([s["n"] for s in spans]) - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0

"""Count-min sketches of partitions, merged as a tree over shards of cells, that tell hashes seen at least twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Hash rows; cells of a shard; largest and least width as powers of two; partition sketches merged at once; hashes that a
#: task sketches at once.
ROWS, SHARD, WIDEST, NARROWEST, FAN, LOT = 2, 20, 28, 20, 64, 1 << 20
_NAMES = ["line", "shard", "lot", "once", "more"]
SCHEMA = "line int, shard int, lot int, once binary, more binary"


def width_for(expected: int, cells_each: int = 8) -> int:
    """Power of two with about so many cells for each expected hash, up to WIDEST; beyond that estimates only rise."""
    return int(min(WIDEST, max(NARROWEST, int(cells_each * max(1, expected)).bit_length())))


class Repeated:
    """Which hashes may occur twice or more: the least of ROWS cells, so never a miss. At most 2 x 2**WIDEST bits."""

    def __init__(self, width: int, shards: Iterable[tuple[int, int, bytes]]):
        self.width = width
        self.bits = [np.zeros(1 << (width - 3), np.uint8) for _ in range(ROWS)]
        size = 1 << (SHARD - 3)
        for line, shard, data in shards:
            self.bits[line][shard * size:(shard + 1) * size] = np.frombuffer(data, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for line in range(ROWS):
            cell = cells(hashes, line, self.width)
            out &= (self.bits[line][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return out


def cells(hashes: np.ndarray, line: int, width: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * line)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _packed(cells_: np.ndarray) -> bytes:
    """Rising cells as gaps of two bytes, low bytes first, which compress well; of four where a gap needs them."""
    gaps = np.diff(cells_, prepend=0)
    if gaps.max(initial=0) > 0xFFFF:
        return b"\4" + gaps.astype("<u4").tobytes()
    return b"\2" + gaps.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    gaps = raw.view("<u4") if data[0] == 4 else np.ascontiguousarray(raw.reshape(2, -1).T).view("<u2").ravel()
    return np.cumsum(gaps.astype(np.int64))


def partition_sketch(parts: list[np.ndarray], width: int) -> pa.RecordBatch:
    """A sketch of one task's hashes, by shard: cells counted once, and cells counted more often, as sorted positions."""
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    lot = TaskContext.get().partitionId()
    out: list[tuple] = []
    for line in range(ROWS):
        cell = cells(hashes, line, width).astype(np.uint32)
        cell.sort()
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        n, cell = np.diff(np.append(first, len(cell))), cell[first].astype(np.int64)
        shard = cell >> SHARD
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for c, k in zip(np.split(cell, cuts), np.split(n, cuts)):
            if len(c):
                low = c & ((1 << SHARD) - 1)
                out.append((line, int(c[0] >> SHARD), lot, _packed(low[k == 1]), _packed(low[k > 1])))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], _NAMES)


class Lots:
    """Sketches of one task, of LOT hashes or few more each, so that its memory does not follow its rows."""

    def __init__(self, width: int):
        self.width, self.parts, self.many = width, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A sketch, where there are enough hashes for one."""
        self.parts.append(hashes)
        self.many += len(hashes)
        if self.many >= LOT:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """A sketch of the hashes that are left, if any."""
        if self.many:
            found = partition_sketch(self.parts, self.width)
            self.parts, self.many = [], 0
            yield found


def merged(fragments: DataFrame, width: int, partitions: int) -> Repeated:
    """Merge partition sketches FAN at a time, shard by shard; only the merged bits reach the driver.

    ``partitions`` tells about how many there are; the last level takes all that are left of a shard.
    """
    def add(frames: pd.DataFrame, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        once, more = np.zeros(1 << SHARD, bool), np.zeros(1 << SHARD, bool)
        for a, b in zip(frames["once"], frames["more"]):
            if dense:
                one, two = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in (a, b))
                more |= two | (once & one)
                once |= one
            else:
                one, two = _unpacked(a), _unpacked(b)
                more[one[once[one]]] = True
                once[one] = True
                more[two] = True
                once[two] = True
        return once, more

    def level(dense: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key, frames: pd.DataFrame) -> pd.DataFrame:
            once, more = add(frames, dense)
            return pd.DataFrame({"line": [key[0]], "shard": [key[1]], "lot": [key[2]],
                                 "once": [np.packbits(once).tobytes()], "more": [np.packbits(more).tobytes()]})
        return run

    dense = False
    while partitions > FAN:
        lot = F.floor(F.col("lot") / FAN).cast("int")
        fragments = fragments.withColumn("lot", lot).groupBy("line", "shard", "lot").applyInPandas(level(dense), SCHEMA)
        partitions, dense = -(-partitions // FAN), True
    # whatever lots there are: a plan may run with other partitions than the one that was counted
    whole = fragments.withColumn("lot", F.lit(0)).groupBy("line", "shard", "lot")
    fragments = whole.applyInPandas(level(dense), SCHEMA)
    return Repeated(width, (tuple(r) for r in fragments.select("line", "shard", "more").toLocalIterator()))


def sketch(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> Repeated:
    """Sketch of the hashes that ``hashes`` yields for each batch of ``rows``; one pass over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = Lots(width)
        for batch in batches:
            for found in hashes(batch):
                yield from lots.add(found)
        yield from lots.rest()

    return merged(rows.mapInArrow(run, SCHEMA), width, rows.rdd.getNumPartitions())

"""Sequence packing as a cutting-stock problem: column generation on the length histogram, patterns dealt to ranks."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodgemetrics.llm.shared import keyed, staged

#: Tokens of a sequence, tokens of a length step, id that ends a document.
LENGTH, STEP, END_ID = 4096, 16, 2
#: Words a worker remembers, and pivots of the linear program; both bound cost, not what is packed.
MEMORY, PIVOTS = 300_000, 2500

# Characters for which the vocabulary's normaliser is plain lower-casing: below U+0250, without controls and U+0130.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*")
_SMALL = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250))]


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in _SMALL if unicodedata.category(c)[0] == kind)


#: The vocabulary's own split of a lower-cased text, spelled out for those characters.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\s{_of('L')}{_of('N')}]+")
_STATE: dict[str, tuple] = {}


class Words:
    """Token ids of texts, as little-endian 32-bit bytes, from remembered words; other texts, and texts that hold the
    string of an added token (which the library gives its own id), go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, lot: list[str]) -> list[bytes]:
        """Ids of single words: encoded as one text, cut after each id that ends a word."""
        ids = np.frombuffer(self._encoded([" ".join(lot)])[0], "<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(lot):
            return self._encoded(lot)
        data, at = ids.tobytes(), [0, *(4 * cut).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _split(self, text: str) -> list[str] | None:
        low = text.lower()
        return _WORD.findall(low) if _PLAIN.fullmatch(text) and not any(a in low for a in self.added) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        missing = list({w for s in split if s for w in s if w not in self.known})
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
            missing = list({w for s in split if s for w in s})
        for a in range(0, len(missing), 1000):
            part = missing[a:a + 1000]
            self.known.update(zip(part, self._words(part)))
        whole = iter(self._encoded([t for t, s in zip(texts, split) if s is None]))
        get = self.known.__getitem__
        return [next(whole) if s is None else b"".join(map(get, s)) for s in split]


def words(path: str) -> Words:
    if path not in _STATE:
        _STATE[path] = (Words(path),)
    return _STATE[path][0]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece of every document.

    A document longer than ``length`` tokens is cut into full pieces and a rest; each id lies in exactly one piece.
    Null text counts as empty and gives one piece with the end id; repeated rows are packed each.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    rows = keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = words(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                row, start, size, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(coder.encode(part["text"].to_pylist())):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, length):
                        cut = data[4 * s:4 * (s + length)]
                        row.append(i)
                        start.append(s)
                        size.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(n)
                        if with_ids:
                            ids.append(cut)
                take = pa.array(row, pa.int64())
                cols = [part["doc_id"].take(take), part["key"].take(take),
                        *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names)

    return rows.mapInArrow(run, f"doc_id {kind}, key long, start long, length long, ids_crc32 long, doc_tokens long"
                           + ", ids binary" * with_ids)


def _knapsack(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Dearest multiset of sizes that fits into ``room``, by dynamic programming over capacities."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(sizes.min()), room + 1):
        m = int(np.searchsorted(sizes, c, "right"))
        total = best[c - sizes[:m]] + value[:m]
        k = int(np.argmax(total))
        if total[k] > best[c - 1]:
            best[c], pick[c] = total[k], k
        else:
            best[c], pick[c] = best[c - 1], -2
    pattern = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), pattern


def cutting_patterns(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns over ``sizes`` (rising) that together hold exactly ``counts`` pieces.

    The linear program over all patterns is solved by the revised simplex method; a knapsack prices new columns.
    Its optimum is rounded down, and what is left (fewer sequences than there are sizes) is filled largest first.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ counts
    for _ in range(PIVOTS):
        dual = inverse.sum(axis=0)
        gain, pattern = _knapsack(sizes, np.maximum(dual, 0), room)
        if gain <= 1 + 1e-7:
            break
        move = inverse @ pattern
        up = move > 1e-9
        ratio = np.where(up, amount / np.where(up, move, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        amount = inverse @ counts
    times = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    left = counts.astype(np.int64).copy()
    out_patterns = []
    for k in np.argsort(-times, kind="stable"):
        a = np.rint(basis[:, k]).astype(np.int64)
        n = int(min(times[k], (left[a > 0] // a[a > 0]).min())) if a.any() else 0
        if n:
            out_patterns.append((a, n))
            left -= a * n
    while left.any():
        a, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            n = min(int(left[i]), free // int(sizes[i]))
            if n:
                a[i] = n
                free -= n * int(sizes[i])
        n = int((left[a > 0] // a[a > 0]).min())
        out_patterns.append((a, n))
        left -= a * n
    return out_patterns


def pack(cut: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``: every piece placed, sequences gapless and at most ``length`` long.

    ``cut`` needs doc_id, key, start, length and should be staged, as it is read twice. Only the histogram (at most
    length / step rows) reaches the driver. Pieces of one length step are ranked inside hash parts, so a step that
    holds any share of the rows is spread; patterns then take ranges of ranks. An empty table gives no rows.
    """
    spark = cut.sparkSession
    binned = cut.withColumn("bin", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes], np.int64)
    ranges: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    used, sequence = dict.fromkeys(ranges, 0), 0
    for pattern, times in cutting_patterns(sizes, counts, length // step):
        for s, a in zip(sizes.tolist(), pattern.tolist()):
            if a:
                ranges[s].append((used[s], used[s] + a * times, a, sequence))
                used[s] += a * times
        sequence += times
    parts = int(max(32, counts.sum() // 20_000)) if len(counts) else 1
    dealt = spark.createDataFrame([(b, r) for b, r in ranges.items()],
                                  "bin int, ranges array<struct<first:long,end:long,each:long,sequence:long>>")
    binned = binned.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("bin", "part").agg(F.count("*").alias("n")) \
        .select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("bin", "part").orderBy("doc_id", "key", "start", "length")
    ranked = binned.withColumn("rank", F.row_number().over(order) - 1) \
        .join(starts, ["bin", "part"]).join(F.broadcast(dealt), "bin") \
        .withColumn("rank", F.col("rank") + F.col("base"))
    own = F.get(F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["end"])), F.lit(0))
    placed = ranked.withColumn("own", own).withColumn(
        "sequence_id", F.col("own.sequence") + F.floor((F.col("rank") - F.col("own.first")) / F.col("own.each")))
    inside = Window.partitionBy("sequence_id").orderBy("bin", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))) \
        .select(*cut.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


def packed(docs: DataFrame, path: str, length: int = LENGTH, step: int = STEP, with_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their place; see ``pieces`` and ``pack``."""
    return pack(staged(pieces(docs, path, length, with_ids=with_ids, doc_id=doc_id, text=text), "pieces"), length, step)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: token ids of each sequence (needs pieces with ids; at most length / step of them each)."""
    from pyspark.sql import types as T

    joined = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int32) for p in batch["p"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(ids, pa.list_(pa.int32()))],
                                             ["sequence_id", "ids"])

    return joined.mapInArrow(run, T.StructType().add("sequence_id", "long").add("ids", T.ArrayType(T.IntegerType())))

"""Encoding and decoding with merge-type SentencePiece vocabularies: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm.shared import SLICE, buffers, keyed, row_slices

SPACE = "▁"
#: Segments a task keeps the ids of; the longest that agendas take in lockstep; how many advance together; characters of
#: a long text encoded at once.
KEPT, SHORT, LOT, PIECE = 500_000, 32, 8_000, 1 << 20
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Vocabulary:
    """A merge-type vocabulary with byte fallback, taken from a serialized model.

    Normalisation (escaped spaces, dummy prefix) and decoding are the library's. Models without byte fallback or with
    pieces that are marked unused are refused with ValueError.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor  # only tasks need it

        self.library = lib = SentencePieceProcessor(model_proto=model)
        self.size = lib.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        byte: dict[int, int] = {}
        for i in range(self.size):
            piece = lib.id_to_piece(i)
            if lib.is_unused(i):
                raise ValueError(f"piece {i} is marked unused")
            if lib.is_byte(i):
                byte[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.score[piece], self.id[piece] = lib.get_score(i), i
        if len(byte) < 256:
            raise ValueError("the model has no byte fallback")
        self.byte = [byte[b] for b in range(256)]
        #: Adjacent characters some piece holds; no merge ever crosses any other pair.
        self.touching = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.words_apart = not any(a != SPACE == b for a, b in self.touching)
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        """Symbols (pieces, then characters that are none, then one for no symbol) and the table of the pairs that form a
        piece, each with the rank of its score; its last row stands for all other pairs. ``slot`` has a pair's row at its
        hash or, where that is taken, behind it.

        ``id_of`` has a symbol's id: the byte's of an ASCII character, -1 for others that take several bytes."""
        symbol = dict(self.id)
        more = sorted({c for p in self.score for c in p}.union(map(chr, range(128))) - set(symbol))
        symbol.update({c: self.size + i for i, c in enumerate(more)})
        self.nothing = self.size + len(more)
        self.id_of = np.array([*range(self.size), *(self.byte[ord(c)] if ord(c) < 128 else -1 for c in more), -1], np.int32)
        self.of_char = np.full(0x110000, self.nothing, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        found = [(symbol[p[:i]] * (self.nothing + 1) + symbol[p[i:]], self.id[p], s) for p, s in self.score.items()
                 for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        self.pair = np.array([f[0] for f in found] + [np.iinfo(np.int64).max], np.int64)
        self.pair_id = np.array([f[1] for f in found] + [-1], np.int32)
        rank = np.unique([f[2] for f in found], return_inverse=True)[1]
        self.pair_rank = np.append(rank, -1).astype(np.int32)
        bits = len(self.pair).bit_length() + 3
        self.shift, self.slot = np.uint64(64 - bits), np.full(1 << bits, len(found), np.int32)
        todo, at = np.arange(len(found)), self._hash(self.pair[:-1])
        while len(todo):
            free = self.slot[at] == len(found)
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) % len(self.slot)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _ODD) >> self.shift).view(np.int64)

    def _forget(self) -> None:
        self.kept: dict[str | tuple[str], int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(KEPT + 1, np.int64)

    def merged(self, text: str) -> list[str]:
        """The pieces of a text: of all adjacent pairs that form a piece, the one with the highest score merges first,
        the leftmost of several; the pairs that a merge makes join the agenda, those it breaks are stale."""
        piece = list(text)
        last = len(piece) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda: list[tuple[float, int, int, int]] = []
        score = self.score

        def offer(a: int, b: int) -> None:
            joined = piece[a] + piece[b]
            s = score.get(joined)
            if s is not None:
                heappush(agenda, (-s, a, b, len(joined)))

        for a in range(last):
            offer(a, a + 1)
        while agenda:
            _, a, b, size = heappop(agenda)
            if not piece[a] or not piece[b] or len(piece[a]) + len(piece[b]) != size:
                continue
            piece[a] += piece[b]
            piece[b] = ""
            after[a] = after[b]
            if after[b] <= last:
                before[after[b]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in piece if p]

    def _one(self, text: str) -> list[int]:
        """Ids of one segment of any length, cut where no piece holds both neighbours."""
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.touching]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            for p in self.merged(text[a:b]):
                i = self.id.get(p)
                out += [i] if i is not None else [self.byte[x] for x in p.encode()]
        return out

    def _offers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank -1 where they form none."""
        key = a * np.int64(self.nothing + 1) + b
        none = len(self.pair) - 1
        place = self._hash(key)
        at = self.slot[place]
        open_ = np.flatnonzero((self.pair[at] != key) & (at != none))
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.slot)
            there = at[open_] = self.slot[place[open_]]
            open_ = open_[(self.pair[there] != key[open_]) & (there != none)]
        return self.pair_rank[at], self.pair_id[at]

    def together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per segment) of segments of at most SHORT characters, whose agendas advance in lockstep:
        in each step, every segment merges its pair of highest score.

        A segment is a column, framed by cells without a symbol. ``offer`` has, at a pair's left cell, its score's rank
        and then how far left it is, so that a column's maximum is its next merge."""
        m, chars = len(segments), np.array([len(s) for s in segments])
        deep = int(chars.max(initial=0)) + 2
        column = np.repeat(np.arange(m), chars)
        cell = (np.arange(len(column)) - np.repeat(np.cumsum(chars) - chars, chars)) * m + column
        symbol = np.full(deep * m, self.nothing, np.int32)
        symbol[cell] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        odd = np.zeros(m, bool)  # holds a character that no piece holds
        odd[column[symbol[cell] == self.nothing]] = True
        alive = np.zeros(deep * m, bool)
        alive[cell] = True
        after = np.arange(deep * m) + m
        before = after - 2 * m  # above the first row: cells of the last one, which have no symbol
        offer, made = np.full(deep * m, -1, np.int32), np.full(deep * m, -1, np.int32)

        def offers(at: np.ndarray, then: np.ndarray) -> None:
            rank, made[at] = self._offers(symbol[at], symbol[then])
            offer[at] = np.where(rank >= 0, rank * deep + (deep - 1 - at // m), -1)

        first = cell[alive[cell + m]]
        offers(first, first + m)
        while True:
            best = offer.reshape(deep, m).max(axis=0)
            columns = np.flatnonzero(best >= 0)
            if not len(columns):
                break
            a = (deep - 1 - best[columns] % deep) * m + columns
            b = after[a]
            then = after[b]
            symbol[a] = made[a]
            alive[b] = False
            offer[b] = -1
            after[a] = then
            before[then] = a
            left = before[a]
            offers(np.concatenate([a, left[left >= 0]]), np.concatenate([then, a[left >= 0]]))
        symbol = self.id_of[symbol].reshape(deep, m).T
        alive = alive.reshape(deep, m).T
        odd |= (alive & (symbol < 0)).any(axis=1)
        alive[odd] = False
        ids, n = symbol[alive], alive.sum(axis=1)
        if odd.any():
            own = [np.array(self._one(segments[i]), np.int32) for i in np.flatnonzero(odd).tolist()]
            at = np.cumsum(n)[odd]
            ids = np.insert(ids, np.repeat(at, [len(x) for x in own]), np.concatenate(own))
            n[odd] = [len(x) for x in own]
        return ids, n

    def _learn(self, fresh: list[str | tuple[str]]) -> None:
        """Keep the ids of segments (told by their text behind one space, or as a tuple where there is none)."""
        texts = [SPACE + k if isinstance(k, str) else k[0] for k in fresh]
        size = np.array([len(t) for t in texts])
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], SHORT, "right"))
        for a in range(0, short, LOT):
            lot = order[a:min(a + LOT, short)].tolist()
            self._keep([fresh[i] for i in lot], *self.together([texts[i] for i in lot]))
        for i in order[short:].tolist():
            ids = np.array(self._one(texts[i]), np.int32)
            self._keep([fresh[i]], ids, np.array([len(ids)]))

    def _keep(self, names: list, ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.kept)
        first = self.ends[k]
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(n) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[first:first + len(ids)] = ids
        self.ends[k + 1:k + 1 + len(n)] = first + np.cumsum(n)
        self.kept.update(zip(names, range(k, k + len(n))))

    def _segments(self, text: str) -> list[str | tuple[str]]:
        """A normalised text cut before each run of spaces, where no piece reaches across."""
        if not self.words_apart:
            return [(text,)] if text else []
        return [x[1:] if x[0] == SPACE else (x,) for x in _SEGMENT.findall(text)]

    def _cut(self, texts: list[str]) -> tuple[list[str | tuple[str]], np.ndarray, np.ndarray]:
        """(distinct segments, the number of each segment's one, how many segments each text has).

        Texts of words behind single spaces are cut and told apart by Arrow."""
        plain = [self.words_apart and t.startswith(SPACE) and SPACE * 2 not in t for t in texts]
        lists = pc.split_pattern(pa.array([t[1:] for t, p in zip(texts, plain) if p], pa.large_string()), SPACE)
        coded = lists.flatten().dictionary_encode()
        names, n = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.zeros(len(texts), np.int64)
        plain = np.array(plain, bool)
        n[plain] = pc.list_value_length(lists).to_numpy()
        code = coded.indices.to_numpy()
        if not plain.all():
            cut = [self._segments(texts[i]) for i in np.flatnonzero(~plain).tolist()]
            n[~plain] = [len(x) for x in cut]
            number: dict[str | tuple[str], int] = {}
            odd = [number.setdefault(x, len(names) + len(number)) for x in chain.from_iterable(cut)]
            names += number
            own, every = np.repeat(plain, n), np.zeros(n.sum(), np.int64)
            every[own], every[~own] = code, odd
            code = every
        return names, code, n

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each normalised text."""
        names, code, n = self._cut(texts)
        there = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(there < 0).tolist()
        fresh = list(dict.fromkeys(names[i] for i in missing))
        if len(self.kept) + len(fresh) > KEPT:
            self._forget()
            missing, fresh = range(len(names)), list(dict.fromkeys(names))
        if fresh:
            self._learn(fresh)
            there[missing] = [self.kept[names[i]] for i in missing]
        begin = self.ends[there]
        long = self.ends[there + 1] - begin
        begin, long = begin[code], long[code]
        total = np.concatenate([[0], np.cumsum(long)])
        ids = self.ids[np.repeat(begin - total[:-1], long) + np.arange(total[-1])]
        ends = total[np.cumsum([0, *n])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def pieces(self, text: str) -> list[str]:
        """A normalised text, a long one cut before spaces."""
        out, at = [], 0
        while self.words_apart and len(text) - at > PIECE:
            found = _BREAK.search(text, at + PIECE)
            if not found:
                break
            out.append(text[at:found.start()])
            at = found.start()
        return [*out, text[at:]]

    def encode(self, text: str) -> list[np.ndarray]:
        """Ids of one normalised text, piece by piece."""
        return [self.encode_all([p])[0] for p in self.pieces(text)]

    def decode(self, pieces: list[np.ndarray]) -> str:
        """The library's text for the ids. Pieces of a long text are decoded on their own, behind a space piece that
        takes the place of the text's first one, which the library strips."""
        if len(pieces) > 1 and SPACE in self.id:
            lead = [self.id[SPACE]]
            return "".join(self.library.decode((lead if i else []) + p.tolist()) for i, p in enumerate(pieces))
        return self.library.decode(np.concatenate([np.zeros(0, np.int32), *pieces]).tolist())


_LOADED: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for each model in a worker."""
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def encoded(docs: DataFrame, model: str, check: bool = True, decode: bool = False, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: ids without begin or end, as the library gives them, from the merge agenda.

    With ``check`` a column ``agrees`` tells whether the library's own ids are the same; with ``decode`` a column
    ``decoded`` holds the library's text for the ids. The model file is read by the driver and broadcast. Texts are
    taken whole; null and empty texts have no ids and decode to an empty text; U+2581 in a text is a space to the
    library, so it decodes as one. Repeated rows are answered each; an empty table gives no rows; other columns are
    ignored. Memory follows one text, as Arrow hands rows over whole.
    """
    rows = keyed(docs, doc_id, text).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(_read(model))
    names = ["doc_id", "ids", *(["agrees"] if check else []), *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(held.value)
        for batch in batches:
            for a, b in row_slices(buffers(batch["text"])[1], SLICE):
                texts = batch["text"].slice(a, b - a).to_pylist()
                normal = [words.library.normalize(t) for t in texts]
                pieces = [words.encode(t) for t in normal] if b - a == 1 else [[x] for x in words.encode_all(normal)]
                ids = [p[0] if len(p) == 1 else np.concatenate(p) for p in pieces]
                columns = [batch["doc_id"].slice(a, b - a), _lists(ids)]
                if check:
                    own = words.library.encode(texts, out_type=int, num_threads=1)
                    columns.append(pa.array([x.tolist() == y for x, y in zip(ids, own)], pa.bool_()))
                if decode:
                    columns.append(pa.array([words.decode(p) for p in pieces], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", agrees boolean" * check + ", decoded string" * decode)


def decoded(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the library's text for each row's ids. Null ids are taken as none; ids outside the vocabulary
    raise IndexError in the task."""
    rows = rows.select(rows[doc_id].alias("doc_id"), F.coalesce(rows[ids], F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words.library.decode(batch["ids"].to_pylist()), pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of rows encoded with ``decode``."""
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *(c for c in ("agrees",) if c in found.columns))

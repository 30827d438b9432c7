"""Documents linked by word n-gram Jaccard similarity: PartEnum signatures, exact verification in tiles, components."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodgemetrics.llm import sketch
from lodgemetrics.llm.anchors import long_text_words
from lodgemetrics.llm.components import components
from lodgemetrics.llm.shared import (
    LOWER, SLICE, SpanHash, buffers, byte_symbols, drop_staged, give_back_memory, keyed, measured, mix, row_slices, staged,
    word_bounds)

#: Classes, and shingles, of one side of a verification tile; classes that share a signature up to which their pairs are
#: listed; one part more than differences need for so many differences.
TILE, TILE_SHINGLES, LISTED, EXTRA = 256, 1 << 19, 4, 8
#: Bytes of text whose sets are made at once; longer texts alone.
PIECE = SLICE // 4
#: Rounds in which one class of every signature's group is compared with the others, at most.
ROUNDS = 8


class Rule(NamedTuple):
    """Sets of n-word shingles are linked when 100 * intersection >= percent * union."""

    n: int = 4
    percent: int = 85


class Sets(NamedTuple):
    """Distinct shingle hashes of several texts: those of text i are values[first[i]:first[i + 1]], rising."""

    values: np.ndarray
    first: np.ndarray


def _shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every n-word shingle; a text of fewer words has one, its whole sequence."""
    count = np.diff(first)
    hashed = SpanHash(words)
    short = np.flatnonzero((count > 0) & (count < n))
    at = np.arange(max(0, len(words) - n + 1))
    at = at[at + n <= np.repeat(first[1:], count)[:len(at)]]
    row = np.searchsorted(first, at, "right") - 1
    return (np.concatenate([row, short]),
            np.concatenate([hashed.spans(at, at + n), hashed.spans(first[short], first[short + 1])]))


def set_slices(column: pa.Array, n: int) -> Iterator[tuple[int, int, Sets]]:
    """(first row, end row, shingle sets) of whole texts, A-Z lower-cased, words [^\\x20\\x09-\\x0D]+; in slices of
    bounded size, so that memory does not follow the number of rows in a batch."""
    raw, offsets = buffers(column)
    for a, b in row_slices(offsets, PIECE):
        part, off = LOWER[raw[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]
        if len(part) > SLICE:  # one long text
            words = long_text_words(part)
            own = np.unique(np.concatenate([
                _shingles(words[c:c + SLICE + n - 1], np.array([0, len(words[c:c + SLICE + n - 1])]), n)[1]
                for c in range(0, max(1, len(words) - n + 1), SLICE)]))
            yield a, b, Sets(own, np.array([0, len(own)]))
            continue
        start, end, first = word_bounds(part, off)
        row, h = _shingles(SpanHash(byte_symbols(part)).spans(start, end), first, n)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(row) != 0) | (h[1:] != h[:-1])
        yield a, b, Sets(h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=b - a))]).astype(np.int64))


def set_hash(sets: Sets) -> np.ndarray:
    """One 64-bit value for each set, independent of order; 0 for an empty set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets.values ^ np.uint64(0xA0761D6478BD642F)))])
    size = np.diff(sets.first).astype(np.uint64)
    return np.where(size > 0, mix(sums[sets.first[1:]] - sums[sets.first[:-1]] + size) | np.uint64(1), np.uint64(0))


def _bands(largest: int, percent: int) -> np.ndarray:
    """Least size of each band: sizes that can be linked lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges + [edges[-1] * 100 // percent + 1, edges[-1] * 200])


class Signed(NamedTuple):
    """Signatures of several sets: row, signature, the scheme it is from, and how many signatures of that scheme the row
    may do without: so many more than one does it share with any set it can be linked to through the scheme."""

    row: np.ndarray
    sig: np.ndarray
    scheme: np.ndarray
    spare: np.ndarray


def signatures(sets: Sets, rule: Rule = Rule()) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): two linkable sets share at least one signature."""
    return signed(sets, rule)[:2]


def signed(sets: Sets, rule: Rule = Rule()) -> Signed:
    """Signatures of which two linkable sets share at least one.

    A set takes the scheme of its own size band and of the next. Within a scheme two linkable sets differ in at most
    k shingles. Their domain is parted k // 2 + 1 times or more, so in some part they differ at most once; each part is
    parted in three, and every two of the three are a signature, so one pair agrees. Signatures of no shingle would
    be shared by strangers: a set with enough parts that have two filled thirds leaves them out, as enough of its
    other parts must agree; a set without takes its least shingles instead, of which linkable sets share one. A set
    of which more parts are so filled than may differ twice shares more than one signature with any linkable set.
    """
    size = np.diff(sets.first)
    edges = _bands(int(size.max(initial=1)), rule.percent)
    band = np.searchsorted(edges, size, "right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    schemes, spares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    poor = np.zeros(len(size), bool)
    for scheme in (band, band + 1):
        most = 2 * (edges[scheme + 1] - 1)
        k = most * (100 - rule.percent) // (100 + rule.percent)
        parts = np.where(k == 0, 1, k // 2 + 1 + np.maximum(1, k // EXTRA))
        cell0 = np.concatenate([[0], np.cumsum(3 * parts)])
        spread = mix(sets.values ^ mix(scheme.astype(np.uint64) + np.uint64(77))[owner])
        part = ((spread >> np.uint64(32)) % parts[owner].astype(np.uint64)).astype(np.int64)
        cell = cell0[owner] + 3 * part + ((spread & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
        filled = np.bincount(cell, minlength=cell0[-1]).reshape(-1, 3)
        value = mix(spread)
        low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), cell0[-1]).astype(np.uint64)
        high = np.bincount(cell, (value >> np.uint64(32)).astype(float), cell0[-1]).astype(np.uint64)
        total = (low + (high << np.uint64(32))).reshape(-1, 3)
        part_row = np.repeat(np.arange(len(size)), parts)
        two = (filled > 0).sum(axis=1) >= 2
        filled_parts = np.bincount(part_row, two, len(size)).astype(np.int64)
        rich = filled_parts >= k // 2 + 1
        spare = np.maximum(filled_parts - k // 2 - 1, 0)
        one = k == 0
        poor |= ~rich & ~one & (size > 0)
        part_no = np.arange(len(part_row)) - (cell0[:-1] // 3)[part_row]
        name = mix(scheme.astype(np.uint64) * np.uint64(1_000_003))[part_row] + part_no.astype(np.uint64) * np.uint64(8)
        for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            use = (filled[:, i] + filled[:, j] > 0) & ~one[part_row]
            rows.append(part_row[use])
            schemes.append(scheme[part_row[use]])
            spares.append(spare[part_row[use]])
            out.append(mix(name[use] + np.uint64(pair) + mix(total[use, i]) + mix(total[use, j] ^ np.uint64(0xE7037ED1A0B428DB))))
        same = np.flatnonzero(one & (size > 0))  # no difference allowed: the whole set
        rows.append(same)
        schemes.append(scheme[same])
        spares.append(np.zeros(len(same), np.int64))
        out.append(mix(set_hash(sets)[same] + np.uint64(5)))
    for r in np.flatnonzero(poor):
        least = size[r] - (size[r] * rule.percent + 99) // 100 + 1
        rows.append(np.full(least, r))
        schemes.append(np.full(least, -1))
        spares.append(np.zeros(least, np.int64))
        out.append(mix(sets.values[sets.first[r]:sets.first[r] + least] ^ np.uint64(0x8EBC6AF09C88C6E3)))
    return Signed(*(np.concatenate(x) for x in (rows, out, schemes, spares)))


def _tile_links(a: list[np.ndarray], b: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs between two lists of sets, intersections counted by a matrix product in pieces."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = np.zeros((len(a), len(b)))
    va, vb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(va, vb)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    pa_, pb = np.searchsorted(shared, va), np.searchsorted(shared, vb)
    if len(shared):
        ha = shared[np.minimum(pa_, len(shared) - 1)] == va
        hb = shared[np.minimum(pb, len(shared) - 1)] == vb
        ra, pa_, rb, pb = ra[ha], pa_[ha], rb[hb], pb[hb]
        oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
        ra, pa_, rb, pb = ra[oa], pa_[oa], rb[ob], pb[ob]
        for c in range(0, len(shared), 4096):
            x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
            i, j = np.searchsorted(pa_, [c, c + 4096])
            x[ra[i:j], pa_[i:j] - c] = 1
            i, j = np.searchsorted(pb, [c, c + 4096])
            y[rb[i:j], pb[i:j] - c] = 1
            both += x @ y.T
    return np.nonzero(100 * both >= rule.percent * (na[:, None] + nb[None, :] - both))


def links(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", thin: bool = False
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, weights): ``doc_id, n_shingles, class_id`` of every row; ``a, b`` of each link between classes,
    once, a < b; and ``class_id, weight``, the rows with an id in a class.

    A class is a distinct shingle set (class_id 0: empty set or null id, linked with nothing). ``thin`` leaves out links
    that components do not need: in rounds, some class of every signature's group is compared with the others, until few
    new links come of it; then only classes that are still apart are compared each with each, so no link between them
    is missed. All links of a group of near copies are as many as its size squared.
    """
    rows = keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch.width_for(size // 12, 4)
    fragment = ", " + sketch.SCHEMA
    rows_type = to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["doc_id", "key", "n", "class_id", "line", "shard", "lot", "once", "more"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots, known = sketch.Lots(width), np.zeros(0, np.uint64)

        def fragments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                blank = [pa.nulls(part.num_rows, t) for t in (rows_type, pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(blank + part.columns, names)

        for batch in batches:
            for a, b, sets in set_slices(batch["text"], rule.n):
                ids = set_hash(sets)
                empty = [pa.nulls(b - a, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(np.diff(sets.first)),
                     pa.array(ids.view(np.int64)), *empty], names)
                row, sig = signatures(sets, rule)
                fresh = _first_of(ids, known)
                known = np.union1d(known, ids)
                yield from fragments(lots.add(_once_per_row(row, sig, fresh)))
        yield from fragments(lots.rest())
        give_back_memory()

    one = staged(rows.mapInArrow(first_pass, f"doc_id {kind}, key long, n long, class_id long{fragment}"), "sets")
    members = staged(one.filter(F.col("line").isNull()).select("doc_id", "key", F.col("n").alias("n_shingles"), "class_id"),
                     "members")
    # copies within one task were sketched once, copies in different tasks are distinct hits: still never too low
    repeated = sketch.merged(one.filter(F.col("line").isNotNull()).select("line", "shard", "lot", "once", "more"),
                             width, rows.rdd.getNumPartitions())
    drop_staged(one)
    test = rows.sparkSession.sparkContext.broadcast(repeated)
    del repeated  # up to 64 MB of the driver's memory
    give_back_memory()

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for _, _, sets in (s for batch in batches for s in set_slices(batch["text"], rule.n)):
            ids = set_hash(sets)
            found = signed(sets, rule)
            fresh = _first_of(ids, known)
            known = np.union1d(known, ids)
            use = fresh[found.row]
            use[use] = test.value(found.sig[use])
            found = Signed(*(x[use] for x in found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.sig.view(np.int64)), pa.array(ids[found.row].view(np.int64)),
                 pa.array(np.diff(sets.first)[found.row].astype(np.int32)), pa.array(found.scheme.astype(np.int16)),
                 pa.array(np.minimum(found.spare, 30_000).astype(np.int16))], ["sig", "class_id", "n", "scheme", "spare"])
        give_back_memory()

    shared = rows.mapInArrow(second_pass, "sig long, class_id long, n int, scheme short, spare short")
    met = staged(_kept(_groups(shared)), "met")
    test.destroy()
    sets = staged(_sets(rows, members, met, rule), "class-sets")
    rest = met.select("sig", "class_id", "n", F.col("class_id").alias("side"))
    found, before = None, met
    for r in range(ROUNDS):
        dealt = staged(_stars(rest, r, rule), "dealt")
        drop_staged(before)
        before = dealt
        stars, tried = measured(dealt.filter("b IS NOT NULL").select("a", "b").distinct(), "star-pairs", n=F.count("*"))
        fresh, linked = measured(_paired(sets, stars, rule), "links", n=F.count("*"))
        drop_staged(stars)
        found = fresh if found is None else found.unionByName(fresh)
        rest = dealt.filter("b IS NULL").select("sig", F.col("a").alias("class_id"), "n", "side")
        if not thin:
            break
        if linked["n"]:  # else all sides are as before
            known = components(found)
            rest = rest.join(known, rest["class_id"] == known["node"], "left").select(
                "sig", "class_id", "n", F.coalesce("component", "class_id").alias("side"))
        if linked["n"] * 8 < tried["n"] or not tried["n"]:
            break
    listed, grouped = F.col("b").isNotNull(), F.col("b").isNull() & F.col("group").isNotNull()
    open_, left = measured(_open_pairs(rest, rule), "open", pairs=F.count_if(listed), many=F.count_if(grouped))
    drop_staged(before)
    more = []
    if left["pairs"]:
        more.append(_paired(sets, open_.filter(listed).select("a", "b").distinct(), rule))
    if left["many"]:
        clusters = components(open_.filter(grouped).select("a", F.col("group").alias("b")))
        sides = open_.filter(grouped).select(F.col("a").alias("c"), "side").distinct()
        large = clusters.join(sides, clusters["node"] == sides["c"]).select("node", "component", "side")
        more.append(_tiled(sets, large, rule, thin))
    for links_ in more:
        found = found.unionByName(staged(links_, "verified"))
    drop_staged(open_)
    drop_staged(sets)
    weights = members.filter(F.col("doc_id").isNotNull()).groupBy("class_id").agg(F.count("*").alias("weight"))
    return members, found if thin else staged(found.distinct(), "all-links"), weights


def _groups(shared: DataFrame) -> DataFrame:
    """The rows (sig, class_id, n, scheme, spare) whose signature several classes share, with the number ``m`` of them.

    One exchange by signature, read in order; copies that several tasks sent are counted once.
    """
    names = ["sig", "class_id", "n", "scheme", "spare"]

    def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
        sig, class_id = columns[:2]
        new = np.ones(len(sig), bool)
        new[1:] = (np.diff(sig) != 0) | (np.diff(class_id) != 0)
        columns = [x[new] for x in columns]
        size = _sizes(columns[0])
        of = np.repeat(size, size)
        return pa.RecordBatch.from_arrays([pa.array(x[of > 1]) for x in (*columns, of)], [*names, "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, names):
            yield solve(columns)

    return shared.repartition("sig").sortWithinPartitions("sig", "class_id").mapInArrow(
        run, "sig long, class_id long, n int, scheme short, spare short, m long")


def _sizes(key: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    return np.diff(np.append(starts, len(key)))


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, such that no group of the first column is cut; a group's rows are held together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[c].to_numpy() for c in names]
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the batch's last group may go on
        if held and (last > 0 or held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:last] for x in columns])]
            held = []
        elif last > 0:
            yield [x[:last] for x in columns]
        held.append([x[last:] for x in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _kept(groups: DataFrame) -> DataFrame:
    """``sig, class_id, n``: the groups, less the ``spare`` most frequent signatures that a class has in a scheme.

    Linkable sets share more signatures than either may spare, and the rarest of the shared ones is among the spare ones
    of neither. So a passage that many documents hold does not make a group of them by the few signatures that
    consist of it alone. Signatures of one class alone are gone before, and the rarest.
    """
    rank = F.row_number().over(Window.partitionBy("class_id", "scheme").orderBy(F.desc("m"), F.desc("sig")))
    return groups.withColumn("r", rank).filter(F.col("r") > F.col("spare")).select("sig", "class_id", "n")


def _mixed(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows (sig, class_id, n, side) of groups with several sides, and the first row of each such group."""
    sig, _, _, side = columns
    size = _sizes(sig)
    first = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    mixed = (np.bincount(group, side != side[first][group], len(size)) > 0)[group] if len(sig) else np.zeros(0, bool)
    columns = [x[mixed] for x in columns]
    size = _sizes(columns[0])
    return columns, np.cumsum(size) - size


def _stars(rest: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """Of the groups (sig, class_id, n, side) with several sides: ``a, b`` of one class, another one each turn, with those
    of other sides and linkable size, and the groups' rows ``a, sig, n, side`` (b null)."""
    percent = rule.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, ["sig", "class_id", "n", "side"]):
            (sig, class_id, n, side), first = _mixed(columns)
            if not len(sig):
                continue
            size = _sizes(sig)
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((mix(class_id.view(np.uint64) + np.uint64(turn)), group))
            head = order[first][group]
            fits = (side != side[head]) & (100 * np.minimum(n, n[head]).astype(np.int64) >= percent * np.maximum(n, n[head]))
            a, b = np.minimum(class_id, class_id[head])[fits], np.maximum(class_id, class_id[head])[fits]
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            gone, none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(sig), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), gone, gone.cast(pa.int32()), gone],
                                             ["a", "b", "sig", "n", "side"])
            yield pa.RecordBatch.from_arrays([pa.array(class_id), none, pa.array(sig), pa.array(n), pa.array(side)],
                                             ["a", "b", "sig", "n", "side"])

    return rest.repartition("sig").sortWithinPartitions("sig", "class_id").mapInArrow(
        run, "a long, b long, sig long, n int, side long")


def _open_pairs(met: DataFrame, rule: Rule) -> DataFrame:
    """Of each group (sig, class_id, n, side) what is still to compare: ``a, b`` of the classes of linkable size on
    different sides, or, of a group of more than LISTED classes, ``a, group, side`` (b null), where group is the least of
    its classes.
    """
    percent, listed = rule.percent, LISTED

    def solve(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, class_id, n, side = columns
        columns, _ = _mixed(columns)
        sig, class_id, n, side = columns
        size = _sizes(sig)
        of, group = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = np.flatnonzero(of <= listed)
        for gap in range(1, min(listed, int(of[few].max(initial=1)))):  # partners so many places behind in the same group
            i = few[few + gap < len(sig)]
            i = i[group[i] == group[i + gap]]
            j = i + gap
            fits = (side[i] != side[j]) & (100 * np.minimum(n[i], n[j]).astype(np.int64) >= percent * np.maximum(n[i], n[j]))
            left.append(class_id[i[fits]])
            right.append(class_id[j[fits]])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        many = np.flatnonzero(of > listed)
        least = class_id[np.flatnonzero(np.append(True, np.diff(sig) != 0))] if len(sig) else class_id
        stars = np.unique(np.stack([class_id[many], least[group[many]], side[many]], axis=1), axis=0)
        blank = [None] * len(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(pairs[:, 0], stars[:, 0])), pa.array([*pairs[:, 1].tolist(), *[None] * len(stars)], pa.int64()),
             pa.array([*blank, *stars[:, 1].tolist()], pa.int64()), pa.array([*blank, *stars[:, 2].tolist()], pa.int64())],
            ["a", "b", "group", "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, ["sig", "class_id", "n", "side"]):
            yield from solve(columns)

    return met.repartition("sig").sortWithinPartitions("sig", "class_id").mapInArrow(run, "a long, b long, group long, side long")


def _first_of(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows whose set this task has not met before."""
    fresh = np.zeros(len(ids), bool)
    fresh[np.unique(ids, return_index=True)[1]] = True
    return fresh & ~np.isin(ids, known) & (ids != 0)


def _once_per_row(row: np.ndarray, sig: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Signatures of the fresh rows, each once per row (a band's own and next scheme may name the whole set twice)."""
    use = fresh[row]
    row, sig = row[use], sig[use]
    order = np.lexsort((sig, row))
    row, sig = row[order], sig[order]
    new = np.ones(len(sig), bool)
    new[1:] = (np.diff(row) != 0) | (sig[1:] != sig[:-1])
    return sig[new]


def _sets(rows: DataFrame, members: DataFrame, met: DataFrame, rule: Rule) -> DataFrame:
    """``class_id, n, data`` of the classes in ``met``: their shingles, rising. The text of one member stands for a class."""
    wanted = met.select(F.col("class_id").alias("node")).distinct()
    heads = members.groupBy("class_id").agg(F.min("key").alias("member"), F.first("n_shingles").alias("n"))
    head = heads.join(wanted, heads["class_id"] == wanted["node"], "left_semi")
    texts = head.join(rows.select(F.col("key").alias("member"), "text"), "member").dropDuplicates(["class_id"])

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [found.values[i:j].tobytes() for _, _, found in set_slices(batch["text"], rule.n)
                    for i, j in zip(found.first[:-1], found.first[1:])]
            yield pa.RecordBatch.from_arrays([batch["class_id"], batch["n"], pa.array(data, pa.binary())],
                                             ["class_id", "n", "data"])

    return texts.select("class_id", "n", "text").mapInArrow(to_set, "class_id long, n long, data binary")


def _paired(sets: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links, compared one by one; pairs of other sizes go before sets are sent."""
    sized = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("n").alias("na")), "a") \
        .join(sets.select(F.col("class_id").alias("b"), F.col("n").alias("nb")), "b") \
        .filter(100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb")).select("a", "b")
    one = sized.join(sets.select(F.col("class_id").alias("a"), F.col("data").alias("da")), "a")
    both = one.join(sets.select(F.col("class_id").alias("b"), F.col("data").alias("db")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["da"], batch["db"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                linked.append(100 * shared >= rule.percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "da", "db").mapInArrow(run, "a long, b long")


def _tiled(sets: DataFrame, clusters: DataFrame, rule: Rule, thin: bool) -> DataFrame:
    """``a, b`` of links between sides within clusters (node, component, side). A cluster's classes are dealt, by side and size, into blocks of
    about TILE, or of fewer large ones; each two blocks of linkable sizes and more than one side are a task's tile. A class is sent once for each
    tile it is in, so rows grow with a cluster's size times its blocks. ``thin`` leaves out a tile's links that close a circle."""
    named = clusters.join(sets.select("class_id", "n"), F.col("node") == sets["class_id"]).select("class_id", "component", "side", "n")
    sized = named.groupBy(F.col("component").alias("c")).agg(
        F.least(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)), F.count("*")).cast("int").alias("blocks"))
    in_order = F.percent_rank().over(Window.partitionBy("component").orderBy("side", "n", "class_id"))
    block = F.least(F.floor(in_order * F.col("blocks")), F.col("blocks") - 1).cast("int")
    own = staged(named.join(sized, named["component"] == sized["c"]).select("class_id", "component", "side", "n", block.alias("block")), "blocks")
    spans = own.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                                  F.min("side").alias("s"), F.max("side").alias("t"))
    one, two = spans.toDF("component", "left", "low", "high", "s", "t"), spans.toDF("c2", "right", "low2", "high2", "s2", "t2")
    one_side = (F.col("s") == F.col("t")) & (F.col("s2") == F.col("t2")) & (F.col("s") == F.col("s2"))
    tile = one.join(two, (one["component"] == two["c2"]) & (F.col("left") <= F.col("right")) & ~one_side
                    & (100 * F.col("high") >= rule.percent * F.col("low2")) & (100 * F.col("high2") >= rule.percent * F.col("low")))
    sides = tile.select("component", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    tiles = own.select("component", "block", "class_id", "side").join(sides, ["component", "block"]) \
        .join(sets.select("class_id", "data"), "class_id").select("component", "left", "right", "class_id", "side", "block", "data")

    def solve(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[frame["block"] == k] for k in key[1:])
        i, j = _tile_links(*([np.frombuffer(d, np.uint64) for d in x["data"]] for x in (a, b)), rule)
        if key[1] == key[2]:
            i, j = i[i < j], j[i < j]
        apart = a["side"].to_numpy()[i] != b["side"].to_numpy()[j]
        i, j = i[apart], j[apart]
        ia, ib = a["class_id"].to_numpy()[i], b["class_id"].to_numpy()[j]
        kept = _forest(ia, ib) if thin else np.arange(len(ia))
        return pd.DataFrame({"a": np.minimum(ia, ib)[kept], "b": np.maximum(ia, ib)[kept]})

    return tiles.groupBy("component", "left", "right").applyInPandas(solve, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that join two trees, in order; the rest of a tile's links connect nothing new."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            keep.append(i)
    return np.array(keep, np.int64)


def similar_groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text",
                   count_links: bool = False, with_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (and ``key``) of every row: the least doc_id that links reach, itself included.

    Null and empty texts and texts without words have an empty set and are linked with nothing, as are rows with a
    null id (component null). Equal sets are linked, whatever their texts; repeated rows are answered each; an empty
    table gives no rows; other columns are ignored. ``count_links`` adds ``n_links``, the other rows a row is linked to.
    """
    members, found, weights = links(docs, rule, doc_id, text, thin=not count_links)
    group = components(found)
    least = members.filter((F.col("class_id") != 0) & F.col("doc_id").isNotNull()) \
        .groupBy("class_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("own"))
    named = least.join(group, least["class_id"] == group["node"], "left") \
        .select("class_id", "least", "own", F.coalesce("component", "class_id").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select(F.col("class_id").alias("c"), "component_id", "own")
    out = members.join(named, members["class_id"] == named["c"], "left")
    columns = ["doc_id", *["key"] * with_key, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")]
    if count_links:
        both = found.select(F.col("a").alias("linked"), F.col("b").alias("other")).unionByName(
            found.select(F.col("b").alias("linked"), F.col("a").alias("other")))
        counts = both.join(weights, both["other"] == weights["class_id"]).groupBy("linked").agg(F.sum("weight").alias("n_links"))
        out = out.join(counts, out["class_id"] == counts["linked"], "left")
        mine = F.col("doc_id").isNotNull() & F.col("own").isNotNull()
        columns.append(F.when(mine, F.coalesce("n_links", F.lit(0)) + F.col("own") - 1).otherwise(0).cast("long").alias("n_links"))
    return out.select(*columns)

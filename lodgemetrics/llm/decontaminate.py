"""Benchmark decontamination with Spark expressions only: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted shingle similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodgemetrics.llm.shared import keyed, staged, without_rows

#: Words of a shingle, least weighted Jaccard similarity, and Hamming radius of 64-bit fingerprints. A pair at the
#: least similarity differs in 9.6 bits on average, 2.9 deviation: 20 bits leave out about one in 5,000 such pairs.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Items of fewer shingles are told by any shared shingle, not by the radius: their fingerprints scatter more.
FEW = 9
_LANES, _LANE_BITS = 16, 0x0001000100010001


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _spans(word_list: Column, n: int, make) -> Column:
    """make(slice) of every n consecutive words; a shorter list is one span, an empty list none."""
    size = F.size(word_list)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                                         lambda i: make(F.slice(word_list, i, n)))) \
        .when(size > 0, F.array(make(word_list))).otherwise(F.array().cast("array<string>") if make is _joined
                                                            else F.array().cast("array<bigint>"))


def _joined(part: Column) -> Column:
    return F.array_join(part, " ")


def shingles(word_list: Column, n: int = SHINGLE) -> Column:
    """Hash of each n-word shingle."""
    return _spans(word_list, n, F.xxhash64)


def _bit_counts(hashes: Column) -> Column:
    """How many hashes have each of the 64 bits, a shingle counting as often as it occurs.

    Bits are counted in lanes of 16 bits, sixteen lanes of four; a window may have 65,535 shingles.
    """
    zero = F.array(*[F.lit(0).cast("long")] * _LANES)
    return F.aggregate(hashes, zero, lambda acc, h: F.array(*[
        F.get(acc, F.lit(j)) + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANE_BITS)) for j in range(_LANES)]))


def _majority(sums: Column, n: Column) -> Column:
    """64-bit SimHash: the bits that more than half of n shingles have."""
    bits = []
    for lane in range(_LANES):
        for k in range(4):
            count = F.shiftrightunsigned(F.get(sums, F.lit(lane)), 16 * k).bitwiseAND(F.lit(0xFFFF))
            value = 1 << (lane + 16 * k)
            bits.append(F.when(count * 2 > n, F.lit(value - (1 << 64) if value >= 1 << 63 else value)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks: fingerprints within the radius agree in one of them at least."""
    edge = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _block(value: Column, a: int, n: int) -> Column:
    return F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << n) - 1))


def _indexed(fingerprint: str, radius: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("no"), _block(F.col(fingerprint), a, n).alias("bits"))
                               for i, (a, n) in enumerate(_blocks(radius))]))


def _fingerprinted(df: DataFrame) -> DataFrame:
    """Add the SimHash of the array ``shingles``, a shingle weighing as often as it occurs."""
    return df.withColumn("sums", _bit_counts(F.col("shingles"))) \
        .withColumn("fingerprint", _majority(F.col("sums"), F.size("shingles"))).drop("sums")


def _needed(similarity: float, mine: Column, theirs: Column) -> Column:
    """How many shingles a window of ``mine`` and an item of ``theirs`` must share to reach the similarity."""
    return F.ceil((mine + theirs) * (similarity / (1 + similarity)) - 1e-9).cast("int")


def _shingle_rows(rows: DataFrame, n: int) -> DataFrame:
    """``doc_id, key, size, pos, shingle``: hash of every n words, one row each, from zipped word columns."""
    w, size = F.col("w"), F.size("w")
    zipped = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(size - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)])
    return rows.select("doc_id", "key", size.alias("size"), F.posexplode(zipped).alias("pos", "z")) \
        .select("doc_id", "key", "size", "pos", F.xxhash64(*[F.col(f"z.w{i}") for i in range(n)]).alias("shingle"))


def _short_leaks(rows: DataFrame, items: DataFrame, n: int, short_windows: bool) -> list[DataFrame]:
    """Items of fewer than n words, one shingle each: a table for each length that occurs (fewer than n lengths)."""
    found = []
    for r in items.filter(F.col("n_words") < n).select("n_words").distinct().orderBy("n_words").collect():
        k = r["n_words"]
        own = items.filter(F.col("n_words") == k).select("item_id", F.get("shingles", F.lit(0)).alias("shingle"))
        found.append(_shingle_rows(rows if short_windows else rows.filter(F.size("w") == k), k).join(own, "shingle")
                     .groupBy("doc_id", "key", "item_id").agg(F.max(F.struct(
                         F.lit(True).alias("full"), F.lit(1.0).alias("similarity"), (-F.col("pos")).alias("back"), F.lit(k).alias("words"),
                         F.lit(0).alias("distance"))).alias("b")))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
               n: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", short_windows: bool = False) -> DataFrame:
    """``doc_id, key, item_id, similarity, start_word, n_words, bits``: the best window of each leaked item in each
    document; only pairs that reach the similarity. A window has as many words as the item and may reach over the
    text's ends, where it is clipped: a document that is shorter than the item is a window as a whole. Clipped windows
    are told where no full one reaches the similarity.

    A window can only reach it if enough of its shingles occur in the benchmark at all, so shingles are looked up
    first (an exact, lossless cut) and only such windows are fingerprinted. Fingerprints within the radius share a
    block of the multi-index. Candidates are verified on the words themselves. Items of fewer than FEW shingles are
    verified beyond the radius too where a block and a shingle agree.
    Null and empty texts and items match nothing; an item of fewer than n words is one shingle and matches the same
    words as a whole document or, with ``short_windows``, anywhere in one; repeated rows are answered once; ties go
    to the first window; empty tables give no rows; other columns are ignored.
    """
    items = benchmark.select(benchmark[item_id].alias("item_id"), words(F.coalesce(benchmark[item_text], F.lit(""))).alias("w")) \
        .filter(F.size("w") > 0).distinct()
    items = _fingerprinted(items.select("item_id", "w", F.size("w").alias("n_words"), shingles(F.col("w"), n).alias("shingles")))
    rows = keyed(docs, doc_id, text)
    split = rows.select("doc_id", "key", words(F.col("text")).alias("w"))
    short = _short_leaks(split, items, n, short_windows)
    items = items.filter(F.col("n_words") >= n)
    known = items.select("n_words", F.explode("shingles").alias("shingle")).distinct()
    hits = _shingle_rows(split, n).join(known, "shingle")
    spots = hits.groupBy("doc_id", "key", "size", "n_words").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    # a window begins at most m - least places before its first shingle of the benchmark, and maybe before the text
    m, every = F.col("n_words") - (n - 1), F.col("size") - (n - 1)
    least = F.ceil(m * similarity - 1e-9).cast("int")

    def clipped(start: Column) -> tuple[Column, Column]:
        first = F.greatest(start, F.lit(0))
        return first, F.least(start + F.col("m"), F.col("every")) - first

    def reaches(p: Column, i: Column, d: Column) -> Column:
        last, need = p - d + F.col("m") - 1, _needed(similarity, clipped(p - d)[1], F.col("m"))
        return (F.get(F.col("pos"), i + F.col("least") - 1) <= last) & (F.get(F.col("pos"), i + need - 1) <= last)

    def window(start: Column) -> Column:
        first, mine = clipped(start)
        return F.struct(first.alias("start_word"), mine.alias("mine"))

    starts = F.array_distinct(F.flatten(F.transform("pos", lambda p, i: F.transform(
        F.filter(F.sequence(F.lit(0), F.col("m") - F.col("least")), lambda d: reaches(p, i, d)), lambda d: window(p - d)))))
    spots = spots.withColumns({"m": m, "every": every, "least": least}).select(
        F.col("doc_id").alias("spot_doc"), F.col("key").alias("spot_key"), "n_words", starts.alias("starts")) \
        .filter(F.size("starts") > 0).groupBy("spot_doc", "spot_key").agg(F.collect_list(F.struct("n_words", "starts")).alias("spots"))
    spots = staged(spots, "spots")
    windows = rows.join(spots, rows["doc_id"].eqNullSafe(spots["spot_doc"]) & (rows["key"] == spots["spot_key"])) \
        .select("doc_id", "key", words(F.col("text")).alias("w"), "spots") \
        .select("doc_id", "key", "w", F.explode("spots").alias("s")) \
        .select("doc_id", "key", "w", F.col("s.n_words").alias("n_words"), F.explode("s.starts").alias("at")) \
        .select("doc_id", "key", "at.start_word", "at.mine", "n_words",
                F.slice("w", F.col("at.start_word") + 1, F.col("at.mine") + (n - 1)).alias("w")).distinct()
    of_few = F.when(m < FEW, F.col("shingles"))
    windows = _fingerprinted(windows.withColumn("shingles", shingles(F.col("w"), n))).withColumn("shingles", of_few)
    index = items.select("item_id", "n_words", F.col("fingerprint").alias("item_fp"), of_few.alias("item_shingles"),
                         _indexed("fingerprint", radius).alias("b")).withColumns({"no": F.col("b.no"), "bits": F.col("b.bits")}).drop("b")
    probes = windows.withColumn("b", _indexed("fingerprint", radius)).withColumns(
        {"no": F.col("b.no"), "bits": F.col("b.bits")}).drop("b")
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(_block(apart, a, k) == 0, F.lit(i)) for i, (a, k) in enumerate(_blocks(radius))])
    near = probes.join(index, ["n_words", "no", "bits"]).withColumn("distance", F.bit_count(apart)) \
        .filter(((F.col("distance") <= radius) | F.arrays_overlap("shingles", "item_shingles")) & (first == F.col("no")))
    theirs = items.select("item_id", F.explode(_spans(F.col("w"), n, _joined)).alias("shingle")) \
        .groupBy("item_id", "shingle").agg(F.count("*").alias("theirs"))
    pair = ["doc_id", "key", "item_id", "start_word", "mine", "n_words", "distance"]
    shared = near.select(*pair, F.explode(_spans(F.col("w"), n, _joined)).alias("shingle")) \
        .groupBy(*pair, "shingle").agg(F.count("*").alias("ours")).join(theirs, ["item_id", "shingle"]) \
        .groupBy(*pair).agg(F.sum(F.least("ours", "theirs")).alias("shared"))
    # each shingle weighs as often as it occurs
    scored = shared.withColumn("similarity", F.col("shared") / (F.col("mine") + m - F.col("shared"))) \
        .filter(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "key", "item_id").agg(
        F.max(F.struct((F.col("mine") == m).alias("full"), "similarity", (-F.col("start_word")).alias("back"), (F.col("mine") + (n - 1)).alias("words"), "distance"))
        .alias("b"))
    if short:  # an item_id may stand for texts of several lengths
        best = reduce(DataFrame.unionByName, short, best).groupBy("doc_id", "key", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "key", "item_id", F.col("b.similarity").alias("similarity"),
                       (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.words").cast("long").alias("n_words"),
                       F.col("b.distance").cast("long").alias("bits"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without those whose text holds a benchmark item; other rows of the same id, and columns, stay."""
    return without_rows(docs, find_leaks(docs, benchmark, **settings), settings.get("doc_id", "doc_id"),
                        settings.get("text", "text"))

"""Spelling variants: words one code point apart, by sorted permuterm rotations, and the form each word leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodgemetrics.llm.shared import staged

#: Ends a word in its rotations.
END = "\u0000"
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _LOWER)).otherwise(word)


def word_counts(docs: DataFrame, least_chars: int = 7, least_count: int = 2, typo_every: int | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: maximal letter runs of whole texts, A-Z lower-cased, of at least ``least_chars`` code points that
    occur ``least_count`` times or more.

    ``typo_every`` = m plants misspellings: where m divides h, the crc32 of ``<doc_id>:<run>``, code point h % length
    of the run is deleted. Null texts have no words and null ids count as an empty id; counts combine before the
    shuffle; repeated rows count again.
    """
    runs = docs.select(docs[doc_id].cast("string").alias("doc"), F.explode(F.regexp_extract_all(
        docs[text], F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    if typo_every:
        h = F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "run"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run")).alias("run"))
    return runs.filter(F.length("run") >= least_chars).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")) \
        .filter(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """``prefix, edited, word, n``: rotations of each word with its end mark.

    The rotation behind code point i is that of the word with i moved to the end: its prefix skips the edited code
    point. ``edited`` is that code point, or null where the whole rotation is the prefix (nothing skipped), and
    ``run_end`` tells whether the code point differs from the one behind it, true for one code point of each run.
    """
    size = F.length("word")
    chars = F.split(F.col("word"), "")

    def skip(i: Column) -> Column:
        behind = F.substring(F.col("word"), i + 1, size)
        return F.struct(F.concat(behind, F.lit(END), F.substring(F.col("word"), F.lit(1), i - 1)).alias("prefix"),
                        F.get(chars, i - 1).alias("edited"),
                        (F.coalesce(F.get(chars, i), F.lit(END)) != F.get(chars, i - 1)).alias("run_end"))

    def whole(i: Column) -> Column:
        return F.struct(F.concat(F.substring(F.col("word"), i, size), F.lit(END), F.substring(F.col("word"), F.lit(1), i - 1))
                        .alias("prefix"), F.lit(None).cast("string").alias("edited"), F.lit(True).alias("run_end"))

    every = F.concat(F.transform(F.sequence(F.lit(1), size), skip), F.transform(F.sequence(F.lit(1), size + 1), whole))
    return words.filter((size > 0) & ~F.contains(F.col("word"), F.lit(END))) \
        .select("word", "n", F.explode(every).alias("r")).select("r.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: how many of the distinct words are one code point away, and of these the one of
    largest n (ties: the smallest in code-point order). Words without one have no row.

    Rotations are grouped by prefix. In a group stand the words that differ in the skipped code point alone, so there
    are no more of them than code points in the alphabet, and at most one word that is the same without it. A word
    that has several ways to lose a code point of one run counts the last of them. Each word of a group gets one
    row, not one for each pair. Most prefixes stand once, so nothing is gained by combining before the shuffle.
    """
    group = _rotations(words).repartition("prefix").groupBy("prefix").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word", "edited", "run_end"))).alias("all")) \
        .filter(F.size("all") > 1)

    def near(mine: Column, other: Column) -> Column:
        shorter = mine["edited"].isNull()
        return F.when(other["edited"].isNull(), ~shorter & mine["run_end"]) \
            .otherwise(F.when(shorter, other["run_end"]).otherwise(other["edited"] != mine["edited"]))

    def told(mine: Column) -> Column:
        others = F.filter("all", lambda other: near(mine, other))
        first = F.get(others, F.lit(0))  # sorted by falling n, then word
        return F.struct(mine["word"].alias("word"), F.size(others).cast("long").alias("near"),
                        F.struct(first["minus"].alias("minus"), first["word"].alias("best")).alias("best"))

    found = group.select(F.explode(F.transform("all", told)).alias("t")).select("t.*").filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")) \
        .select("word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.best").alias("best"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (word, n).

    A word's form is its best neighbour, if that occurs at least ``ratio`` (2 or more) times as often; the root is the
    last of the forms that follow. Words are distinct; null and empty words, and words that hold U+0000, have no
    neighbours and are their own root; an empty table gives no rows; other columns are ignored.

    Counts grow by ``ratio`` from form to form, so the logarithm of the largest count bounds the length of a chain,
    and its own logarithm the rounds of pointer doubling.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "words")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = neighbours(words.repartition(parts, "word"))  # a small file becomes many rotations
    told = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.struct("best", "best_n")).alias("form")), "forms")
    links = told.filter("form IS NOT NULL").select("word", F.col("form.best").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 0
    while ratio ** (steps + 1) <= most:
        steps += 1
    reach = 1
    while reach < steps:  # roots lie up to ``reach`` steps away
        further = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        links = staged(links.join(further, links["root"] == further["via"], "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    root = links.select(F.col("word").alias("linked"), "root")
    return told.join(root, told["word"] == root["linked"], "left").select(
        "word", F.col("form.best").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("form.best_n").alias("form_n"))

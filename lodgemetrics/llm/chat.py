"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role runs, concatenated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Double each backslash and break each ``<|``, so no text can hold a control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """Like escape; a line break becomes backslash n, since the role ends at its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Inverse of escape and of escape_role: between doubled backslashes, single ones mark what was broken."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(
        F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments`` (text, loss) that concatenate to it.

    Turns are sorted by (turn, role, text). Adjacent turns of one role share a block and stand apart by NEXT, so the
    original turns can be read back. ``loss`` marks exactly the texts of the trained role. Null role or text is
    empty, a null turn comes first, null conversation ids form one conversation, repeated rows stay, an empty table
    gives no rows, other columns are ignored. A conversation is one output row, so its turns meet in one task.
    """
    body = lambda c: F.coalesce(rows[c], F.lit(""))
    turns = rows.select(rows[conv].alias("conv_id"), F.struct(
        rows[turn].alias("turn"), body(role).alias("role"), body(text).alias("text")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = turns.select("conv_id", "turns", F.filter(
        F.transform("turns", lambda t, i: F.when(
            F.get(F.col("turns"), i - 1)["role"].eqNullSafe(t["role"]), F.lit(None)).otherwise(i)),
        lambda i: i.isNotNull()).alias("first"))
    runs = first.select("conv_id", F.transform("first", lambda a, k: F.struct(
        F.get(F.col("turns"), a)["role"].alias("role"),
        F.transform(F.slice(F.col("turns"), a + 1, F.coalesce(F.get(F.col("first"), k + 1), F.size("turns")) - a),
                    lambda t: escape(t["text"])).alias("texts"))).alias("runs"))

    def piece(value, loss):
        return F.struct(value.alias("text"), loss.alias("loss"))

    off = F.lit(False)

    def block(run):
        loss = run["role"] == trained
        texts = F.flatten(F.transform(run["texts"], lambda x, i: F.when(i == 0, F.array(piece(x, loss))).otherwise(
            F.array(piece(F.lit(NEXT), off), piece(x, loss)))))
        head = F.concat(F.lit(START), escape_role(run["role"]), F.lit("\n"))
        return F.concat(F.array(piece(head, off)), texts, F.array(piece(F.lit(END + "\n"), off)))

    return runs.select("conv_id", F.flatten(F.transform("runs", block)).alias("segments")) \
        .select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, read from the formatted text alone."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(b):
        end = F.length(b) - F.lit(len(END) + 1)
        inside = F.substring(b, F.lit(1), end)
        role = F.substring_index(inside, "\n", 1)
        body = F.substring(inside, F.length(role) + 2, F.length(inside))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda x: F.struct(
            unescape(role).alias("role"), unescape_text(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def unescape_text(text: Column) -> Column:
    """Inverse of escape."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))), "\\")


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says, as counts and digests: turns from the text, trained text from the loss mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: unescape_text(s["text"])), "")
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"),
                            F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

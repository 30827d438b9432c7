"""Repeated word windows, removed everywhere: a count-min prefilter, then exact groups of what it lets through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm import anchors, sketch
from lodgemetrics.llm.shared import keyed, word_bounds

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 35, 16


def repeated_spans(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``doc_id, key, start, n``: n windows from word ``start`` on that also start elsewhere, of keyed rows.

    Pass one: every task sketches the anchor hashes of its windows; merged counts are never below a window's count.
    Pass two: only windows whose anchor is estimated repeated are grouped, exactly; none is lost.
    """
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch.width_for(words // 6 * 2 // (window - k + 2))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in anchors.slices(batch["text"], window, True):
            yield anchors.blocks(part, window, k).gram

    test = rows.sparkSession.sparkContext.broadcast(sketch.sketch(rows, hashes, width))
    found = anchors.staged(anchors.find_blocks(rows, window, k, True, test), "word-blocks")
    test.destroy()
    known = anchors.sorted_out(found, "word-repeats")
    whole = known.filter("copies > 1").select("doc_id", "key", "start", "n")
    open_ = known.filter("first and kinds > 1").select("doc_id", "key", "start", "n", (F.col("copies") == 1).alias("single"))
    return whole.unionByName(anchors.repeated_windows(rows, open_, window, True, "word-windows"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of repeated windows, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+. Null and empty texts have no words; texts shorter than a window keep all; repeated
    rows are repeats of each other; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(batch["text"], batch["spans"].to_pylist()):
                data = t.as_py().encode()
                raw = np.frombuffer(data, np.uint8)
                start, end, _ = word_bounds(raw, np.array([0, len(raw)]))
                gone = anchors.covered(spans, window, len(start)) if spans else np.zeros(len(start), bool)
                n_words.append(len(start))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(data[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()),
                                              pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    return anchors.with_lists(rows, repeated_spans(rows, window, k), "start", "n", how="left").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

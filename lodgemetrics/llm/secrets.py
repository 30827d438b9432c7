"""Secret scan: fixed patterns, and values in credential contexts whose guess cost is high."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodgemetrics.llm.shared import keyed

# Base patterns and their least lengths.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ of 16 and more
KINDS = ("assign", "access", "hex", "guess")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A credential context: a key word, a separator or "is", and a value without spaces or quotes.
CONTEXT = re.compile(r"(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?|login|pin)[\"']?"
                     r"\x20{0,8}(?:[:=]|(?ai:\bis\b))\x20{0,8}[\"']?([^\s\"'<>,;]+)")
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "pin")
DATE = re.compile(r"(?:19|20)\d\d[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])|"
                  r"(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d|(?:19|20)\d\d")
# Common passwords and words, most usual first.
WORDS = ("password pass qwerty admin welcome login letmein monkey dragon master hello love secret sunshine princess "
         "football baseball shadow superman michael jordan hunter summer winter spring autumn flower freedom whatever "
         "trust batman test guest root user default changeme example sample token access server system public private "
         "company office money power star angel tiger lion eagle music computer internet service account database "
         "blue red green black white orange purple silver gold monday friday sunday january march april june july "
         "august october december the and you are for with this that key api dev prod demo temp none null").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
_LEET = str.maketrans("013457@$", "oleastas")
#: Decimal digits of guesses from which a credential value counts as a secret.
STRONG = 10.0


def _charset(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation into words, dates, repeats, keyboard walks and brute force.

    Words are matched up to the longest in the list; repeats and walks as the rest of their maximal run, so the
    table is filled in time linear in the length of the value. An empty value costs 0.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(i, []).append(m.end())
    same, walk = [i + 1 for i in range(n)], [i + 1 for i in range(n)]
    for i in range(n - 2, -1, -1):
        if low[i] == low[i + 1]:
            same[i] = same[i + 1]
        a, b = _PLACE.get(low[i]), _PLACE.get(low[i + 1])
        if a and b and a[0] == b[0] and abs(a[1] - b[1]) == 1:
            step = b[1] - a[1]
            c = _PLACE.get(low[i + 2]) if i + 2 < n else None
            walk[i] = walk[i + 1] if c and c[0] == b[0] and c[1] - b[1] == step else i + 2
    best = [0.0] + [math.inf] * n
    for i in range(n):
        at = best[i]
        best[i + 1] = min(best[i + 1], at + _charset(value[i]))
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                rank = RANK.get(form[i:j])
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.5
                    best[j] = min(best[j], at + math.log10(rank + 1) + extra + case + 0.3)
        for j in dates.get(i, ()):
            best[j] = min(best[j], at + math.log10(366 * 120 if j - i > 4 else 120) + 0.3)
        if same[i] - i >= 3:
            best[same[i]] = min(best[same[i]], at + _charset(value[i]) + math.log10(same[i] - i) + 0.3)
        if walk[i] - i >= 3:
            best[walk[i]] = min(best[walk[i]], at + math.log10(2 * len(_PLACE) * (walk[i] - i)) + 0.3)
    return best[n]


def scan(text: str, strong: float = STRONG) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guess cost) in code points, by start, then kind. Values of base spans get no second span."""
    low = text.lower()
    found: list[tuple[str, int, int, float | None]] = []
    values = set()
    if any(h in low for h in _HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append(("assign", m.start(), m.end(), None))
                values.add(m.start(2))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in low for h in _CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            if m.start(1) not in values and (cost := guess_cost(m[1])) >= strong:
                found.append(("guess", m.start(1), m.end(1), cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", strong: float = STRONG) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, cost) of every row; cost only for kind guess.

    Null and empty texts have no spans, repeated rows are answered each, an empty table gives no rows, other columns
    are ignored, texts are read whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in scan(t.as_py(), strong)]
                     for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, _SPANS)], ["doc_id", "spans"])

    rows = keyed(docs, doc_id, text).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,cost:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))

"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm.shared import keyed

KINDS = ("email", "ip", "card", "phone")
# Base patterns. The IP pattern starts at the first digit of a run, where its leftmost match starts.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Regions of candidates: words, one blank apart, that hold a digit or an at sign.
REGION = re.compile(r"[^\s]*[0-9@][^\s]*(?: [^\s]*[0-9@][^\s]*)*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: Most tokens of an entity; regions the model is fitted on at most, of so many tokens at most.
LONGEST, FIT_REGIONS, FIT_TOKENS = 16, 400, 40
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each at sign, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _shape(token: str) -> str:
    if token[0] in "0123456789":
        return "d" if len(token) < 3 else "D" if len(token) < 8 else "N"
    return "a" if token[0].isascii() and token[0].isalpha() else token if token in " .@+-()%_" else "o"


def span_features(tokens: list[str], shapes: list[str], i: int, j: int) -> list[str]:
    """Whole-span features of tokens i..j-1: shape, digits, checks over the span, and both neighbours."""
    shape = "".join(shapes[i:j])
    text = "".join(tokens[i:j])
    n = sum(len(t) for t, s in zip(tokens[i:j], shapes[i:j]) if s in "dDN")
    squeezed = re.sub(r"(.)\1+", r"\1", shape)
    out = [f"s={squeezed if len(squeezed) <= 12 else 'long'}", f"n={min(n, 20)}", f"l={shapes[i - 1] if i else '^'}",
           f"r={shapes[j] if j < len(shapes) else '$'}", f"b={shapes[i]}", f"e={shapes[j - 1]}"]
    if 16 <= n <= 19 and "a" not in shape and luhn(re.sub(r"[^0-9]", "", text)):
        out.append("luhn")
    if text.count(".") == 3 and set(shape) <= set("dD."):
        out.append("quad" if all(_small(p) for p in text.split(".") if p) and text[-1] != "." != text[0] else "overquad")
    if "@" in shape:
        out.append("at=" + str(min(2, shape.count("@"))) + ("." if "." in shape.split("@")[-1] else ""))
    if shapes[i] == "+":
        out.append(f"plus={8 <= n <= 15}")
    return out


@dataclass
class SegmentField:
    """Weights of (type, feature); entities of at most LONGEST tokens, everything else single tokens of type none."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def candidates(self, tokens: list[str], shapes: list[str]) -> list[list[tuple[int, str, float, list[str]]]]:
        """By end: (start, type, score, features) of each candidate entity. An entity has a digit and starts and ends
        with a letter, digit, plus sign or bracket; it holds no control of any other script."""
        n = len(tokens)
        out: list[list[tuple[int, str, float, list[str]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if shapes[i] not in "dDNa+(":
                continue
            digits = False
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                s = shapes[j - 1]
                if s == "o":
                    break
                digits = digits or s in "dDN@"
                if digits and s in "dDNa)" and (j - i > 1 or s == "N"):
                    feats = span_features(tokens, shapes, i, j)
                    for kind in KINDS:
                        out[j].append((i, kind, sum(self.weights.get((kind, f), 0.0) for f in feats), feats))
        return out

    def decode(self, tokens: list[str]) -> list[tuple[str, int, int]]:
        """Best joint choice of boundaries and types: (type, first token, end token)."""
        shapes = [_shape(t) for t in tokens]
        cand = self.candidates(tokens, shapes)
        n = len(tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, s, _ in cand[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (kind, i)
        out, j = [], n
        while j > 0:
            if back[j]:
                kind, i = back[j]
                out.append((kind, i, j))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, regions: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.5,
              decay: float = 1e-4) -> None:
        """Stochastic gradient on the conditional likelihood; forward and backward sums over all segmentations."""
        sized = []
        for text, spans in regions:
            tokens = [m[0] for m in _TOKEN.finditer(text)]
            ends = {m.start(): k for k, m in enumerate(_TOKEN.finditer(text))}
            place = lambda p: ends.get(p, len(tokens) if p >= len(text) else None)
            gold = {(k, place(a), place(b)) for k, a, b in spans}
            sized.append((tokens, [_shape(t) for t in tokens], {g for g in gold if None not in g}))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for tokens, shapes, gold in sized:
                cand = self.candidates(tokens, shapes)
                n = len(tokens)
                fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    fwd[j] = _logsum([fwd[j - 1]] + [fwd[i] + s for i, _, s, _ in cand[j]])
                starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
                for j in range(1, n + 1):
                    for i, _, s, _ in cand[j]:
                        starts[i].append((j, s))
                for i in range(n - 1, -1, -1):
                    bwd[i] = _logsum([bwd[i + 1]] + [bwd[j] + s for j, s in starts[i]])
                grad: Counter = Counter()
                for j in range(1, n + 1):
                    for i, kind, s, feats in cand[j]:
                        g = float((kind, i, j) in gold) - math.exp(min(0.0, fwd[i] + s + bwd[j] - fwd[n]))
                        if abs(g) > 1e-4:
                            for f in feats:
                                grad[kind, f] += g
                for key, g in grad.items():
                    w = self.weights.get(key, 0.0)
                    self.weights[key] = w + step * (max(-1.0, min(1.0, g)) - decay * w)


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def fit(docs: DataFrame, regions: int = FIT_REGIONS, doc_id: str = "doc_id", text: str = "text") -> SegmentField:
    """Fit on at most ``regions`` candidate regions per kind and of no kind, chosen by hash; the base spans label them."""
    rows = keyed(docs, doc_id, text).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                t = t.as_py()
                spans = base_spans(t)
                for a, b in candidate_regions(t):
                    inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
                    if b - a <= 8 * FIT_TOKENS and len(_TOKEN.findall(t[a:b])) <= FIT_TOKENS:
                        out.append((t[a:b], inside[0][0] if inside else "none", [f"{k}:{s}:{e}" for k, s, e in inside]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.string(), pa.string(), pa.list_(pa.string())))], ["region", "kind", "spans"])

    found = rows.mapInArrow(run, "region string, kind string, spans array<string>").withColumn("h", F.xxhash64("region"))
    # one region per kind and hash slot, its smallest hash: combined before the shuffle
    picked = found.groupBy("kind", F.pmod("h", F.lit(regions)).alias("slot")).agg(
        F.min(F.struct("h", "region", "spans")).alias("r"))
    model = SegmentField()
    got = sorted((r["r"]["h"], r["r"]["region"], r["r"]["spans"]) for r in picked.collect())  # 5 kinds x regions rows
    model.learn([(region, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]) for _, region, spans in got])
    return model


def candidate_regions(text: str) -> Iterator[tuple[int, int]]:
    for m in REGION.finditer(text):
        yield m.start(), m.end()


def scan(text: str, model: SegmentField) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points: base spans, and segments of the field that overlap none of them."""
    spans = base_spans(text)
    out = [(*s, True) for s in spans]
    taken = sorted((a, b) for _, a, b in spans)
    k = 0
    for a, b in candidate_regions(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        tokens = list(_TOKEN.finditer(text, a, b))
        for kind, i, j in model.decode([m[0] for m in tokens]):
            s, e = tokens[i].start(), tokens[j - 1].end()
            x = k
            while x < len(taken) and taken[x][1] <= s:
                x += 1
            if x == len(taken) or taken[x][0] >= e:
                out.append((kind, s, e, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, model: SegmentField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` (kind, start, end, base) of every row, by kind as listed, then start.

    Null and empty texts have no spans, repeated rows are answered each, an empty table gives no rows, other columns
    are ignored, texts are read whole.
    """
    rows = keyed(docs, doc_id, text).select("doc_id", "text")
    weights = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in scan(t.as_py(), weights.value)]
                     for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, _SPANS)], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(docs: DataFrame, model: SegmentField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, each span of personal data replaced by its kind in brackets; null text stays null."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, end = [], 0
        for kind, a, b, _ in sorted(scan(value, weights.value), key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [value[end:a], f"[{kind}]"]
                end = b
            elif b > end:  # two kinds overlap: the rest of the later span goes too
                end = b
        return "".join([*out, value[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(v.as_py()) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    from lodgemetrics.llm.secrets import joined

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))

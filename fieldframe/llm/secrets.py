"""Secret scans: fixed patterns, and values in a credential's context judged by a password guess cost.

The guess cost of a value is the least number of bits over all ways to cut it into words (log2 of a word's rank), dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming from left to right. A value that costs at
least ``threshold`` bits is a secret; "changeme2019" or "xxxxxxxx" is not.
"""

from __future__ import annotations

import hashlib
import json
import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "cost")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|client|secret|signing|encryption)[_-]?(?:key|secret|token))"
    r"[\"']?(?:\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?|\x20+is\x20+|(?<=bearer)\x20+)[\"'`<(\[{]*([^\s\"'`<>()\[\]{}|,;]{6,})",
    re.ASCII | re.IGNORECASE,
)
#: The characters of a CONTEXT value.
VALUE = re.compile(r"[^\s\"'`<>()\[\]{}|,;]+")
CLOSING = ".:!?&%$#*"
#: Every match of ASSIGN or CONTEXT holds one of these in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
LONGEST_WORD = 24


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {(a, b) for a, (r, k) in at.items() for b, (q, m) in at.items() if a != b and abs(r - q) <= 1 and -1 <= (k - m) * (1 if r == q else (r - q) or 1) <= 1}


NEAR = _neighbours()
LEET = str.maketrans("@4310$57", "aaeiosst")


class GuessCost:
    """ranks: lower-case word -> rank, 1 the commonest."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    @classmethod
    def from_tokenizer(cls, path: str) -> GuessCost:
        """Whole words of a public tokenizer's vocabulary, ranked by their order in it."""
        with open(path) as f:
            ids = json.load(f)["model"]["vocab"]
        words = (w[:-4] for w, _ in sorted(ids.items(), key=lambda x: x[1]) if w.endswith("</w>"))
        return cls({w: k for k, w in enumerate((w for w in words if len(w) > 2 and w.isalpha() and w.isascii()), 1)})

    def bits(self, value: str) -> float:
        """Least bits over all segmentations; every segment after the first costs one bit more."""
        n, low = len(value), value.lower()
        leet = low.translate(LEET)
        dates: dict[int, list[int]] = {}
        for k in range(n):
            if value[k].isdigit() and (m := DATE.match(value, k)):
                dates.setdefault(m.end(), []).append(k)
        size = (26 if any(c.islower() for c in value) else 0) + (26 if any(c.isupper() for c in value) else 0) + (10 if any(c.isdigit() for c in value) else 0)
        if all(c in "0123456789abcdef" for c in low):
            size = 16 if any(c.isalpha() for c in low) else 10
        size += 33 if any(not c.isalnum() for c in value) else 0
        each = log2(max(size, 10))
        best = [0.0] + [0.0] * n
        brute = [0.0] + [0.0] * n  # best that ends in a brute-force span
        run = walk = 0  # where the repeat and the walk that end here began
        run_low = walk_low = float("inf")  # least best[k] - rate * k of the places where such a span may begin
        for i in range(1, n + 1):
            brute[i] = min((brute[i - 1] if i > 1 else 0), best[i - 1] + (i > 1)) + each
            cost = brute[i]
            if i > 1:
                if low[i - 1] != low[i - 2]:
                    run, run_low = i - 1, float("inf")
                if (low[i - 2], low[i - 1]) not in NEAR:
                    walk, walk_low = i - 1, float("inf")
                if (k := i - 3) >= run:
                    run_low = min(run_low, best[k] + (k > 0) - k / 4)
                    cost = min(cost, run_low + each + i / 4)
                if (k := i - 4) >= walk:
                    walk_low = min(walk_low, best[k] + (k > 0) - k)
                    cost = min(cost, walk_low + log2(len(NEAR)) + i - 1)
            for k in dates.get(i, ()):
                cost = min(cost, best[k] + (k > 0) + log2(365 * 120))
            for k in range(max(0, i - LONGEST_WORD), i - 2):
                rank = self.ranks.get(low[k:i])
                extra = 0.0
                if rank is None:
                    rank, extra = self.ranks.get(leet[k:i]), 2.0
                if rank is not None:
                    case = 0 if value[k:i] == low[k:i] else 1 if value[k + 1 : i] == low[k + 1 : i] else 2
                    cost = min(cost, best[k] + (k > 0) + log2(rank + 1) + extra + case)
            best[i] = cost
        return best[n]


def find(text: str, cost: GuessCost | None = None, threshold: float = 40.0) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) in code points, by start, then kind in the order of KINDS, then end.

    Base kinds hold the leftmost non-overlapping matches of their pattern. ``cost`` spans are values in a credential's
    context, base ones included, whose guess cost reaches the threshold. Where a base value is only the first part of a
    value, the whole value is judged too; it never ends before the base value does.
    """
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        base = {}
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append((m.start(), "assign", m.end(), m.start(2)))
                base[m.start(2)] = m.end(2)
        if cost is not None:
            values = set(base.items())
            whole = [(m[0], m.start()) for m in (VALUE.match(text, s) for s in base)] + [(m[1], m.start(1)) for m in CONTEXT.finditer(text)]
            values |= {(s, max(s + len(v.rstrip(CLOSING)), base.get(s, 0))) for v, s in whole}
            out += [(s, "cost", e, s) for s, e in values if e - s >= 6 and cost.bits(text[s:e]) >= threshold]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def redact(text: str, spans: list[tuple[int, str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every secret (overlapping ones as one) replaced by the mark."""
    out, at = [], 0
    for s, e in sorted((x[3], x[2]) for x in spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


_costs: dict[str, GuessCost] = {}


def _cost(path: str) -> GuessCost:
    if path not in _costs:
        _costs[path] = GuessCost.from_tokenizer(path)
    return _costs[path]


def scan(docs: DataFrame, path: str, threshold: float = 40.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row, in the rows' partitions; a null text counts as empty
    (no spans); null and repeated ids stay as they are; other columns are not looked at."""

    def run(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e, _ in find(t or "", _cost(path), threshold)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact_documents(docs: DataFrame, path: str, threshold: float = 40.0) -> DataFrame:
    """docs with every secret in ``text`` replaced and ``n_chars`` (where there is one) counted anew; all other columns stay,
    whatever their names.

    Null texts stay null, empty ones empty; rows are looked at one by one, so null and repeated ids and repeated rows do not
    matter; a text of any length is read whole; an empty table gives an empty result."""
    names, at = docs.columns, docs.columns.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t and redact(t, find(t, _cost(path), threshold)) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                counts = [n if x == y else len(y) for n, x, y in zip(columns[size].to_pylist(), old, new, strict=True)]
                columns[size] = pa.array(counts, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of ``scan``: base_sha256 over kind:start:end of the base spans, spans with all of them."""

    def run(batches):
        for b in batches:
            rows = b.column("spans").to_pylist()
            say = [[f"{x['kind']}:{x['start']}:{x['end']}" for x in r] for r in rows]
            base = [",".join(x for x in r if x[:4] != "cost") for r in say]
            counts = [pa.array([sum(x["kind"] == k for x in r) for r in rows], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(r) for r in say], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return scan(docs, path).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), default_path())

"""Substring dedup over sliding spans of sentences.

A text is cut into sentences at closing marks and line ends. Every run of at least ``run`` sentences, from each sentence
on, as long as needed for ``words`` words, is hashed. Where a window of ``WINDOW`` words has too few of its words in such
runs (long sentences, or a passage set into other sentences), its words are cut into parts instead: of the places in the
window where ``INSIDE`` words begin, the one whose words hash lowest begins a part (winnowing). Both are seen from the
window's own words, so two copies are cut alike whatever stands around them, and no passage of that length is without a
run. The hashes (128 bits) meet in one global aggregation (their smallest doc_id) and one join; words covered by a run
that some earlier document has, or that came earlier in the same document, are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = 3
WORDS = 31
#: Of every passage of so many words at least INSIDE words lie in runs.
WINDOW = 51
INSIDE = 31
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
ENDING = np.zeros(256, bool)
ENDING[list(b".!?")] = True
# A fixed pseudo-random value for each byte; capitals have those of their small letters, white space none.
WEIGHT = np.array([xxhash.xxh64_intdigest(bytes([b]).lower(), 42) >> 20 for b in range(256)], np.int64)
WEIGHT[SPACE] = 0
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Cut:
    """The sentences of a text (bytes) and the hashed runs over them."""

    def __init__(self, data: bytes, run: int = RUN, words: int = WORDS):
        raw = np.frombuffer(data, np.uint8)
        space = SPACE[raw]
        self.data = data
        self.starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.empty(0, np.int64)
        n = len(self.starts)
        self.begin = self.end = np.empty(0, np.int64)  # of each run, its first word and the one after its last
        self.part = np.empty(0, bool)
        self.hashes: list[int] = []
        if not n:
            return
        self.ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        lines = np.cumsum(raw == 10)
        last = ENDING[raw[self.ends - 1]]
        last[:-1] |= lines[self.starts[1:]] != lines[self.ends[:-1] - 1]
        last[-1] = True
        begin, end = self._runs(last, run, words)
        bare = self._bare(np.arange(max(n - WINDOW + 1, 0)), begin, end)
        part = np.empty(0, np.int64)
        if len(bare):
            word = np.r_[np.add.reduceat(WEIGHT[raw], self.starts), 0, 0].astype(np.uint64)
            rank = (word[:-2] * MIX[0] + word[1:-1] * MIX[1] + word[2:] * MIX[2]) * MIX[0]
            places = np.lib.stride_tricks.sliding_window_view(rank, WINDOW - INSIDE + 1)
            part = np.unique(np.concatenate([at + places[at].argmin(1) for at in np.array_split(bare, len(bare) // 65536 + 1)]))
        # In order of place, a part of just the words of a run left out.
        begin, end, part = np.r_[begin, part], np.r_[end, part + INSIDE], np.r_[np.zeros(len(begin), bool), np.ones(len(part), bool)]
        order = np.lexsort((part, end, begin))
        begin, end, part = begin[order], end[order], part[order]
        new = np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])][: len(begin)]
        self.begin, self.end, self.part = begin[new], end[new], part[new]
        joined = b" ".join(data.lower().split())
        at = np.r_[0, np.cumsum(self.ends - self.starts + 1)]
        digest = xxhash.xxh3_128_intdigest
        self.hashes = [digest(joined[s:e], 42) for s, e in zip(at[self.begin].tolist(), (at[self.end] - 1).tolist(), strict=True)]

    @staticmethod
    def _runs(last: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run, its first word and the one after its last; ``last`` marks the words that end a unit."""
        first = np.r_[0, np.flatnonzero(last) + 1]
        count = len(first) - 1
        until = np.maximum(np.searchsorted(first, first[:-1] + words), np.arange(count) + run)
        begin = np.flatnonzero(until <= count)
        return first[begin], first[until[begin]]

    @staticmethod
    def _bare(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which windows (first words) have fewer than INSIDE words in complete runs. Runs overlap the next ones, so those
        within a window cover all from the first one's begin to the last one's end. Units cut off by the window's own ends
        do not count, since their ends depend on what is outside."""
        low, high = np.searchsorted(begin, at, "right"), np.searchsorted(end, at + WINDOW)
        return at[(low >= high) | (np.r_[0, end][high] - np.r_[begin, 1 << 60][low] < INSIDE)]

    def covered(self, gone: set[int]) -> np.ndarray:
        """Which words lie in a run whose hash is in ``gone`` or came earlier in this text; a part's earlier place must
        not overlap it, so that the first place of a word said over and over is kept."""
        seen: dict[int, int] = {}
        edge = np.zeros(len(self.starts) + 1, np.int64)
        for h, s, e, part in zip(self.hashes, self.begin.tolist(), self.end.tolist(), self.part.tolist(), strict=True):
            if h in gone or h in seen and (not part or seen[h] <= s):
                edge[s] += 1
                edge[e] -= 1
            else:
                seen.setdefault(h, e)
        return np.cumsum(edge)[:-1] > 0

    def without(self, covered: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
        """The text without the covered words (a line end after a removed stretch stays), and the byte spans removed."""
        if not covered.any():
            return self.data, []
        step = np.diff(np.r_[0, covered.astype(np.int8), 0])
        out, spans, at = [], [], 0
        bounds = np.r_[self.starts, len(self.data)]
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            start, stop = int(bounds[s]), int(bounds[e])
            out.append(self.data[at:start])
            if b"\n" in self.data[int(self.ends[e - 1]) : stop]:
                out.append(b"\n")
            spans.append((start, int(self.ends[e - 1])))
            at = stop
        out.append(self.data[at:])
        return b"".join(out), spans


LOW = (1 << 64) - 1


def runs(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(h, g, doc_id): every distinct run hash, in two halves, of every row with an id."""

    def cut(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                found = [list(dict.fromkeys(Cut(t or b"", run, words).hashes)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                halves = np.frombuffer(b"".join([x.to_bytes(16, "little") for f in found for x in f]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(0).take(pa.array(owner, pa.int64()))], ["h", "g", "doc_id"])

    some = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return some.mapInArrow(cut, "h long, g long, doc_id long")


def repeats(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, gone): per document the hashes of its runs that a document of a smaller id has too."""
    found = common.save(runs(docs, run, words))
    shared = found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = common.save(shared.select(F.col("h").alias("__h"), F.col("g").alias("__g"), "first"))
    later = found.join(shared, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """docs with the repeated passages taken out of ``text``, ``n_chars`` (where there is one) counted anew, and further
    columns n_removed (characters) and removed (start:end of each stretch in code points of the old text); where docs has
    columns of these names, the new ones are called _n_removed and _removed.

    The first place of a run, by doc_id and then by position, keeps it. Rows of one id are one document: they do not
    count as repeats of each other. A row with a null id is only held against itself; a null text stays null; texts with
    fewer than ``words`` words, or fewer than ``run`` sentences and ``WINDOW`` words, lose nothing. A text of any length is
    cut whole. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns]
    owner, mark = common.unused(docs, "owner"), common.unused(docs, "gone")
    more = [common.unused(docs, "n_removed"), common.unused(docs, "removed")]
    gone = repeats(docs, run, words).select(F.col("doc_id").alias(owner), F.col("gone").alias(mark))
    joined = docs.join(gone, docs["doc_id"] == F.col(owner), "left").select(*[docs[c] for c in kept], mark)
    at = kept.index("text")
    size = kept.index("n_chars") if "n_chars" in kept else None

    def apply(batches):
        for b in batches:
            new, taken, said, counts = [], [], [], []
            for text, gone in zip(b.column(at).cast(pa.binary()), b.column(len(kept)), strict=True):
                text = text.as_py()
                cut = Cut(text or b"", run, words)
                left, spans = cut.without(cut.covered({(x["h"] & LOW) | (x["g"] & LOW) << 64 for x in gone.as_py() or ()}))
                left = left if text is not None else None
                chars, points, pos = [], 0, 0
                for s, e in spans:
                    points += len(text[pos:s].decode("utf-8", "replace"))
                    width = len(text[s:e].decode("utf-8", "replace"))
                    chars.append((points, points + width))
                    points, pos = points + width, e
                new.append(left)
                taken.append(sum(e - s for s, e in chars))
                said.append(",".join(f"{s}:{e}" for s, e in chars))
                counts.append(len(left.decode("utf-8", "replace")) if spans else None)
            columns = list(b.columns)[: len(kept)]
            columns[at] = pa.array(new, pa.binary()).cast(b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([n if c is None else c for n, c in zip(columns[size].to_pylist(), counts, strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken, pa.int64()), pa.array(said, pa.string())], [*kept, *more])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(apply, f"{kinds}, `{more[0]}` long, `{more[1]}` string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Best-fit packing of documents into token sequences.

Tokenising is per task: a text is a run of words between ASCII white space, which the tokenizer's rules never join, so
each word is encoded once and its ids are looked up afterwards. Packing is bulk-synchronous best fit, longest first, in
bands of similar length. A round range-sorts a band's waiting documents and the gaps that may hold them by size. Each
partition is swept once: a document's successor is the smallest gap that holds it, and of the documents with one
successor the longer ones win. What a partition leaves over, documents for gaps of later partitions and gaps for
documents of earlier ones, is matched by rank: the counts of the partitions fix which number a rank has, and equal
numbers meet in an equi-join. Documents longer than any gap open sequences. Gaps are updated, and the rest goes on to the
next round. Rows stay in tables of the shared folder; the driver sees a row of counts for each partition.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
#: Documents and gaps that a task of a round sweeps.
TASK_ROWS = 1 << 16
#: Shortest to longest length of a band. Nearer to 1 means more rounds and a closer best fit.
RATIO = 0.7
CACHED_WORDS = 300_000
_loaded: dict = {}
# The rules under which words may be cut here; other tokenizers are used whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters that NFC leaves alone and whose lower case is one letter each; no apostrophe, and no < of an added token.
PLAIN = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ!\"#$%&()*+,./:;=>?@\\[\\]\\\\^_`{|}~-]+")
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


BYTE_CHARS = _byte_chars()


class Words(dict):
    """Ids of words between white space, as little-endian unsigned 32-bit numbers, encoded when first met.

    A word of Latin letters, digits and punctuation is cut into the tokenizer's own parts and these go to its model alone;
    the others go through all of it.
    """

    def __init__(self, tokenizer, plain: bool, old: dict):
        self.tokenizer, self.model, self.plain, self.old = tokenizer, tokenizer.model, plain, old

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if self.plain and PLAIN.fullmatch(text):
                parts = (p if p.isascii() else "".join([BYTE_CHARS[c] for c in p.encode()]) for p in PARTS.findall(text.lower()))
                ids = pack_ids([t.id for p in parts for t in self.model.tokenize(p)])
            else:
                ids = pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids


class Encoder:
    """Keeps the words met in two generations: a full one replaces the older one, whose words come back when they are met
    again, so common words stay while those met once go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.plain = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.words = Words(self.tokenizer, self.plain, {})

    def encode(self, text: bytes) -> bytes:
        if len(self.words) > CACHED_WORDS:
            self.words.old = {}
            self.words = Words(self.tokenizer, self.plain, self.words)
        return b"".join(map(self.words.__getitem__, text.split()))


def encode_words(texts: list[bytes], path: str) -> list[bytes]:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return [_loaded[path].encode(t) for t in texts]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids, then id 0, cut every ``capacity`` tokens."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                owner, piece, length, crc, ids = [], [], [], [], []
                for k, data in enumerate(encode_words(texts, path)):
                    data += b"\0\0\0\0"
                    for p, s in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[s : s + 4 * capacity]
                        owner.append(k)
                        piece.append(p)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                piece = np.array(piece, np.int32)
                columns = [part.column(0).take(pa.array(owner)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bands(capacity: int, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(shortest, longest) lengths of the bands, longest first, each band's lengths within ``ratio`` of each other."""
    out, top = [], capacity
    while top:
        low = min(int(top * ratio) + 1, top)
        out.append((low, top))
        top = low - 1
    return out


#: Kinds of a sweep's rows: documents and gaps' slots that found nothing within their partition, matches, a partition's sums.
DOC, SLOT, MATCH, SUMS = range(4)
SWEPT = "kind int, id long, other long, size long, part int, rank long"


def sweep(longest: int):
    """One partition of documents and gaps in order of size. Each gap has a slot for as many documents as surely fit, and its
    slots go to the longest documents below it that no smaller gap took: the successor of a document is the first gap after
    it, and of the documents with one successor the longer ones win it."""

    def run(batches):
        part = TaskContext.get().partitionId()
        docs: list[tuple[int, int]] = []  # those without a gap so far, longest last
        slots, gaps, tail = 0, 0, 0
        for b in batches:
            out: list[tuple] = []
            for size, is_gap, key in zip(*(b.column(c).to_pylist() for c in ("size", "is_gap", "id")), strict=True):
                if not is_gap:
                    docs.append((key, size))
                    continue
                room = max(1, size // longest)
                while room and docs:
                    doc, length = docs.pop()
                    out.append((MATCH, doc, key, length, part, 0))
                    room -= 1
                if room:
                    out.append((SLOT, key, room, size, part, slots))
                slots, gaps, tail = slots + room, gaps + 1, len(docs)
            yield rows_of(out)
        for at in range(0, len(docs), 1 << 16):
            yield rows_of([(DOC, doc, 0, length, part, at + k) for k, (doc, length) in enumerate(docs[at : at + (1 << 16)])])
        # Sums: documents left, slots left, those of the documents that come after the last gap, gaps.
        yield rows_of([(SUMS, len(docs), slots, len(docs) - tail, part, gaps)])

    return run


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "id", "other", "size", "part", "rank"])


def resolve(sums: list) -> tuple[np.ndarray, np.ndarray, int, int]:
    """What the partitions left over, matched by rank over all of them.

    sums: (part, documents, slots, documents after the last gap, gaps) in order of size, a row for each partition. Returns
    runs of documents (part, from rank, to rank, number of the last one, 1 if they open sequences), runs of slots (part, how
    many, number of the first), and how many are matched and open sequences.
    """
    last = max((k for k, s in enumerate(sums) if s[4]), default=-1)
    docs, slots, left, matched = [], [], [], 0
    for part, n, free, _, _ in sums:
        taken = 0
        while taken < free and left:
            q, lo, hi = left.pop()
            t = min(free - taken, hi - lo)
            docs.append((q, hi - t, hi, matched + taken, 0))
            taken += t
            if hi - t > lo:
                left.append((q, lo, hi - t))
        if taken:
            slots.append((part, taken, matched))
        matched += taken
        if n:
            left.append((part, 0, n))
    opened = 0
    for k in range(len(sums) - 1, max(last, 0) - 1, -1):
        part, n, _, tail, _ = sums[k]
        n_open = tail if k == last else n
        if n_open:
            docs.append((part, n - n_open, n, opened, 1))
            opened += n_open
    return np.array(sorted(docs), np.int64).reshape(-1, 5), np.array(sorted(slots), np.int64).reshape(-1, 3), matched, opened


#: Kinds of numbered rows: matched documents and slots by their number, documents that open sequences, and those that wait.
TAKES, TAKEN, OPENS, WAITS = range(4)


def number(docs: np.ndarray, slots: np.ndarray):
    """Rows of a sweep that found nothing within their partition -> (kind, no, id, size) by the runs of ``resolve``."""

    def run(batches):
        big = np.int64(1) << 40
        doc_at, slot_at = docs[:, 0] * big + docs[:, 1], {p: (n, first) for p, n, first in slots.tolist()}
        for b in batches:
            kind, key, other, size, part, rank = (b.column(c).to_numpy() for c in ("kind", "id", "other", "size", "part", "rank"))
            d = kind == DOC
            at = np.searchsorted(doc_at, part[d] * big + rank[d], "right") - 1
            runs = docs[np.maximum(at, 0)] if len(docs) else np.full((int(d.sum()), 5), -1)
            within = (at >= 0) & (runs[:, 0] == part[d]) & (rank[d] < runs[:, 2])
            what = np.where(within, np.where(runs[:, 4] == 1, OPENS, TAKES), WAITS)
            yield numbered(what, np.where(within, runs[:, 3] + runs[:, 2] - 1 - rank[d], 0), key[d], size[d])
            s = kind == SLOT
            n, first = np.array([slot_at.get(p, (0, 0)) for p in part[s].tolist()], np.int64).reshape(-1, 2).T
            used = np.clip(n - rank[s], 0, other[s])
            nth = np.arange(used.sum()) - np.repeat(np.cumsum(used) - used, used)
            yield numbered(np.full(len(nth), TAKEN), np.repeat(first + rank[s], used) + nth, np.repeat(key[s], used), np.zeros(len(nth), np.int64))

    return run


def numbered(kind, no, key, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(no, pa.int64()), pa.array(key, pa.int64()), pa.array(size, pa.int64())], ["kind", "no", "id", "size"])


def match_round(waiting: DataFrame, gaps: DataFrame, longest: int, first: int, capacity: int, tasks: int):
    """One round: (id, size) documents and (seq, gap) gaps -> the tables of the sweep and of what it left over, numbered, the
    table (id, size, seq) of what is placed, those that wait, the new number of sequences, and how many wait."""
    items = waiting.select("size", F.lit(False).alias("is_gap"), "id").union(gaps.select("gap", F.lit(True), "seq"))
    swept = common.save(items.repartitionByRange(tasks, "size", "is_gap", "id").sortWithinPartitions("size", "is_gap", "id").mapInArrow(sweep(longest), SWEPT))
    # A row for each partition, which is all that goes to the driver.
    sums = sorted((r.part, r.id, r.other, r.size, r.rank) for r in swept.where(F.col("kind") == SUMS).collect())
    docs, slots, matched, opened = resolve(sums)
    # Stored, since the joins' two sides, what opens sequences and the next round, which samples and sorts, each read it.
    rest = common.save(swept.where(F.col("kind").isin(DOC, SLOT)).mapInArrow(number(docs, slots), "kind int, no long, id long, size long"))
    placed = swept.where(F.col("kind") == MATCH).select("id", "size", F.col("other").alias("seq"))
    if matched:
        takes, taken = rest.where(F.col("kind") == TAKES), rest.where(F.col("kind") == TAKEN).select("no", F.col("id").alias("seq"))
        placed = placed.union(takes.repartition(tasks, "no").join(taken.repartition(tasks, "no"), "no").select("id", "size", "seq"))
    each = capacity // longest
    after = first + -(-opened // each)
    if opened:
        placed = placed.union(rest.where(F.col("kind") == OPENS).select("id", "size", (F.lit(first) + F.floor(F.col("no") / each)).alias("seq")))
    placed = common.save(placed)
    waits = sum(s[1] for s in sums) - matched - opened
    return [swept, rest], placed, rest.where(F.col("kind") == WAITS).select("id", "size"), after, waits


def pack(found: DataFrame, capacity: int = CAPACITY, ratio: float = RATIO) -> DataFrame:
    """The rows of ``pieces`` (any further columns stay) with their sequence_id and offset."""
    spark = found.sparkSession
    names = found.columns
    row = common.unused(found, "row")
    found = common.save(found.withColumn(row, F.monotonically_increasing_id()))
    # By length, so that a band reads its own rows.
    slim = common.save(found.select(F.col(row).alias("id"), F.col("length").alias("size")).repartitionByRange("size", "id").sortWithinPartitions("size", "id"))
    present = {r["size"]: r["n"] for r in slim.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most as many rows as the capacity
    gaps = spark.range(0, numPartitions=1).select(F.col("id").alias("seq"), F.col("id").alias("gap"))
    spent: list[DataFrame] = []
    steps, sequences = [], 0
    for low, top in bands(capacity, ratio):
        waiting, waits = slim.where(F.col("size").between(low, top)), sum(n for size, n in present.items() if low <= size <= top)
        while waits:
            tasks = -(-(waits + sequences) // TASK_ROWS)
            read, placed, waiting, after, waits = match_round(waiting, gaps.where(F.col("gap") >= low), top, sequences, capacity, tasks)
            steps.append(placed)
            new = spark.range(sequences, after, numPartitions=tasks).select("id", F.lit(capacity).cast("long").alias("gap"))
            changes = gaps.union(new).union(placed.select("seq", -F.col("size"))).repartition(tasks, "seq")
            gaps = common.save(changes.groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0"), *spent)
            spent, sequences = [*read, gaps], after
    if not steps:
        return found.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = spark.read.schema(steps[0].schema).parquet(*(t.__dict__["_saved_at"] for t in steps))
    before = Window.partitionBy("seq").orderBy(F.desc("size"), "id")  # at most as many rows as the capacity
    placed = placed.select("id", F.col("seq").alias("sequence_id"), (F.sum("size").over(before) - F.col("size")).alias("offset"))
    return found.join(placed, found[row] == placed["id"]).select(*(found[c] for c in names), "sequence_id", "offset")


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs whole texts. A null text counts as empty (one token, id 0); a null or repeated doc_id is packed like any other,
    row by row; a text of any length is encoded whole and cut into pieces; an empty table gives an empty result; other columns
    of docs are not looked at."""
    return pack(pieces(docs, path, capacity, with_ids=with_ids), capacity)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"), default_path())

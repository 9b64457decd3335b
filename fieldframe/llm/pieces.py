"""SentencePiece encoding and decoding over a relational lattice.

A text, after a space put before it, is cut before every run of spaces into words. The corpus' words are counted, and the
commonest, of a bounded number and length, are encoded relationally: their substrings of bounded length are exploded and
equi-joined to the piece table (of fixed size, hence broadcast), a character that is no piece gets an edge of its byte
pieces, a word's edges are grouped, and a fold over them by their ends keeps the best way to each place (Viterbi): the
highest sum of piece scores, then the fewest pieces, then the longest last one. These words make a dictionary of proven
size. Texts are then read once, where they lie: words of the dictionary are looked up, and the lattices of the other words
(an eighth of the occurrences, most of them unique) are joined and folded in the task that meets them, by the same rule,
all words of a batch at once. Sending those
words, their ids and the texts to each other instead would shuffle more than the input.

The path is the best one over the model's scores. A model trained by byte-pair merging scores its pieces by merge rank;
merging itself may choose other pieces. Decoding gives the text back exactly either way.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Score of a character that is no piece, below that of any path of pieces.
UNKNOWN = -1e6
#: Bounds of the dictionary: its words, and the characters of a word. Results do not depend on them.
WORDS = 1 << 17
LETTERS = 32
#: Rows that a task takes at a time, other words that it folds together, and the longest word that is folded with others.
ROWS = 256
FOLDED = 4096
TOGETHER = 64
#: Multiplier of the rolling hash by which substrings find pieces before they are compared with them.
BASE = 0x9E3779B97F4A7C15


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score, bytes): the model's ordinary pieces with a space for their word mark, and its byte pieces
    (piece null). bytes: hexadecimal."""
    return spark.createDataFrame(pieces_of(path), "piece string, id int, score double, bytes string")


def pieces_of(path: str) -> list[tuple]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            rows.append((None, k, None, piece[3:5]))
        elif not model.is_control(k) and not model.is_unknown(k) and not model.is_unused(k):
            text = piece.replace("▁", " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {k} reaches over two words: {piece!r}")
            rows.append((text, k, float(model.get_score(k)), text.encode().hex().upper()))
    return rows


class Lattice:
    """The same lattice for words at hand: substrings joined to the pieces, edges by the place they end at, and the fold
    over these places, for many words at once; one word alone, of any length, in time linear in its length."""

    def __init__(self, rows: list[tuple]):
        self.known = {p: (score, k) for p, k, score, _ in rows if p is not None}
        self.bytes = {int(h, 16): k for p, k, _, h in rows if p is None}
        self.longest = max(map(len, self.known), default=1)
        self.score = np.array([score for score, _ in self.known.values()] or [0.0])
        self.id = np.array([k for _, k in self.known.values()] or [0], np.int32)
        letters = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.known]
        self.by_size = []
        self.seen = np.zeros(1 << 20, bool)
        for size in range(1, self.longest + 1):
            at = np.array([k for k, x in enumerate(letters) if len(x) == size], np.int64)
            spelled = np.array([letters[k] for k in at], np.uint32).reshape(-1, size)
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h = self._step(h, spelled[:, k])
            order = np.argsort(h)
            self.by_size.append((h[order], at[order], spelled[order]))
            self.seen[h >> np.uint64(44)] = True

    @staticmethod
    def _step(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return (h + letter + np.uint64(1)) * np.uint64(BASE)

    def _edges(self, flat: np.ndarray) -> list[np.ndarray]:
        """For each size, at each place, which piece begins there (its row, or -1)."""
        out, h = [], np.zeros(len(flat), np.uint64)
        for size, (hashes, rows, spelled) in enumerate(self.by_size, 1):
            n = len(flat) - size + 1
            found = np.full(len(flat), -1, np.int32)
            if n > 0:
                h = self._step(h[:n], flat[size - 1 :])
                at = np.flatnonzero(self.seen[h >> np.uint64(44)])
                if len(hashes) and len(at):
                    k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                    same = hashes[k] == h[at]
                    at, k = at[same], k[same]
                    for letter in range(size):
                        same = spelled[k, letter] == flat[at + letter]
                        if not same.all():
                            at, k = at[same], k[same]
                    found[at] = rows[k]
            out.append(found)
        return out

    def many(self, words: list[str]) -> list[bytes]:
        """The ids (32 bits each) of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] <= TOGETHER) & (sizes[order] > 0)]
        out = [b""] * len(words)
        for k in np.flatnonzero(sizes > TOGETHER):
            out[k] = np.array(self.ids(words[k]), np.int32).tobytes()
        if not len(order):
            return out
        flat = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le"), np.uint32)
        size = sizes[order]
        start = np.cumsum(size) - size
        edges = self._edges(flat)
        width = 1 + (flat >= 0x80).astype(np.int32) + (flat >= 0x800) + (flat >= 0x10000)
        best = np.zeros((size[0] + 1, len(size)))
        count = np.zeros(best.shape, np.int32)
        last = np.zeros(best.shape, np.int64)
        for e in range(1, size[0] + 1):
            n = np.searchsorted(-size, -e, "right")  # words that are so long
            top, few, back = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, np.int64)
            for length in range(min(e, self.longest), 0, -1):
                at = start[:n] + (e - length)
                piece = edges[length - 1][at]
                some = piece >= 0
                score, pieces = best[e - length, :n] + np.where(some, self.score[piece], UNKNOWN if length == 1 else -np.inf), count[e - length, :n] + (1 if length > 1 else np.where(some, 1, width[at]))
                better = (score > top) | (score == top) & (pieces < few)
                top[better], few[better], back[better] = score[better], pieces[better], length
            best[e, :n], count[e, :n], last[e, :n] = top, few, back
        # Back from each word's end; the steps of a word are put in order at last.
        word, at = np.arange(len(size)), size.copy()
        steps = []
        while len(word):
            length = last[at, word]
            at = at - length
            place = start[word] + at
            code = np.empty(len(word), np.int64)
            for k in np.unique(length):
                code[length == k] = edges[k - 1][place[length == k]]
            code = np.where(code >= 0, self.id[code], -1 - flat[place].astype(np.int64))
            steps.append((word, at, code))
            word, at = word[at > 0], at[at > 0]
        word, at, code = (np.concatenate(x) for x in zip(*steps, strict=True))
        code = code[np.argsort(word * (TOGETHER + 1) + at)]
        total = count[size, np.arange(len(size))]
        if (code < 0).any():
            spelled = {c: [self.bytes[b] for b in chr(-1 - c).encode()] for c in np.unique(code[code < 0]).tolist()}
            ids = np.array([k for c in code.tolist() for k in (spelled[c] if c < 0 else (c,))], np.int32)
        else:
            ids = code.astype(np.int32)
        blob, ends = ids.tobytes(), (np.cumsum(total) * 4).tolist()
        for k, s, e in zip(order.tolist(), [0, *ends], ends, strict=False):
            out[k] = blob[s:e]
        return out

    def ids(self, word: str) -> list[int]:
        known, longest = self.known, self.longest
        best, count, start, last = [0.0], [0], [0], [None]
        for e in range(1, len(word) + 1):
            at = None
            for s in range(max(0, e - longest), e):
                edge = known.get(word[s:e])
                if edge:
                    score, pieces, ids = best[s] + edge[0], count[s] + 1, edge[1]
                elif s == e - 1:
                    ids = [self.bytes[b] for b in word[s:e].encode()]
                    score, pieces = best[s] + UNKNOWN, count[s] + len(ids)
                else:
                    continue
                if at is None or score > at[0] or score == at[0] and pieces < at[1]:
                    at = score, pieces, s, ids
            for to, x in zip((best, count, start, last), at, strict=True):
                to.append(x)
        out, e = [], len(word)
        while e:
            out += last[e][::-1] if isinstance(last[e], list) else [last[e]]
            e = start[e]
        return out[::-1]


def words_of(text):
    """The words of a text column, their spaces (all at the start) included; an empty text has none."""
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(" "), text), "(?<! )(?= )")).otherwise(F.array().cast("array<string>"))


def encode_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word) -> (word, ids), words being distinct and of bounded length."""
    ordinary = pieces.where("piece is not null").select("piece", "id", "score")
    byte_ids = pieces.where("piece is null").agg(F.array_sort(F.collect_list(F.struct("bytes", "id"))).alias("all")).first()["all"]
    first = byte_ids[0]["id"] if byte_ids else 0
    longest = ordinary.agg(F.max(F.length("piece"))).first()[0] or 1
    cut = words.withColumn("n", F.length("word")).select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    cut = cut.select("word", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("size"))
    cut = cut.withColumn("sub", F.expr("substring(word, s + 1, size)"))
    joined = cut.join(F.broadcast(ordinary), F.col("sub") == F.col("piece"), "left").where("id is not null or size = 1")
    in_bytes = F.expr(f"transform(sequence(0, octet_length(sub) - 1), k -> cast(conv(substring(hex(encode(sub, 'UTF-8')), 2 * k + 1, 2), 16, 10) as int) + {first})")
    edge = F.struct(
        (F.col("s") + F.col("size")).alias("e"), F.col("s").alias("s"), F.coalesce("score", F.lit(UNKNOWN)).alias("score"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(in_bytes).alias("ids"),
    )
    edges = joined.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # best[k]: the best way to place k, as its score, number of pieces, last edge's start and ids.
    fold = """aggregate(edges, array(named_struct('score', 0D, 'n', 0, 's', 0, 'ids', cast(array() as array<int>))), (best, x) ->
        case when size(best) <= x.e then
            concat(best, array(named_struct('score', best[x.s].score + x.score, 'n', best[x.s].n + size(x.ids), 's', x.s, 'ids', x.ids)))
        when best[x.s].score + x.score > best[x.e].score or best[x.s].score + x.score = best[x.e].score and best[x.s].n + size(x.ids) < best[x.e].n then
            concat(slice(best, 1, x.e), array(named_struct('score', best[x.s].score + x.score, 'n', best[x.s].n + size(x.ids), 's', x.s, 'ids', x.ids)))
        else best end)"""
    back = """aggregate(reverse(sequence(1, size(best) - 1)), named_struct('at', size(best) - 1, 'ids', cast(array() as array<int>)), (acc, k) ->
        if(k = acc.at, named_struct('at', best[k].s, 'ids', concat(best[k].ids, acc.ids)), acc), acc -> acc.ids)"""
    return edges.select("word", F.expr(fold).alias("best")).select("word", F.expr(back).alias("ids"))


def commonest(texts: DataFrame, words: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """(word) at most ``words`` words of at most ``letters`` characters: those that occur so often that no more do. The bar
    is found from how many words have each count, in bins an eighth of a doubling wide."""
    every = texts.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") <= letters)
    counts = common.save(every.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").withColumn("bin", F.floor(F.log2("n") * 8).cast("int")))
    left, bar = words, None
    for r in counts.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        left -= r["count"]
        if left < 0:
            break
        bar = r["bin"]
    return counts.where(F.col("bin") >= bar).select("word") if bar is not None else counts.where("false").select("word")


def dictionary(texts: DataFrame, path: str, words: int = WORDS) -> dict[str, bytes]:
    """Words and their ids (32 bits each) of the commonest words. Dealt to tasks of some thousand words, the edges of a
    task are grouped in memory, without Spark's fall back to sorting all of them on disk."""
    spark = texts.sparkSession
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    some = commonest(texts, words)
    dealt = some.repartition(max(1, ceil(words / 8192)), "word")
    spark.conf.set(name, str(1 << 20))
    try:
        known = encode_words(dealt, piece_table(spark, path)).collect()
    finally:
        spark.conf.set(name, before)
    return {r.word: np.array(r.ids, np.int32).tobytes() for r in known}


def encode(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """(doc_id, ids) of every row. A null text counts as empty and has no ids; null and repeated ids stay row by row;
    other columns are not looked at; an empty table gives an empty result. A word of any length (a text without a space, a
    run of spaces) takes time in proportion."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((dictionary(rows, path, words), pieces_of(path)))

    def run(batches):
        known, table = shared.value
        lattice, cut = Lattice(table), re.compile(" *[^ ]+| +").findall
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                words = [cut(" " + t) if t else () for t in part.column(1).to_pylist()]
                other = list({w for row in words for w in row}.difference(known))
                here = {}
                for k in range(0, len(other), FOLDED):
                    here.update(zip(other[k : k + FOLDED], lattice.many(other[k : k + FOLDED]), strict=True))
                blobs = [b"".join([known[w] if w in known else here[w] for w in row]) for row in words]
                ends = np.cumsum([0, *map(len, blobs)]) // 4
                ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text) of every row, further columns kept; null ids count as none; ids that are no pieces
    are left out, as is what is not UTF-8 (U+FFFD stands for it)."""
    rows = pieces_of(path)
    spelled = [b""] * (max((k for _, k, _, _ in rows), default=0) + 2)
    for _, k, _, h in rows:
        spelled[k] = bytes.fromhex(h)
    sizes = np.array([len(x) for x in spelled], np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(spelled), np.uint8), sizes, np.cumsum(sizes) - sizes))
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches):
        letters, sizes, begin = shared.value
        for b in batches:
            for first in range(0, len(b), ROWS):
                part = b.slice(first, ROWS)
                column = part.column(at)
                ids = column.flatten().to_numpy(zero_copy_only=False)
                ids = np.where((ids >= 0) & (ids < len(sizes)), ids, len(sizes) - 1).astype(np.int64)  # the last one spells nothing
                width = sizes[ids]
                ends = np.cumsum(width)
                flat = letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[ids] - (ends - width), width)].tobytes()
                bounds = np.r_[0, ends][np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())]].tolist()
                texts = [flat[s:e].removeprefix(b" ").decode("utf-8", "replace") for s, e in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    out = encoded.mapInArrow(run, f"{kinds}, `{to}` string")
    return out if names != ["doc_id", ids_col] else out.select("doc_id", to)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    path = default_path()
    coded = encode(common.table(spark, sf_dir, "documents"), path).withColumn("n_pieces", F.size("ids"))
    out = decode(coded, path, to="back")
    return out.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256"))

"""Best-fit packing of tokenised texts into sequences.

A text becomes its token ids (``tokenizers``, byte-level BPE) and one closing id, so a null or empty text is one
token long. Only texts longer than a sequence are cut: every piece but the first is exactly as long as a
sequence, the first has the rest. Pieces of one row are numbered from 0; nothing is dropped.

Packing is hierarchical. Each task packs the pieces of its rows best-fit, longest first, and is done with the
sequences that are nearly full. The others, as they are, are the items of the next round, which has an eighth of
the tasks, and so on until a round has one task; it gets what eight tasks could not fill. Each round is
written before the next reads it, so a task that runs again sees the same items. Rows that repeat are packed
like others; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import words
from leafmill.session import materialise, shared_folder

LENGTH = 2048
CLOSING = 0
FAN_IN = 8
#: A sequence with at most so many free places is done.
SLACK = 4


class ByteLevelIds:
    """Ids of whole texts. Every distinct word goes through the library's model once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, words.byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = words.WordIds(self._word)

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in words.slices(texts, words.PIECE):
            part = texts[a:b]
            odd = {i for i, t in enumerate(part) if not words.same_classes(t) or any(x in t for x in self.added)}
            plain = iter(self._plain([t for i, t in enumerate(part) if i not in odd]))
            for i, t in enumerate(part):
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else next(plain)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points, bounds = words.code_points(joined), words.bounds_of(texts)
        begin = np.flatnonzero(words.words_with_spaces(points, bounds))
        return self.known.texts(joined, points, bounds, begin, np.append(begin[1:], len(points)))


@cache
def ids_of(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    if n <= length:
        return [(0, n)]
    head = n % length or length
    return [(0, head)] + [(s, length) for s in range(head, n, length)]


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Longest first, each item into the fullest bin that still takes it. Items of one size are in input order."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free places, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(free, (size, -1))
        if k == len(free):
            bins.append([i])
            left, which = length - size, len(bins) - 1
        else:
            left, which = free.pop(k)
            bins[which].append(i)
            left -= size
        if left:
            insort(free, (left, which))
    return bins


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"
#: Rows of a bin that a round can still fill: its fill and whether it is done.
_MOVES = "bin bigint, parent bigint, shift bigint, fill bigint"


def _cut_and_pack(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, numbers, starts, sizes, sums = ids_of(path), [], [], [], [], []
        for batch in words.pieces(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for doc, found in zip(batch.column(0).to_pylist(), ids(texts), strict=True):
                full = np.append(found, np.uint32(CLOSING)).astype("<u4")
                for k, (s, n) in enumerate(pieces(len(full), length)):
                    docs.append(doc)
                    numbers.append(k)
                    starts.append(s)
                    sizes.append(n)
                    sums.append(crc32(full[s : s + n].tobytes()))
        if not docs:
            return
        size = np.array(sizes, np.int64)
        bins, offsets, fills = [0] * len(docs), [0] * len(docs), [0] * len(docs)
        first = TaskContext.get().partitionId() << 36  # the same names if the task runs again
        for name, members in enumerate(best_fit(size, length), first):
            at, total = 0, int(size[members].sum())
            for i in members:
                bins[i], offsets[i], fills[i] = name, at, total
                at += sizes[i]
        table = pa.table([docs, numbers, starts, sizes, sums, bins, offsets, fills], schema=PIECES)
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _merge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b, f) for batch in batches for b, f in zip(batch["bin"].to_pylist(), batch["fill"].to_pylist(), strict=True)]
        if not rows:
            return
        rows.sort()
        fill = np.array([f for _, f in rows], np.int64)
        out: list[tuple] = []
        for members in best_fit(fill, length):
            at, total, parent = 0, int(fill[members].sum()), rows[members[0]][0]
            for i in members:
                out.append((rows[i][0], parent, at, total))
                at += rows[i][1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4, strict=True)],
            names=["bin", "parent", "shift", "fill"])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = materialise(rows.mapInArrow(_cut_and_pack(path, length), _DDL), "pieces")
    spark = docs.sparkSession
    # one row per bin that can still take something: its first piece stands for it
    left = packed.where((F.col("offset") == 0) & (F.col("fill") < length - SLACK)).select("bin", "fill")
    # the number of the task that made a bin is in its name
    moves, tasks = None, (packed.agg(F.max(F.shiftright("bin", 36)).alias("task")).first().task or 0) + 1
    while True:
        tasks = -(-tasks // FAN_IN)
        folder = shared_folder(spark, "packing-round")
        left.coalesce(tasks).mapInArrow(_merge(length), _MOVES).write.parquet(folder)
        done = spark.read.schema(_MOVES).parquet(folder)
        moves = done if moves is None else (
            moves.alias("a").join(done.alias("b"), F.col("a.parent") == F.col("b.bin"), "left")
            .select("a.bin", F.coalesce("b.parent", "a.parent").alias("parent"),
                    (F.col("a.shift") + F.coalesce("b.shift", F.lit(0))).alias("shift"),
                    F.coalesce("b.fill", "a.fill").alias("fill")))
        if tasks == 1:
            break
        left = done.where((F.col("shift") == 0) & (F.col("parent") == F.col("bin")) & (F.col("fill") < length - SLACK)).select("bin", "fill")
    return (
        packed.join(moves.select("bin", "parent", "shift"), "bin", "left")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))

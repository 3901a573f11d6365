"""Quality of texts by supervised subword embeddings.

The features of a text are its words (runs without white space) and the character n-grams of its words, with the
blank around a word as its border, and one sign for a word that is the same as the word before; each is hashed to a row of a table of learned vectors. A text is the mean of
its vectors, and a softmax over two classes of a linear map of that mean is its score. Vectors and map are
trained by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows: at most
``rows`` rows and ``characters`` characters, in the order of a hash of the id; a text that does not fit into what is left is
passed over, and those after it still count. Scores are then plain sums: the
map of every vector is one number, so a worker holds one number per hash bucket (2 MB by default).

A null or empty text has no features and gets the score of the bias alone. Labels that are null, or not 0 or 1, are
not used; of several labels of an id the smallest counts, and of several texts the largest. Without any labelled row every
score is 0.5. Scores do not depend on any column but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import words
from leafmill.session import materialise

BITS = 18
GRAMS = (3, 4)
_STEP, _LAST = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
SAMPLE_ROWS = 4000
SAMPLE_CHARACTERS = 12_000_000


def features(texts: list[str], bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of a slice, and the text it is of."""
    points = words.code_points(" ".join(["", *texts, ""]))  # a blank before and after each text
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    space = words.classes(points) == words.SPACE
    letters = np.where(space, 32, points).astype(np.uint64)
    text = np.append(np.repeat(np.arange(len(texts)), lengths), len(texts) - 1)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[::2], edge[1::2]  # the first and the last place are blanks
    word = words.word_hashes(points, begin, end)
    same = np.flatnonzero((word[1:] == word[:-1]) & (text[begin[1:]] == text[begin[:-1]])) + 1
    found = [word >> np.uint64(64 - bits), np.full(len(same), 1, np.uint64)]
    of = [text[begin], text[begin[same]]]
    for n in grams:
        # a window may have a blank at either end, not inside; it is of the text that its second place is of
        size = len(points) - n + 1
        total, inside = np.zeros(max(0, size), np.uint64), np.zeros(max(0, size), bool)
        for k in range(n if size > 0 else 0):
            total = total * _STEP + letters[k : k + size]
            if 0 < k < n - 1:
                inside |= space[k : k + size]
        at = np.flatnonzero(~inside)
        found.append((total[at] ^ np.uint64(n)) * _LAST >> np.uint64(64 - bits))
        of.append(text[at + 1])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def train(texts: list[str], labels: list[int], bits: int = BITS, dim: int = 16, epochs: int = 12, rate: float = 0.5,
          seed: int = 7) -> np.ndarray:
    """One number per bucket and, at the end, the bias: the difference of the two classes' logits."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for a, b in words.slices(texts):
        bucket, text = features(texts[a:b], bits)
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(b - a + 1))
        for k in range(b - a):
            own, times = np.unique(bucket[order[cut[k] : cut[k + 1]]], return_counts=True)
            rows.append((own, (times / max(1, times.sum())).astype(np.float32), labels[a + k]))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            own, weight, label = rows[i]
            mean = weight @ vectors[own]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            step = rate * (1 - done / steps)
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * p
            # a mean spreads its gradient thin over many vectors; scale it back up to one vector's share
            vectors[own] -= (step * weight / max(float(weight.max(initial=0)), 1e-6))[:, None] * back
            done += 1
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]).astype(np.float32)


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, rows: int, characters: int) -> DataFrame:
    # only labels of documents with a text can teach
    named = materialise(
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).where(usable)
        .groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
        .join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), "labelled")
    total = named.count()
    share = min(1.0, (1.5 * rows + 1000) / max(1, total))
    few = named.where(F.pmod("place", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("place").limit(rows)
    texts = materialise(docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.first("label").alias("label"), F.first("place").alias("place")).where("text IS NOT NULL"), "sample")
    fits, left = [], characters  # of at most ``rows`` ids
    for r in texts.select("doc_id", F.char_length("text").alias("n")).orderBy("place", "doc_id").collect():
        if r.n <= left:
            fits.append((r.doc_id,))
            left -= r.n
    chosen = docs.sparkSession.createDataFrame(fits, texts.select("doc_id").schema)
    return texts.join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None,
        rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS) -> np.ndarray:
    """Train on documents with a label whose id is ``usable``; the sample is read by one task."""
    sample = _sample(docs.select("doc_id", "text"), labels, label_col, F.lit(True) if usable is None else usable, rows, characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([train(texts, marks).tobytes()])], names=["model"])

    models = [r.model for r in sample.coalesce(1).mapInArrow(run, "model binary").collect()]
    return np.frombuffer(models[0], np.float32) if models else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row."""
    bits = (len(model) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bias = model[:-1].astype(np.float64), float(model[-1])
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in words.slices(texts):
                bucket, text = features(texts[a:b], bits)
                sums = np.bincount(text, part[bucket], b - a)
                p = 1 / (1 + np.exp(-np.clip(sums / np.maximum(1, np.bincount(text, minlength=b - a)) + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")

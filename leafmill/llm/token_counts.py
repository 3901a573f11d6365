"""Token counts of texts under a unigram model, with one dynamic programme for all words that share a prefix.

A word (a run without white space, with the vocabulary's blank sign before it) is split into the pieces whose
scores add up to the most; of equal sums the split with fewer pieces wins. The pieces come from a public
sentencepiece file. Such a file ranks its pieces; by Zipf's law the piece of rank r scores -ln(r + 1). A
character that no piece has falls back to its bytes, each one token with the score of the last rank.

The new words of a slice of texts are put in order, which walks their trie depth first: the scores up to the
prefix that a word shares with the one before are on the path already, only the places below it are
computed, and the count at the word's last place is stored for that word. Memory holds one path and the counts of known
words; a worker that knows too many words forgets them and goes on.

A null text counts as empty and has no words and no tokens; repeated rows are counted like others; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import words

BLANK = "▁"


class UnigramCounter:
    """Tokens and log score of words."""

    def __init__(self, scores: dict[str, float], byte_score: float, kept: int = words.KEPT_WORDS):
        self.scores, self.byte_score, self.kept = scores, byte_score, kept
        self.longest = max(map(len, scores), default=1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts: list[int] = []
        self.totals: list[float] = []

    def _place(self, word: str, at: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """The best (score, -tokens) of word[:at], given those of all shorter prefixes."""
        scores, n = self.scores, len(word[at - 1].encode("utf-8", "surrogatepass"))
        top = (best[at - 1][0] + n * self.byte_score, best[at - 1][1] - n)
        for start in range(max(0, at - self.longest), at):
            score = scores.get(word[start:at])
            if score is not None:
                here = (best[start][0] + score, best[start][1] - 1)
                if here > top:
                    top = here
        return top

    def learn(self, new: list[str]) -> None:
        path: list[tuple[float, int]] = [(0.0, 0)]
        last = ""
        for word in sorted(new):
            piece = BLANK + word
            del path[len(commonprefix((last, piece))) + 1 :]
            for at in range(len(path), len(piece) + 1):
                path.append(self._place(piece, at, path))
            self.known[word] = len(self.counts)
            self.totals.append(path[-1][0])
            self.counts.append(-path[-1][1])
            last = piece

    def numbers(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.kept:
            self._forget()
        out = list(map(self.known.get, found))
        if None in out:
            self.learn([w for w, k in zip(found, out, strict=True) if k is None])
            out = list(map(self.known.get, found))
        return np.array(out, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and log score of each text of a slice."""
        joined = "".join(texts)
        if not joined:
            zero = np.zeros(len(texts), np.int64)
            return zero, zero, zero.astype(float)
        points, bounds = words.code_points(joined), words.bounds_of(texts)
        space = (words.classes(points) == words.SPACE).astype(np.uint8)
        begin = np.flatnonzero(words.run_starts(space, bounds))
        end = np.append(begin[1:], len(points))
        real = space[begin] == 0
        begin, end = begin[real], end[real]
        if not len(begin):
            zero = np.zeros(len(texts), np.int64)
            return zero, zero, zero.astype(float)
        first, kind = words.distinct_words(points, begin, end)
        number = self.numbers([joined[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
        text = np.searchsorted(bounds, begin, "right") - 1
        # the last text that begins at a place is the one that has it: empty texts before it have no words
        tokens, scores = np.array(self.counts, np.int64)[number][kind], np.array(self.totals)[number][kind]
        n = len(texts)
        return (np.bincount(text, minlength=n), np.bincount(text, tokens, n).astype(np.int64), np.bincount(text, scores, n))


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """The pieces of a sentencepiece file with their scores, and the score of a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = sorted(own, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(ranked)}, -math.log(len(ranked) + 2)


@cache
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(*zipf_scores(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, log_score (of the best split of the whole text), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in words.slices(texts):
                n_words, n_tokens, score = own.texts(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score)],
                    names=["doc_id", "n_words", "n_tokens", "log_score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, log_score double")

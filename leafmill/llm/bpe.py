"""Exact byte-pair encoding without merging: the last token of every prefix.

The tokens that end at a place of a word come from an automaton over the vocabulary. Of these, exactly one is
the last token of the encoded prefix: the one that fits the last token of the prefix before it. Two tokens fit
if no merge across their border would have come before the merges that made them. Following the last tokens
back from the end of the word gives the ids. Each distinct word is encoded once per worker.

A text is cut into words as the vocabulary's own file says (NFC, lower case, letters, single digits, other
signs); texts with rare characters are cut by the library itself, so that new versions of the Unicode tables
cannot matter. Special tokens written out in a text become their ids. A null text counts as empty and has no
ids; repeated rows are encoded like others; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.llm import words

_NEVER = 1 << 60
#: Pairs of tokens whose test a worker keeps.
KEPT_PAIRS = 2_000_000
#: Ends a word; no byte is shown as it.
_END = "\n"


class PrefixEncoder:
    """Ids of one word of a vocabulary with merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        def own(token: str) -> str:
            return token.removesuffix(end) + _END if end and token.endswith(end) else token

        ids = {own(t): i for t, i in vocab.items()}
        self.end = _END if end else ""
        pairs = [(own(a), own(b)) for a, b in merges]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        size = max(ids.values()) + 1
        #: When a token is made, and of which two; -1 for those that no merge makes.
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        made = {i for t, i in ids.items() if len(t.removesuffix(_END)) == 1}
        for r, (a, b) in enumerate(pairs):
            token = ids[a + b]
            if token not in made and ids[a] in made and ids[b] in made and self._fits(ids[a], ids[b], r):
                made.add(token)
                self.born[token], self.left[token], self.right[token] = r, ids[a], ids[b]
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if i in made:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _fits(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a and b stay apart. Goes back in time: the later made of the two tokens at the border is
        taken apart; a pair seen on the way would merge if its rank comes before what ends either of them
        (of equal ranks, the left one comes first)."""
        rank, born = self.rank, self.born
        a_ends = b_ends = before
        while True:
            r = rank.get((a, b))
            if r is not None and r < a_ends and r <= b_ends:
                return False
            if born[a] > born[b]:
                a, a_ends = self.right[a], born[a]
            elif born[b] >= 0:
                b, b_ends = self.left[b], born[b]
            else:
                return True

    def __call__(self, word: str) -> list[int]:
        """``word`` in byte letters, without its end."""
        text = word + self.end
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        pairs = self.pairs
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        for at, (token, n) in self.automaton.iter(text):
            at += 1
            if last[at] >= 0:
                continue
            before = last[at - n]
            if at > n:
                if before < 0:
                    continue
                key = before << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._fits(before, token)
                if not fits:
                    continue
            last[at], size[at] = token, n
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids


class Codec:
    """Encodes and decodes texts with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        encoder = PrefixEncoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
                                model["end_of_word_suffix"] or "")
        self.letters = words.byte_letters()
        self.encoder = encoder
        self.known = words.WordIds(lambda w: encoder(w.encode().decode("latin-1").translate(self.letters)))
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None

    def _odd(self, text: str) -> np.ndarray:
        """A text with special tokens or rare characters; its parts are cut into words by the library."""
        ids: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    ids += self.encoder(word)  # the library gives words in byte letters
        return np.array(ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        odd = {i for i, t in enumerate(texts)
               if not words.same_classes(t) or "Σ" in t or any(x in t for x in self.special)}
        plain = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower() for i, t in enumerate(texts) if i not in odd]
        joined = "".join(plain)
        if joined:
            points, bounds = words.code_points(joined), words.bounds_of(plain)
            start, kind = words.words_without_spaces(points, bounds)
            begin = np.flatnonzero(start)
            end = np.append(begin[1:], len(points))
            real = kind[begin] != words.SPACE
            found = iter(self.known.texts(joined, points, bounds, begin[real], end[real]))
        else:
            found = iter([np.zeros(0, np.uint32)] * len(plain))
        return [self._odd(t) if i in odd else next(found) for i, t in enumerate(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: the tokens as they are written in it, with blanks between them."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _column(batch: pa.RecordBatch, k: int) -> list[str]:
    return ["" if t is None else t for t in batch.column(k).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = _column(batch, 1)
            for a, b in words.slices(texts):
                found = own.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in found], pa.int64()),
                           pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and the decoded text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))

"""Language of texts by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed against each
automaton: a phrase is the longest match from where the last one ended. The fewer phrases, the nearer the text
is to the language; phrases times the bits that name a place in the sample, per character, estimate the
cross entropy, and the language with the least wins (of equal ones, the first by name).

Texts are read in lower case; runs of anything but letters are one blank. Every letter of the sample is a symbol of its
own; a letter that no sample has is a phrase in every language. The sample is ``passages`` passages of
``length`` characters per language, from documents and places that hashes of the id choose; it bounds the automata (at
most two states a character) whatever the size of the corpus. Of more than ``most`` distinct languages, as in a column that holds
free text or ids, those with the most labelled rows are learned (of equal ones, the first by name). Whole texts are parsed, in blocks of BLOCK
characters that begin a phrase of their own; all blocks of a slice go through an automaton in step, one array
operation for all of them.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. The score
is the winner's share of likelihood among the languages. Rows with a null language, text or id teach nothing; repeated
rows are scored like others and may teach twice; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from leafmill.llm import words

UNKNOWN = "und"
#: Passages of a language and characters in each: the bound of the sample.
PASSAGES, PASSAGE_LENGTH = 400, 100
#: Languages that are learned: more than any usual list has.
LANGUAGES = 256
#: Moves of all languages together that are held as tables; if there are more, they are looked up among those that exist.
TABLES = 1 << 26
BLOCK = 256
_OTHER, _BLANK, _PAD, _FIRST = 0, 1, 2, 3
_NEW = 1 << 30


#: The next states, and 1 where a phrase begins, for states and the symbols they meet.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Moves of the automaton of all substrings, by state. State 0 is the empty string."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            target = moves[at][c]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(c) == target:
                    moves[at][c] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """The moves as a table, one row per state, -1 where there is none."""
    moves = automaton_moves(symbols)
    table = np.full((len(moves), size), -1, np.int32)
    for state, row in enumerate(moves):
        for c, target in row.items():
            table[state, c] = target
    return table


def parser(symbols: list[int], size: int) -> tuple[np.ndarray, int]:
    """Moves for parsing, and where a parse begins. Where a match ends, the next phrase begins with the same symbol, and
    the move is marked; a symbol that the sample lacks is a phrase. Targets are multiplied by ``size``, so that target + symbol is the
    next place to look."""
    table = suffix_automaton(symbols, size).astype(np.int64)
    begin = len(table)  # a state in which every symbol begins a phrase
    fresh = np.where(table[0] >= 0, table[0], begin) * size + _NEW
    out = np.vstack([np.where(table >= 0, table * size, fresh[None, :]), fresh])
    out[:, _PAD] = np.arange(begin + 1) * size
    return out.astype(np.int32).reshape(-1), begin * size


def table_step(symbols: list[int], size: int) -> tuple[Step, int]:
    """Parsing by a table of all moves, and the state in which it begins."""
    moves, begin = parser(symbols, size)

    def step(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = moves.take(state + row).astype(np.int64)
        return found & (_NEW - 1), found >> 30

    return step, begin


def search_step(symbols: list[int], size: int) -> tuple[Step, int]:
    """The same by a search among the moves that exist, at most three a character of the sample."""
    moves = automaton_moves(symbols)
    begin = len(moves)
    # the last one is beyond every place to look
    keys = np.array([state * size + c for state, row in enumerate(moves) for c in sorted(row)] + [(begin + 1) * size], np.int64)
    targets = np.array([row[c] for row in moves for c in sorted(row)] + [begin], np.int64)
    fresh = np.full(size, begin, np.int64)
    fresh[list(moves[0])] = list(moves[0].values())

    def step(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, stays = state * size + row, row == _PAD
        at = np.searchsorted(keys, key)
        goes = keys[at] == key
        return np.where(stays, state, np.where(goes, targets[at], fresh[row])), ~(goes | stays)

    return step, begin


@dataclass
class Languages:
    names: list[str]
    codes: dict[int, int]
    samples: list[list[int]]

    def __post_init__(self):
        self._parsers: list[tuple[np.ndarray, Step, int]] | None = None
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.names, self.codes, self.samples

    def __setstate__(self, state):
        self.names, self.codes, self.samples = state
        self.__post_init__()

    @property
    def size(self) -> int:
        return _FIRST + len(self.codes)

    @property
    def parsers(self) -> list[tuple[np.ndarray, Step, int]]:
        """For each language its own number of every symbol (letters that its sample lacks share one), the step and the first state."""
        if self._parsers is None:
            letters = [[c for c in sorted(set(s)) if c >= _FIRST] for s in self.samples]
            # an automaton has at most two states a character
            whole = sum(2 * (len(s) + 1) * (_FIRST + len(x)) for s, x in zip(self.samples, letters, strict=True)) <= TABLES
            self._parsers = []
            for sample, own in zip(self.samples, letters, strict=True):
                number = np.zeros(self.size, np.int64)
                number[:_FIRST] = range(_FIRST)
                number[own] = np.arange(_FIRST, _FIRST + len(own))
                self._parsers.append((number, *(table_step if whole else search_step)(number[sample].tolist(), _FIRST + len(own))))
        return self._parsers

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a slice without repeated blanks, and the text of each."""
        low = [t.lower() for t in texts]
        points = words.code_points("".join(low))
        kind = words.classes(points)
        if self._table is None:
            self._table = np.zeros(words.TABLE, np.int32)
            self._table[list(self.codes)] = list(self.codes.values())
        code = np.where(kind == words.LETTER, self._table[points], _BLANK)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in low])
        keep = np.ones(len(code), bool)
        keep[1:] = ~((code[1:] == _BLANK) & (code[:-1] == _BLANK) & (text[1:] == text[:-1]))
        return code[keep], text[keep]

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """Name and share of likelihood of each text of a slice."""
        has = [any(map(str.isalpha, t)) for t in texts]
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        code, text = self.symbols(texts)
        n = np.bincount(text, minlength=len(texts))
        per = -(-n // BLOCK)
        first = np.cumsum(per) - per
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        matrix = np.full((BLOCK, int(per.sum())), _PAD, np.int64)
        matrix[place % BLOCK, first[text] + place // BLOCK] = code
        of = np.repeat(np.arange(len(texts)), per)
        bits = np.empty((len(self.names), len(texts)))
        for k, (number, step, begin) in enumerate(self.parsers):
            state = np.full(matrix.shape[1], begin, np.int64)
            phrases = np.zeros(matrix.shape[1], np.int64)
            for row in matrix:
                state, new = step(state, number.take(row))
                phrases += new
            bits[k] = np.bincount(of, phrases, len(texts)) * np.log2(len(self.samples[k]) + 2)
        best = bits.argmin(axis=0)
        share = 1 / np.exp2(np.clip(bits.min(axis=0) - bits, -1000, 0)).sum(axis=0)
        return [(self.names[b], float(p)) if h else (UNKNOWN, 0.0) for b, p, h in zip(best, share, has, strict=True)]


def learn(docs: DataFrame, usable: Column, passages: int = PASSAGES, length: int = PASSAGE_LENGTH,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGES) -> Languages:
    """Automata of the languages of the ``usable`` rows. Brings at most ``most`` x passages x length characters to the driver."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("place"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    # only texts with a letter can teach, so only these are counted
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    # few enough rows by hash, then exactly the first ones
    share = F.least(F.lit(1.0), F.lit(4.0 * passages + 200) / F.col("n"))
    few = (
        rows.join(F.broadcast(counts), "lang").where(F.pmod("place", F.lit(1 << 20)) <= share * (1 << 20))
        .withColumn("start", F.pmod(F.xxhash64("place"), F.greatest(F.lit(1), F.char_length("text") - length + 1)).cast("int") + 1)
        .select("lang", "place", F.substr("text", "start", F.lit(length)).alias("text")))
    ranked = few.select("*", F.expr("row_number() OVER (PARTITION BY lang ORDER BY place, text)").alias("rank")).where(F.col("rank") <= passages)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "place", "text").collect():
        found.setdefault(row.lang, []).append(row.text.lower())
    every = sorted({ord(c) for texts in found.values() for t in texts for c in t})
    letters = [c for c in every if words.class_table()[c] == words.LETTER]
    languages = Languages([], {c: _FIRST + i for i, c in enumerate(letters)}, [])
    for name, texts in sorted(found.items()):
        symbols, _ = languages.symbols([" ".join(texts)])
        languages.names.append(name)
        languages.samples.append(symbols.tolist())
    return languages


def predict(docs: DataFrame, languages: Languages, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns of ``docs`` and the two named ones. A column of the same name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    rest = docs.drop(pred_col, score_col)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            for a, b in words.slices(texts, words.PIECE):
                found = shared.value.score(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=[*batch.schema.names, pred_col, score_col])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))

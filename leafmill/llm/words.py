"""Cut texts into words as arrays: a slice of texts is one array of code points, words are the runs between
starts, and equal words get one number, so that Python sees every distinct word of a slice once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

#: Code points of a slice; a longer text is a slice of its own.
SLICE = 1_000_000
#: The same, and rows that are read at once, where workers stay small: arrays of a few MB go back to the system when they are done.
PIECE, PIECE_ROWS = 2**18, 1024
#: Distinct words whose ids a worker keeps.
KEPT_WORDS = 400_000
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Above it, classes come from a table that not every library shares; see ``same_classes``.
COMMON = 0x558
#: Number of code points.
TABLE = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNCOMMON = regex.compile(rf"[^\u0000-\u{COMMON - 1:04x}‐-⁠]")


@cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    table, every = np.full(TABLE, OTHER, np.uint8), "".join(map(chr, range(TABLE)))
    for kind, form in ((DIGIT, r"\p{N}+"), (LETTER, r"\p{L}+"), (SPACE, r"\s+")):
        for run in regex.finditer(form, every):
            table[run.start() : run.end()] = kind
    return table


def same_classes(text: str) -> bool:
    """Whether every version of the Unicode tables puts the characters of ``text`` in the same classes."""
    return text.isascii() or not _UNCOMMON.search(text)


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into ranges of at most ``most`` code points, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, since texts take more room as Python's strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    return class_table()[points]


def bounds_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def run_starts(kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True where a run of one class begins; no run crosses a text's end."""
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[bounds[:-1][bounds[:-1] < len(kind)]] = True
    return start


def _clitics(points: np.ndarray, kind: np.ndarray, begins: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> None:
    """Move starts for 's 't 'm 'd 're 've 'll where ``begins`` says that an apostrophe opens a word."""
    at = np.flatnonzero(begins & (points == ord("'")))
    at = at[at + 1 < bounds[np.searchsorted(bounds, at, "right")]] if len(at) else at
    if not len(at):
        return
    n = len(points)
    ends = bounds[np.searchsorted(bounds, at, "right")]
    one, two = points[at + 1], np.where(at + 2 < ends, points[np.minimum(at + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    at, size, ends = at[size > 0], size[size > 0], ends[size > 0]
    start[at + 1] = False
    after = at + 1 + size
    start[after[after < ends]] = True  # where the rest of the letters, or the next run, goes on


def words_with_spaces(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of words that keep one blank before them; other white space is words too (all is covered)."""
    kind = classes(points)
    start = run_starts(kind, bounds)
    opens = start & (kind == OTHER)
    n = len(kind)
    stays = np.zeros(n, bool)
    stays[1:] = start[1:]
    stays[bounds[:-1][bounds[:-1] < n]] = False
    # the last white space before a word of the same text begins a word; a blank takes the word along
    next_word = np.flatnonzero(stays & (kind != SPACE))
    last = next_word - 1
    white = kind[last] == SPACE
    start[last[white]] = True
    glued = next_word[white & (points[last] == 32)]
    start[glued] = False
    opens[glued] = False
    _clitics(points, kind, opens, start, bounds)
    return start


def words_without_spaces(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of letters, of single digits and of runs of other signs; and the class of every place."""
    kind = classes(points)
    start = run_starts(kind, bounds)
    opens = start & (kind == OTHER)
    start |= kind == DIGIT
    _clitics(points, kind, opens, start, bounds)
    return start, kind


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return (np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of points[begin:end] for every word, from one running sum."""
    n = len(points)
    size = 1 << max(10, (n - 1).bit_length()) if n else 1024
    up, down = _powers(size) if size <= 4 * SLICE else _powers.__wrapped__(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one word of each kind, and the kind of every word."""
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


def distinct_words(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of the words themselves: those that only share the hash of another one get kinds of their own."""
    first, kind = distinct(word_hashes(points, begin, end))
    size, model = end - begin, first[kind]
    again = np.flatnonzero(model != np.arange(len(model)))
    other = size[again] != size[model[again]]
    same_size, n = again[~other], size[again[~other]]
    differs = points[spread(n, begin[same_size])] != points[spread(n, begin[model[same_size]])]
    wrong = again[other]
    if differs.any():
        wrong = np.append(wrong, np.unique(np.repeat(same_size, n)[differs]))
    if len(wrong):
        kinds: dict[bytes, int] = {}
        more = []
        for i in wrong.tolist():
            word = points[begin[i] : end[i]].tobytes()
            if word not in kinds:
                kinds[word] = len(first) + len(more)
                more.append(i)
            kind[i] = kinds[word]
        first = np.append(first, more)
    return first, kind


def spread(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices firsts[i] .. firsts[i] + lengths[i] - 1 for all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(firsts - (ends - lengths), lengths)


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary uses for each byte: itself if printable, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in shown else next(others) for b in range(256)}


class WordIds:
    """Ids of texts whose words are encoded one by one; ``ids_of`` sees a word again only after it was forgotten."""

    def __init__(self, ids_of: Callable[[str], list[int]], kept: int = KEPT_WORDS):
        self.ids_of, self.kept = ids_of, kept
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str]) -> None:
        n = len(self.known)
        if n + len(new) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(new), len(self.ends)), np.int64)])
        start = int(self.ends[n])
        for word in new:
            ids = self.ids_of(word)
            end = start + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat)), np.uint32)])
            self.flat[start:end] = ids
            self.known[word] = n
            n, start = n + 1, end
            self.ends[n] = end

    def _numbers(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.kept:
            self._forget()
        out = list(map(self.known.get, found))
        if None in out:
            self._learn([w for w, k in zip(found, out, strict=True) if k is None])
            out = list(map(self.known.get, found))
        return np.array(out, np.int64)

    def texts(self, joined: str, points: np.ndarray, bounds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice with the words begin..end."""
        first, kind = distinct_words(points, begin, end)
        number = self._numbers([joined[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
        size, where = (self.ends[number + 1] - self.ends[number])[kind], self.ends[number][kind]
        out = self.flat[spread(size, where)]
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, bounds)].tolist()
        return [out[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

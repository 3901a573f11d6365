"""Keyword extraction over a corpus: TF-IDF scores, two diversity selections, highlighting."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ranking import top_k

TOKEN = r"[\p{L}\p{N}_]{2,}"

# English function words that make no keyword.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could "
    "did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it "
    "its just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than "
    "that the their theirs them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours"
).split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop_words)) if stop_words else tokens


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return without_stop_words(words(text), stop_words)


#: Octets of text that one chunk of the corpus has about; the terms of a chunk are counted in the memory of one task.
CHUNK = 8 << 20
#: Scores that differ by no more may be the same after they are rounded.
NEAR = 2e-9


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """Small numbers, all their low octets first."""
    return _packed(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


class _Chunk:
    """The different terms of the texts of a chunk in the order of their octets, which is that of their words, as a blank comes
    before every character of a word; and how often each text has each of them."""

    def __init__(self, tokens: pa.ChunkedArray, ngram_range: tuple[int, int], parts: int):
        low, high = ngram_range
        lists = tokens.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).cast(pa.large_string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.words = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word = place[coded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
        many = len(order)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words from here to the end of the text
        row = np.repeat(np.arange(len(sizes)), sizes)
        word_hash = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in self.words.to_pylist()], np.uint64)

        # the terms of n words: the number of each place's term, and for each different term its words, -1 after the last one
        ids, different, hashes = word, np.arange(many)[:, None], word_hash
        found, tables, hashed = [], [], []
        for n in range(1, high + 1):
            if n > 1:
                at = np.flatnonzero(left >= n)
                pairs, at_pair = np.unique(ids[at] * many + word[at + n - 1], return_inverse=True)
                ids = np.zeros(len(ids), np.int64)
                ids[at] = at_pair
                first, last = (pairs // many, pairs % many) if many else (pairs, pairs)
                different = np.column_stack([different[first], last])
                hashes = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + word_hash[last]
            else:
                at = np.arange(len(word))
            if n >= low:
                found.append((row[at], ids[at]))
                tables.append(np.pad(different, ((0, 0), (0, high - n)), constant_values=-1))
                hashed.append(hashes)
        table = np.concatenate(tables)
        if (many + 1) ** high < 2**62:
            sorted_ = np.argsort(table @ (np.int64(many + 1) ** np.arange(high - 1, -1, -1)))
        else:
            sorted_ = np.lexsort(table.T[::-1])
        self.table, rank = table[sorted_], np.empty(len(table), np.int64)
        rank[sorted_] = np.arange(len(table))
        self.part = ((np.concatenate(hashed)[sorted_] >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        starts = np.cumsum([0, *map(len, tables)])
        self.size = max(len(table), 1)
        pairs = np.concatenate([rows * self.size + rank[start + ids] for (rows, ids), start in zip(found, starts[:-1], strict=True)])
        pairs, self.tf = np.unique(pairs, return_counts=True)
        self.row, self.term = pairs // self.size, pairs % self.size
        self.n = sum(np.maximum(sizes - (n - 1), 0) for n in range(low, high + 1))

    def strings(self, terms: np.ndarray, end: str = "") -> pa.Array:
        """The terms with these numbers; their words have no blanks."""
        columns = [self.words.take(pa.array(c, pa.int64(), mask=c < 0)) for c in self.table[terms].T]
        blank, nothing, end = (pa.scalar(x, pa.large_string()) for x in (" ", "", end))
        return pc.binary_join_element_wise(pc.binary_join_element_wise(*columns, blank, null_handling="skip"), end, nothing)

    def by_part(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms by part, and where each part begins and the last one ends."""
        order = np.argsort(self.part, kind="stable")
        return order, np.append(np.flatnonzero(np.diff(self.part[order], prepend=-1)), len(order))


def _terms_of_chunk(ngram_range: tuple[int, int], parts: int):
    def terms(chunk: pa.Table) -> pa.Table:
        """The different terms of a chunk and how many of its texts have them, one row for each part."""
        c = _Chunk(chunk["_words"], ngram_range, parts)
        order, bounds = c.by_part()
        lines, df = c.strings(order, "\n"), np.bincount(c.term, minlength=len(order))[order]
        offsets, text = (np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:], lines.buffers()[2]) if len(order) else (None, None)
        rows = [(int(c.part[order[a]]), _packed(text[int(offsets[a]):int(offsets[b])].to_pybytes()), _packed_numbers(df[a:b])) for a, b in pairwise(bounds)]
        part, packed, dfs = zip(*rows, strict=True) if rows else ((), (), ())
        number = [chunk["_chunk"][0].as_py()] * len(rows)
        return pa.table({"_part": pa.array(part, pa.int64()), "_chunk": pa.array(number, pa.int64()), "terms": pa.array(packed, pa.binary()), "dfs": pa.array(dfs, pa.binary())})

    return terms


def _frequencies(chunks: pa.Table) -> pa.Table:
    """For the terms that each chunk has in one part, in the chunk's order, how many texts of all chunks have them."""
    texts, own = [_unpacked(t.as_py()) for t in chunks["terms"]], [_unpacked_numbers(d.as_py()) for d in chunks["dfs"]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.flatnonzero(data == 10) + 1).astype(np.int64)
    del texts
    terms = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode().indices.to_numpy()
    total = np.bincount(terms, weights=np.concatenate(own)).astype(np.int64)[terms]
    ends = np.cumsum([len(o) for o in own])
    return pa.table({"_part": chunks["_part"], "_chunk": chunks["_chunk"], "dfs": pa.array([_packed_numbers(t) for t in np.split(total, ends[:-1])], pa.binary())})


def _scored_terms(key: str, ngram_range: tuple[int, int], parts: int, n_docs: int, best: int | None, apart: tuple[int, float] | None):
    def scored(chunk: pa.Table, dfs: pa.Table) -> pa.Table:
        """The terms of the texts of a chunk with what their scores are made of."""
        c = _Chunk(chunk["_words"], ngram_range, parts)
        order, _ = c.by_part()
        df = np.zeros(len(order), np.int64)
        if len(order):
            by_part = sorted(zip(dfs["_part"].to_pylist(), dfs["dfs"].to_pylist(), strict=True))
            df[order] = np.concatenate([_unpacked_numbers(d) for _, d in by_part])
        kept = np.arange(len(c.term))
        if len(kept) and (best is not None or apart is not None):
            kept = kept[_foremost(c, df, n_docs, best, apart, ngram_range[1])]
        row, term = c.row[kept], c.term[kept]
        return pa.table({
            key: chunk[key].combine_chunks().take(pa.array(row)), "term": c.strings(term).cast(pa.string()),
            "n": pa.array(c.n[row], pa.int64()), "tf": pa.array(c.tf[kept], pa.int64()), "df": pa.array(df[term], pa.int64())})

    return scored


def _foremost(c: _Chunk, df: np.ndarray, n_docs: int, best: int | None, apart: tuple[int, float] | None, high: int) -> np.ndarray:
    """Which pairs of a text and a term may be among the ``best`` of the text, or chosen by ``mmr_keywords`` with ``apart``.

    Scores of one text whose tf and df are the same are the same and go by the term. Where others come as near as rounding
    hides, their order is left to the exact scores and all of them are kept.
    """
    numbers, at = np.unique(df, return_inverse=True)
    idf = (np.log((1 + n_docs) / (1 + numbers)) + 1)[at]
    score = c.tf / c.n[c.row] * idf[c.term]
    order = np.lexsort((-score, c.row))  # stable: equal scores stay in the order of their terms
    row, s, tf, d = c.row[order], score[order], c.tf[order], df[c.term[order]]
    fresh = np.diff(row, prepend=-1) != 0
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(row))
    near = NEAR
    if best is not None:
        last = np.minimum(starts + best, ends) - 1
    else:
        top_n, diversity = apart
        # relevance is a share of the best score, which is at most that of a term that is its whole text
        near = NEAR * (1 + (math.log((1 + max(n_docs, 1)) / 2) + 1) / (1 - diversity))
        last = np.array([_last_apart(c.table, c.term, order, a, b, high * (top_n - 1) + 1) for a, b in zip(starts, ends, strict=True)])
    # runs of scores that are near each other, and whether a run has more than one pair of tf and df
    gap = fresh | (np.diff(s, prepend=0) < -near)
    run = np.cumsum(gap) - 1
    other = ~gap & ((np.diff(tf, prepend=0) != 0) | (np.diff(d, prepend=0) != 0))
    mixed = np.zeros(run[-1] + 1, bool)
    mixed[run[other]] = True
    text = np.cumsum(fresh) - 1
    keep = (np.arange(len(row)) <= last[text]) | ((run == run[last][text]) & mixed[run])
    return np.sort(order[keep])


def _last_apart(table: np.ndarray, term: np.ndarray, order: np.ndarray, start: int, end: int, enough: int) -> int:
    """The place where ``enough`` terms without a common word have been met.

    Every chosen term has ``high`` words at most, so ``high`` * (top_n - 1) + 1 such terms leave one that is like none
    of those chosen before; any later term is no more relevant than that one and is not chosen.
    """
    taken, met = set(), 0
    for i in range(start, end):
        words = [w for w in table[term[order[i]]].tolist() if w >= 0]
        if taken.isdisjoint(words):
            taken.update(words)
            met += 1
            if met == enough:
                return i
    return end - 1


def score_candidates(
    docs: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 2), stop_words: list[str] = STOP_WORDS,
    best: int | None = None, apart: tuple[int, float] | None = None,
) -> DataFrame:
    """``(key, term, score)``: share of the term in its text times ln((1 + N) / (1 + df)) + 1.

    The texts move once, into chunks of about ``CHUNK`` octets. Each chunk sends its different terms, sorted and packed, to the parts of
    the terms, where their document frequencies are added up; a part sends the numbers alone back to the chunk, in its order. So
    neither the terms of each text nor their strings move again. A row per key is expected; rows that share a key are texts of their own.

    With ``best`` the terms that cannot be among so many best ones of their text are left out, with ``apart`` (top_n and diversity)
    those that ``mmr_keywords`` cannot choose.
    """
    if best is not None and apart is not None:
        raise ValueError("best and apart exclude each other")
    if apart is not None and apart[1] >= 1:
        apart = None  # relevance has no weight, so any term may be chosen
    n_docs, octets = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # several chunks for each task, as tasks take chunks by their hashes
    parts = max(3 * docs.sparkSession.sparkContext.defaultParallelism, octets // CHUNK + 1)
    chunk = F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("bigint")
    # a table of few, large files would be cut into words by as many tasks
    chunks = docs.select(key, text, chunk.alias("_chunk")).repartition(parts, "_chunk").select("_chunk", key, tokens(F.col(text), stop_words).alias("_words"))
    found = chunks.groupBy("_chunk").applyInArrow(_terms_of_chunk(ngram_range, parts), "_part bigint, _chunk bigint, terms binary, dfs binary")
    freq = found.repartition(parts, "_part").groupBy("_part").applyInArrow(_frequencies, "_part bigint, _chunk bigint, dfs binary")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, term string, n bigint, tf bigint, df bigint"
    counts = chunks.groupBy("_chunk").cogroup(freq.repartition(parts, "_chunk").groupBy("_chunk")).applyInArrow(
        _scored_terms(key, ngram_range, parts, n_docs, best, apart), schema)
    idf = F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1
    return counts.select(key, "term", F.round(F.col("tf") / F.col("n") * idf, 9).alias("score"))


def top_keywords(scored: DataFrame, key: str, top_n: int = 10) -> DataFrame:
    return top_k(scored, [key], [F.desc("score"), F.col("term")], top_n)


class _Overlap:
    """Which terms hold a word, to compare a term with those only that share a word with it."""

    def __init__(self, terms: list[str]):
        self.words = [sorted(set(t.split(" "))) for t in terms]
        self.sizes = np.array([len(w) for w in self.words])
        self.holders: dict[str, list[int]] = {}
        for i, own in enumerate(self.words):
            for w in own:
                self.holders.setdefault(w, []).append(i)

    def similarity(self, i: int) -> np.ndarray:
        """Shared words over all words, of every term with term ``i``."""
        shared = np.zeros(len(self.words))
        for w in self.words[i]:
            shared[self.holders[w]] += 1
        return shared / (self.sizes + self.sizes[i] - shared)


def _chosen(scored: DataFrame, key: str, choose: Callable[[list[str], list[float]], list[int]]) -> DataFrame:
    """Per key the terms that ``choose`` picks, with their ranks. It is given the terms and scores, best first, and returns their places.

    All terms of a key come in one row, so that a batch of many keys takes one call of Python.
    """
    rows = scored.groupBy(key).agg(F.collect_list(F.struct("term", "score")).alias("_terms"))

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_terms")
            terms, scores = (pc.struct_field(lists.values, f) for f in ("term", "score"))
            at, picked, ranks, offsets = [], [], [], lists.offsets.to_pylist()
            for i, (start, end) in enumerate(pairwise(offsets)):
                own, points = terms.slice(start, end - start).to_pylist(), scores.slice(start, end - start).to_pylist()
                order = sorted(range(end - start), key=lambda j: (-points[j], own[j]))
                chosen = choose([own[j] for j in order], [points[j] for j in order])
                at += [i] * len(chosen)
                picked += [start + order[j] for j in chosen]
                ranks += range(1, len(chosen) + 1)
            picked = pa.array(picked, pa.int64())
            columns = [batch.column(key).take(pa.array(at, pa.int64())), terms.take(picked), scores.take(picked), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "score", "rank"])

    schema = f"{key} {scored.schema[key].dataType.simpleString()}, term string, score double, rank bigint"
    return rows.select(key, "_terms").mapInArrow(choices, schema)


def mmr_keywords(scored: DataFrame, key: str, top_n: int = 10, diversity: float = 0.7) -> DataFrame:
    """Greedy choice per document: relevance against likeness to the keywords chosen before.

    The candidates of a document are at most the terms of one text. Relevance is the score as a
    share of the document's best; likeness is the share of common words.
    """

    def choose(terms: list[str], scores: list[float]) -> list[int]:
        overlap = _Overlap(terms)
        relevance = np.array(scores) / scores[0]
        picked, free = [0], np.ones(len(terms), dtype=bool)
        free[0] = False
        likeness = overlap.similarity(0)
        while len(picked) < min(top_n, len(terms)):
            gain = np.round((1 - diversity) * relevance - diversity * likeness, 9)
            best = gain[free].max()
            # Equal gains go by the term.
            nxt = int(min(np.flatnonzero(free & (gain == best)), key=lambda i: terms[i]))
            picked.append(nxt)
            free[nxt] = False
            likeness = np.maximum(likeness, overlap.similarity(nxt))
        return picked

    return _chosen(scored, key, choose)


def maxsum_keywords(scored: DataFrame, key: str, top_n: int = 5, nr_candidates: int = 20) -> DataFrame:
    """Of the best ``nr_candidates`` terms of a document the ``top_n`` that are least alike together."""
    if top_n > nr_candidates:
        raise ValueError("top_n must not exceed nr_candidates")
    best = top_keywords(scored, key, nr_candidates)

    def choose(terms: list[str], scores: list[float]) -> list[int]:
        size = min(top_n, len(terms))
        overlap = _Overlap(terms)
        alike = np.array([overlap.similarity(i) for i in range(len(terms))])
        sets = _sets_of(len(terms), size)
        total = np.zeros(len(sets))
        for a, b in combinations(range(size), 2):
            total += alike[sets[:, a], sets[:, b]]
        return sets[int(np.argmin(np.round(total, 6)))].tolist()

    return _chosen(best, key, choose)


@lru_cache(maxsize=4)
def _sets_of(count: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(count), size)))


def highlight(text: Column, keywords: Column, mark: str = "**") -> Column:
    """Put ``mark`` around every occurrence of the keywords as whole words, whatever their case."""
    by_length = F.array_sort(keywords, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(by_length, lambda k: F.regexp_replace(k, r"([^\p{L}\p{N}_ ])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])("), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(keywords) > 0, F.regexp_replace(text, pattern, F.lit(f"{mark}$1{mark}"))).otherwise(text)

"""Removal of byte strings that repeat across texts, by suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts in a text with a smaller id. Strings are judged on the
input, whatever else is removed; overlaps count.

Suffixes are sorted where strings can repeat at all, in buckets that can be sorted apart. The anchor of a string is the
run of GRAM bytes in it with the least hash. Equal strings have equal anchors, at the same place in them, so

* a string whose anchor is in one text only is unique; tasks exchange the sorted hashes of their anchors to find
  the others (``_requests``, ``_replies``);
* the strings around one occurrence of an anchor are one piece of text, its context; equal contexts are sorted
  once, with the least id that has them;
* all strings with one anchor are in one bucket. Where an anchor has too many contexts for that, they are cut
  into the strings that reach further left and those that reach further right, whose common part is longer than the anchor;
  that ends at the latest when the common part is the string itself, of which there is one.

A bucket is sorted by the difference cover modulo 3: the suffixes at places 1 and 2 by triples of symbols, the names
of the triples recursively, the suffixes at places 0 by a symbol and the rank after it, then both are merged by rank. Strings that
start neighbouring suffixes are compared, equal ones are a class, and the least id of a class is compared with the ids of
all texts that have its contexts.

A copy of a whole text with a smaller id goes as a whole (if it has LENGTH bytes) and is not sorted. Ids are compared as
numbers, a null id is smaller than any other, and texts with the same id do not count against each other. A null text counts as empty; texts
shorter than LENGTH stay. Rows that repeat have the same result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import words
from leafmill.session import shared_folder

LENGTH = 50
#: Bytes of an anchor.
GRAM = 20
#: Bytes of text in a part, of hashes in an exchange, and of contexts in a bucket.
PART, EXCHANGE, BUCKET = 8_000_000, 8_000_000, 1_000_000
#: Contexts of one anchor that stay in one bucket.
MANY = 4000
_LEAST = -(1 << 63)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back. The driver's garbage goes then, and with it the shuffle files of the step."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*done: DataFrame) -> None:
    """Delete what ``written`` wrote, once the steps that read it are written themselves."""
    for df in done:
        jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


# ---- suffix sorting ----------------------------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> np.ndarray:
    """The number from 1 of each key among the different ones, in their order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    name = np.empty(len(keys), np.int64)
    name[order] = np.cumsum(new)
    return name


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (positive integers) by the difference cover {1, 2} modulo 3."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    # a place after the end is sampled too if n is 1 modulo 3, so that the names of the two kinds of places do not run together
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    high = int(s.max()) + 1
    if high < 1 << 20:
        name = _names((s[sample] * high + s[sample + 1]) * high + s[sample + 2])
    else:
        name = _names(_names(s[sample] * high + s[sample + 1]) * high + s[sample + 2])
    if name.max() < len(sample):
        sorted_sample = sample[suffix_array(name)]
    else:
        sorted_sample = sample[np.argsort(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    wide = n + 4
    zero = zero[np.argsort(s[zero] * wide + rank[zero + 1])]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    # how many sampled suffixes come before each other one: compared by as many symbols as lead both to sampled places
    before = np.searchsorted(s[first] * wide + rank[first + 1], s[zero] * wide + rank[zero + 1])
    pair = s[:-1] * high + s[1:]
    if high * high * wide >= 1 << 62:
        pair = _names(pair)  # two symbols and a rank have to fit in a word
    before += np.searchsorted(pair[second] * wide + rank[second + 2], pair[zero] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = sorted_sample
    return out


def equal_strings(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the suffixes there, and where in that order a new string of ``length`` symbols begins."""
    valid = np.zeros(len(symbols), bool)
    valid[starts] = True
    order = suffix_array(symbols)
    order = order[valid[order]]
    same = np.arange(1, len(order))
    for k in range(length):
        same = same[symbols[order[same] + k] == symbols[order[same - 1] + k]]
    new = np.ones(len(order), bool)
    new[same] = False
    return order, new


# ---- anchors -----------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one occurrence of an anchor: text, first string, number of strings, place and hash of the anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n = len(data) - gram + 1
    width = length - gram + 1
    if n < width:
        return none
    at = np.arange(n)
    hashes = words.word_hashes(data, at, at + gram)
    # hash above, place below: the least is the least hash, of equal ones the first place
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    string = np.flatnonzero(np.arange(len(place)) + length <= bounds[text + 1])
    if not len(string):
        return none
    place, text = place[string], text[string]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    return text[new], string[new], np.diff(np.append(new, len(string))), place[new], words.mixed(hashes[place[new]])  # least hashes are small: mix them again


def _byte_slices(texts: list[bytes], most: int = 1_500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    start, size = 0, 0
    for i, t in enumerate([*texts, None]):
        if i > start and (t is None or size + len(t) > most):
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts[start:i]])]).astype(np.int64)
            yield start, np.frombuffer(b"".join(texts[start:i]), np.uint8), bounds
            start, size = i, 0
        size += len(t or b"")


def _requests(length: int, gram: int, exchanges: int):
    """From each task: for each part and exchange the anchors' hashes, those in one text of the part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            parts = batch["part"].to_pylist()
            texts = [t.encode() for t in batch["text"].to_pylist()]
            for start, data, bounds in _byte_slices(texts):
                text, _, _, _, name = anchors(data, bounds, length, gram)
                cut = np.searchsorted(text, np.arange(len(bounds)))
                for k in range(len(bounds) - 1):
                    if cut[k] < cut[k + 1]:
                        found.setdefault(parts[start + k], []).append(np.unique(name[cut[k] : cut[k + 1]]))
        for part, names in found.items():
            every, times = np.unique(np.concatenate(names), return_counts=True)
            to = (every >> np.uint64(32)).astype(np.int64) * exchanges >> 32
            cut = np.searchsorted(to, np.arange(exchanges + 1)).tolist()
            full = [k for k in range(exchanges) if cut[k] < cut[k + 1]]
            once, more = [], []
            for k in full:
                here, n = every[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]
                once.append(here[n == 1].tobytes())
                more.append(here[n > 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(full), pa.int64()), pa.array(full, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                names=["part", "exchange", "once", "more"])

    return run


def _replies(table: pa.Table) -> pa.Table:
    """For each part of an exchange, those of its hashes that are in more than one text."""
    parts = table["part"].to_pylist()
    once = [np.frombuffer(x, np.uint64) for x in table["once"].to_pylist()]
    more = [np.frombuffer(x, np.uint64) for x in table["more"].to_pylist()]
    every, times = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
    repeated = every[times > 1]
    out: dict[int, list[np.ndarray]] = {}
    for part, a, b in zip(parts, once, more, strict=True):
        mine = np.concatenate([a, b])
        at = np.minimum(np.searchsorted(repeated, mine), max(0, len(repeated) - 1))
        out.setdefault(part, []).append(mine[repeated[at] == mine] if len(repeated) else mine[:0])
    return pa.table({"part": pa.array(list(out), pa.int64()), "names": pa.array([np.concatenate(x).tobytes() for x in out.values()], pa.binary())})


def _copies(notes: pa.Table, other: str) -> set[tuple[int, int]]:
    """The texts among the notes to a part that are copies of one with a smaller id."""
    return {(i, t) for i, t, x in zip(*(notes[c].to_pylist() for c in ("id", "text_id", other)), strict=True) if x is None}


_CONTEXTS = "name bigint, hash bigint, id bigint, text_id bigint, part bigint, start bigint, reach int, n int, context binary"


def _contexts(length: int, gram: int):
    """The contexts of repeated anchors in the texts of a part that are not copies. ``reach`` is the distance of the anchor from the
    first string's start, ``n`` the number of strings."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint64) for x in notes["names"].to_pylist() if x is not None]
        copies = _copies(notes, "names")
        repeated = np.unique(np.concatenate(names)) if names else np.zeros(0, np.uint64)
        rows = [(i, t, x.encode()) for i, t, x in zip(*(docs[c].to_pylist() for c in ("id", "text_id", "text")), strict=True) if (i, t) not in copies]
        columns: list[list] = [[] for _ in range(9)]
        for begin, data, bounds in _byte_slices([x for _, _, x in rows]) if len(repeated) else ():
            text, first, n, place, name = anchors(data, bounds, length, gram)
            at = np.minimum(np.searchsorted(repeated, name), len(repeated) - 1)
            keep = repeated[at] == name
            text, first, n, place, name = text[keep], first[keep], n[keep], place[keep], name[keep]
            end = first + n + length - 1
            hashes = words.word_hashes(data, first, end)
            whole = data.tobytes()
            columns[0] += name.view(np.int64).tolist()
            columns[1] += hashes.view(np.int64).tolist()
            columns[2] += [rows[begin + k][0] for k in text.tolist()]
            columns[3] += [rows[begin + k][1] for k in text.tolist()]
            columns[4] += [key[0].as_py()] * len(text)
            columns[5] += (first - bounds[text]).tolist()
            columns[6] += (place - first).tolist()
            columns[7] += n.tolist()
            columns[8] += [whole[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                    names=["name", "hash", "id", "text_id", "part", "start", "reach", "n", "context"])

    return run


def _halves(length: int, level: int, gram: int):
    """Cut contexts into the strings that reach further left of the anchor and the others. At level k the strings of a
    context lie in one of 2**k ranges of the distance between the string's start and the anchor; the name of a piece is the hash of
    what all strings of its range share."""
    span = 1 << (length - gram).bit_length()  # distances 0 .. length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = span >> level
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                first, last = r["reach"], r["reach"] - r["n"] + 1  # distances of the first and the last string
                for piece in range(first // width, last // width - 1, -1):
                    high, low = min(first, piece * width + width - 1), max(last, piece * width)
                    begin, n = first - high, high - low + 1
                    context = r["context"][begin : begin + n + length - 1]
                    # the latest start and the earliest end of the range's strings, as places in this context
                    a, b = high - piece * width, high - min(piece * width + width - 1, length - gram) + length
                    core = r["context"][begin + a : begin + b]
                    name = sha256(bytes([level, piece]) + core).digest()[:16]
                    out.append((int.from_bytes(name[:8], "little", signed=True), int.from_bytes(sha256(context).digest()[:8], "little", signed=True),
                                r["id"], r["text_id"], r["part"], r["start"] + begin, high, n, context))
            if out:
                kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=batch.schema.names)

    return run


def _sort_bucket(length: int):
    """For each context of a bucket a mask of its strings that also start in a text with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        # an anchor with one context has nothing to sort
        _, kind, times = np.unique(table["name"].to_numpy(), return_inverse=True, return_counts=True)
        table = table.filter(pa.array(times[kind.reshape(-1)] > 1))
        if not table.num_rows:
            return pa.table({"name": table["name"], "hash": table["hash"], "mask": pa.array([], pa.int64())})
        contexts, ids, n = table["context"].to_pylist(), table["id"].to_numpy(), table["n"].to_numpy()
        size = np.array([len(c) for c in contexts], np.int64)
        # a sign of its own ends each context; no string covers it
        data = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.int64) + 1
        begin = np.cumsum(size + 1) - size - 1
        data[begin + size] = 257
        starts = words.spread(n.astype(np.int64), begin)
        owner = np.zeros(len(data), np.int64)
        owner[starts] = np.repeat(np.arange(len(contexts)), n)
        order, new = equal_strings(data, starts, length)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[owner[order]], first)
        smaller = np.repeat(least, np.diff(np.append(first, len(order)))) < ids[owner[order]]
        hit = order[smaller]
        mask = np.zeros(len(contexts), np.int64)
        np.bitwise_or.at(mask, owner[hit], np.int64(1) << (hit - begin[owner[hit]]))
        return pa.table({"name": table["name"], "hash": table["hash"], "mask": mask})

    return run


def _cut(length: int):
    """The result row of each text of a part."""

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        found: dict[tuple, list[tuple[int, int]]] = {}
        copies = _copies(notes, "mask")
        for i, t, start, mask in zip(*(notes[c].to_pylist() for c in ("id", "text_id", "start", "mask")), strict=True):
            if mask is not None:
                found.setdefault((i, t), []).append((start, mask))
        out: dict[str, list] = {c: [] for c in ("row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for row, i, t, x in zip(*(docs[c].to_pylist() for c in ("row_id", "id", "text_id", "text")), strict=True):
            data = x.encode()
            spans: list[list[int]] = []
            if (i, t) in copies:
                spans = [[0, len(data)]] if len(data) >= length else []
            else:
                for start, mask in sorted(found.get((i, t), ())):
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        ones = (~(mask >> low) & ((mask >> low) + 1)).bit_length() - 1
                        a, b = start + low, start + low + ones - 1 + length
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                        mask &= ~(((1 << ones) - 1) << low)
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            for c, v in zip(out, (row, len(data), len(data) - len(left), len(spans), sha256(left).hexdigest(), left), strict=True):
                out[c].append(v)
        return pa.table({"doc_id": pa.array(out["row_id"], docs["row_id"].type), "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()),
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})

    return run


def _hits(contexts: DataFrame, length: int, gram: int, many: int, bucket: int) -> DataFrame:
    """id, text_id, part, start, mask: the strings that also start in a text with a smaller id."""
    level, whole = 0, [contexts]  # contexts and the pieces of those that are cut; together they are all strings
    while True:
        sizes = whole[-1].groupBy("name").agg(F.count_distinct("hash").alias("contexts"))
        large = sizes.where(F.col("contexts") > many).select("name")
        if large.isEmpty():
            break
        level += 1
        large = written(large, "large")
        last = whole.pop()
        whole.append(last.join(large, "name", "left_anti").select(contexts.columns))
        whole.append(written(last.join(large, "name").select(contexts.columns).mapInArrow(_halves(length, level, gram), _CONTEXTS), "contexts"))
    contexts = reduce(DataFrame.union, whole)
    # equal contexts once, with the least id that has them
    distinct = written(contexts.groupBy("name", "hash").agg(
        F.min("id").alias("id"), F.max("id").alias("last_id"), F.first("n").alias("n"), F.first("context").alias("context")), "distinct")
    total = distinct.agg(F.sum(F.octet_length("context") + 1).alias("bytes")).first().bytes or 0
    buckets = max(1, -(-total // bucket))
    masks = (
        distinct.select("name", "hash", "id", "n", "context").groupBy(F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("bucket"))
        .applyInArrow(_sort_bucket(length), "name bigint, hash bigint, mask bigint").where(F.col("mask") != 0))
    masks = written(masks, "masks")
    known = (
        distinct.select("name", "hash", F.col("id").alias("least"), "last_id").join(masks, ["name", "hash"], "left")
        .where((F.col("last_id") > F.col("least")) | F.col("mask").isNotNull())
        .select("name", "hash", "least", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask")))
    known = written(known, "known")
    discard(distinct, masks)
    every = F.expr("shiftleft(1L, n) - 1")
    return (
        contexts.select("name", "hash", "id", "text_id", "part", "start", "n").join(known, ["name", "hash"])
        .select("id", "text_id", "part", "start", F.when(F.col("id") > F.col("least"), every).otherwise(F.col("mask")).alias("mask"))
        .where(F.col("mask") != 0))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   part: int = PART, exchange: int = EXCHANGE, many: int = MANY, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left): one row per row of ``docs``."""
    if not 0 < length - gram < 62:
        raise ValueError("a string may be up to 61 bytes longer than an anchor")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    number = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LEAST))
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), number.alias("id"), text.alias("text"))
    digests = written(rows.groupBy("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(
        F.max(F.xxhash64("text")).alias("text_id"), F.max(F.octet_length("text")).cast("bigint").alias("size"), F.count("*").alias("n")), "digests")
    total = digests.agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).first().bytes or 0
    parts, exchanges = max(1, -(-total // part)), max(1, total // (2 * exchange))  # an anchor's hash for about 16 bytes
    # a part is found from a row alone, so every pass over the texts agrees on it
    in_part = F.pmod(F.xxhash64("id", "text_id"), F.lit(parts))
    placed = rows.withColumn("text_id", F.xxhash64("text")).withColumn("part", in_part)
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(F.col("last_id") > F.col("first_id"))
    copies = digests.join(firsts, "digest").where(F.col("id") > F.col("first_id")).select(in_part.alias("part"), "id", "text_id")
    asked = placed.select("part", "text").mapInArrow(_requests(length, gram, exchanges), "part bigint, exchange bigint, once binary, more binary")
    replies = asked.groupBy("exchange").applyInArrow(_replies, "part bigint, names binary")
    notes = replies.unionByName(copies, allowMissingColumns=True)
    contexts = written(placed.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(_contexts(length, gram), _CONTEXTS), "contexts")
    hits = written(_hits(contexts, length, gram, many, bucket).unionByName(copies, allowMissingColumns=True), "hits")
    discard(contexts)
    return placed.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(
        _cut(length), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")

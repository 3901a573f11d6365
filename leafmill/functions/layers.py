"""Definitions put together layer by layer from the octets of VARIANT values, in Python workers.

Objects and keyed lists become dictionaries, any other value stays as its octets. Scalars are copied as they are; objects and lists are
written anew with a dictionary of keys of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import VariantVal

#: How Arrow shows a VARIANT to Spark.
VARIANT = pa.struct([pa.field("value", pa.binary(), False), pa.field("metadata", pa.binary(), False, metadata={b"variant": b"true"})])

# Octets of scalars by their type; those of binary and long strings (15, 16) have their length in them.
_FIXED = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 5, 6: 9, 7: 9, 8: 6, 9: 10, 10: 18, 11: 5, 12: 9, 13: 9, 14: 5, 17: 9, 18: 9, 19: 9, 20: 17}
_OBJECT, _LIST = 2, 3


def _numbers(v: bytes, at: int, n: int, size: int) -> bytes | list[int]:
    return v[at:at + n] if size == 1 else [int.from_bytes(v[i:i + size], "little") for i in range(at, at + n * size, size)]


@lru_cache(maxsize=1024)
def _keys(metadata: bytes) -> list[str]:
    size = (metadata[0] >> 6) + 1
    n = int.from_bytes(metadata[1:1 + size], "little")
    offsets, start = _numbers(metadata, 1 + size, n + 1, size), 1 + size * (n + 2)
    return [metadata[start + offsets[i]:start + offsets[i + 1]].decode() for i in range(n)]


def _inside(v: bytes, at: int) -> tuple[bytes | list[int], bytes | list[int], int]:
    """The numbers of the keys of an object (none for a list), the offsets of its members, and where these count from."""
    head = v[at] >> 2
    if not head:  # all numbers have one octet
        n, first = v[at + 1], at + 2
        rest = first + n if v[at] == _OBJECT else first
        return v[first:rest], v[rest:rest + n + 1], rest + n + 1
    size = (head & 3) + 1
    is_object = v[at] & 3 == _OBJECT
    large = head >> (4 if is_object else 2) & 1
    n = int.from_bytes(v[at + 1:at + 5], "little") if large else v[at + 1]
    at += 5 if large else 2
    ids = b""
    if is_object:
        id_size = (head >> 2 & 3) + 1
        ids = _numbers(v, at, n, id_size)
        at += n * id_size
    return ids, _numbers(v, at, n + 1, size), at + (n + 1) * size


def _length(v: bytes, at: int) -> int:
    kind, head = v[at] & 3, v[at] >> 2
    if kind == 1:
        return 1 + head
    if kind == 0:
        return _FIXED[head] if head not in (15, 16) else 5 + int.from_bytes(v[at + 1:at + 5], "little")
    _, offsets, start = _inside(v, at)
    return start + offsets[-1] - at


class _Items:
    """A keyed list: its items by name (those without one by layer and place) as ``(value, layer, place, has no name)``."""

    __slots__ = ("items", "layer")

    def __init__(self):
        self.items, self.layer = {}, 0

    def ordered(self) -> list:
        """Items without a name of earlier layers, the list of the last layer, the named items that no later layer repeats, newest layer first."""
        def place(item: tuple) -> tuple[int, int, int]:
            _, layer, pos, loose = item
            return (1, 0, pos) if layer == self.layer else (0, layer, pos) if loose else (2, -layer, pos)

        return [item[0] for item in sorted(self.items.values(), key=place)]


def _name(v: bytes, at: int, keys: list[str], metadata: bytes) -> str | None:
    ids, offsets, start = _inside(v, at)
    for i, k in enumerate(ids):
        if keys[k] == "name":
            at = start + offsets[i]
            if v[at] & 3 == 1:
                return v[at + 1:at + _length(v, at)].decode()
            found = VariantVal(v[at:at + _length(v, at)], metadata)
            if v[at] & 3 >= _OBJECT:
                return found.toJson()
            value = found.toPython()
            return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return None


def _merge(into: dict, v: bytes, at: int, metadata: bytes, layer: int, keyed: frozenset[str]) -> None:
    keys = _keys(metadata)
    ids, offsets, start = _inside(v, at)
    for k, offset in zip(ids, offsets):  # noqa: B905  the last offset is the end
        key, at = keys[k], start + offset
        kind = v[at] & 3
        if kind == _OBJECT:
            old = into.get(key)
            if type(old) is not dict:
                old = into[key] = {}
            _merge(old, v, at, metadata, layer, keyed)
        elif kind == _LIST and key in keyed:
            old = into.get(key)
            if type(old) is not _Items:
                old = into[key] = _Items()
            _merge_items(old, v, at, metadata, layer, keyed)
        else:
            into[key] = (v[at:at + _length(v, at)], metadata)


def _merge_items(into: _Items, v: bytes, at: int, metadata: bytes, layer: int, keyed: frozenset[str]) -> None:
    into.layer = layer
    _, offsets, start = _inside(v, at)
    for pos, offset in enumerate(offsets[:-1]):
        at, name, value = start + offset, None, None
        if v[at] & 3 == _OBJECT:
            name = _name(v, at, _keys(metadata), metadata)
            step = (layer, pos) if name is None else name
            value = into.items[step][0] if step in into.items else {}
            _merge(value, v, at, metadata, layer, keyed)
        else:
            step, value = (layer, pos), (v[at:at + _length(v, at)], metadata)
        into.items[step] = (value, layer, pos, name is None or name.startswith("#:"))


def _width(number: int) -> int:
    return max(1, (number.bit_length() + 7) // 8)


def _framed(head: int, shift: int, ids: list[int] | None, values: list[bytes]) -> bytes:
    offsets, end, n = [0], 0, len(values)
    for value in values:
        end += len(value)
        offsets.append(end)
    if n < 256 and end < 256 and (not ids or max(ids) < 256):
        return bytes((head, n, *(ids or ()), *offsets)) + b"".join(values)
    large, size = n > 255, _width(end)
    flags = size - 1 | large << shift
    id_size = _width(max(ids, default=0)) if ids is not None else 1
    flags |= (id_size - 1) << 2 if ids is not None else 0
    pack = lambda numbers, size: bytes(numbers) if size == 1 else b"".join(x.to_bytes(size, "little") for x in numbers)
    return b"".join([bytes([head | flags << 2]), n.to_bytes(4 if large else 1, "little"), pack(ids or [], id_size), pack(offsets, size), *values])


def _of_object(members: dict[str, bytes], ids: dict[str, int]) -> bytes:
    # members are in the order of Java's strings
    names = sorted(members) if "".join(members).isascii() else sorted(members, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return _framed(_OBJECT, 4, [ids.setdefault(k, len(ids)) for k in names], [members[k] for k in names])


def _copied(v: bytes, at: int, keys: list[str], ids: dict[str, int]) -> bytes:
    """A value with the keys of another dictionary."""
    kind = v[at] & 3
    if kind < _OBJECT:
        return v[at:at + _length(v, at)]
    numbers, offsets, start = _inside(v, at)
    values = [_copied(v, start + o, keys, ids) for o in offsets[:len(numbers) if kind == _OBJECT else -1]]
    return _of_object(dict(zip((keys[k] for k in numbers), values, strict=True)), ids) if kind == _OBJECT else _framed(_LIST, 2, None, values)


def _written(node: dict | _Items | tuple[bytes, bytes], ids: dict[str, int]) -> bytes:
    if type(node) is tuple:
        v, metadata = node
        return v if v[0] & 3 < _OBJECT else _copied(v, 0, _keys(metadata), ids)
    if type(node) is dict:
        return _of_object({k: _written(m, ids) for k, m in node.items()}, ids)
    return _framed(_LIST, 2, None, [_written(m, ids) for m in node.ordered()])


@lru_cache(maxsize=1024)
def _dictionary(keys: tuple[str, ...]) -> bytes:
    texts = [k.encode() for k in keys]
    size = _width(max(sum(map(len, texts)), len(texts)))
    offsets, end = [0], 0
    for text in texts:
        end += len(text)
        offsets.append(end)
    return b"".join([bytes([1 | (size - 1) << 6]), *(x.to_bytes(size, "little") for x in (len(texts), *offsets)), *texts])


def _changes(column: pa.ChunkedArray) -> list[bool]:
    """Whether a row has another value than the one before; nulls are the same, and so are values that are no numbers."""
    a, b = column[1:], column[:-1]
    try:
        other = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            other = pc.and_(other, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        return pc.or_(other, pc.xor(a.is_null(), b.is_null())).to_pylist()
    except pa.ArrowNotImplementedError:
        values = column.to_pylist()
        return [x != y for x, y in zip(values[1:], values[:-1], strict=True)]


def merged_layers(keys: list[str], order: list[str], payload: str, keyed: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over files sorted by their keys and layers: ``(*keys, definition)`` of each definition that has an object.

    One definition is held at a time. Without a key it has nothing in it.
    """
    names = frozenset(keyed)

    def definitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        before, whole, layer = None, None, 0

        def done(table: pa.Table, at: list[int], found: list[dict]) -> pa.RecordBatch:
            heads = table.select(keys).take(pa.array(at, pa.int64())).combine_chunks()
            columns = [heads[k].combine_chunks() if isinstance(heads[k], pa.ChunkedArray) else heads[k] for k in keys]
            known = [all(r) for r in zip(*(c.is_valid().to_pylist() for c in columns), strict=True)]
            values, metadata = [], []
            for node, is_known in zip(found, known, strict=True):
                ids = {}
                values.append(_written(node if is_known else {}, ids))
                metadata.append(_dictionary(tuple(ids)))
            merged = pa.StructArray.from_arrays([pa.array(values, pa.binary()), pa.array(metadata, pa.binary())], fields=list(VARIANT))
            fields = [*(pa.field(k, c.type) for k, c in zip(keys, columns, strict=True)), pa.field("definition", VARIANT)]
            return pa.RecordBatch.from_arrays([*columns, merged], schema=pa.schema(fields))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if before is None else [before, batch])
            new_key = [any(c) for c in zip(*(_changes(table[k]) for k in keys), strict=True)]
            new_layer = [any(c) for c in zip(*(_changes(table[c]) for c in order), strict=True)]
            at, found, first = [], [], 0 if before is None else 1
            values = table[payload].combine_chunks()
            valid, texts, dictionaries = values.is_valid().to_pylist(), values.field("value").to_pylist(), values.field("metadata").to_pylist()
            for i in range(first, table.num_rows):
                if i and new_key[i - 1]:
                    if whole is not None:
                        at.append(i - 1)
                        found.append(whole)
                    whole, layer = None, 0
                elif i and new_layer[i - 1]:
                    layer += 1
                if valid[i] and texts[i][0] & 3 == _OBJECT:
                    whole = {} if whole is None else whole
                    _merge(whole, texts[i], 0, dictionaries[i], layer, names)
            if at:
                yield done(table, at, found)
            before = batch.slice(batch.num_rows - 1)
        if whole is not None:
            yield done(pa.Table.from_batches([before]), [0], [whole])

    return definitions

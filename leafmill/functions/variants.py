"""Reading and writing inside VARIANT objects by a path of keys.

A path is an array of keys, so a key may hold any character. All of it is column expressions: the objects along a path are
taken apart to maps on the way down and made anew on the way up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def entries(value: Column) -> Column:
    """The members of an object, null for any other value."""
    return F.try_variant_get(value, "$", _MAP)


def items(value: Column) -> Column:
    """The items of a list, null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def no_entries() -> Column:
    return F.create_map().cast(_MAP)


def no_items() -> Column:
    return F.array().cast("array<variant>")


def get_at(value: Column, parts: Column) -> Column:
    """The value at a path, null if there is none or an object is missing on the way."""
    return F.aggregate(parts, value, lambda here, part: F.try_element_at(entries(here), part))


def set_at(value: Column, parts: Column, new: Column) -> Column:
    """``value`` with ``new`` at a path of one key or more. Objects that are missing on the way are made; anything
    else than an object on the way is replaced."""
    last = F.size(parts)
    down = F.aggregate(
        F.slice(parts, F.lit(1), last - 1), F.array(F.coalesce(entries(value), no_entries())),
        lambda maps, part: F.array_append(maps, F.coalesce(entries(F.try_element_at(F.element_at(maps, -1), part)), no_entries())))

    def up(maps: Column) -> Column:
        def put(child: Column, i: Column) -> Column:
            key = F.element_at(parts, i)
            kept = F.map_filter(F.element_at(maps, i), lambda k, _: k != key)
            return F.to_variant_object(F.map_concat(kept, F.create_map(key, child)))

        return F.aggregate(F.reverse(F.sequence(F.lit(1), last)), new, put)

    return F.transform(F.array(down), up)[0]


def is_open(value: Column, parts: Column) -> Column:
    """Whether every step before the last is an object or missing; a JSON null is neither."""
    start = F.struct(value.alias("here"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        inside = F.try_element_at(entries(state["here"]), part)
        return F.struct(inside.alias("here"), (state["ok"] & (inside.isNull() | entries(inside).isNotNull())).alias("ok"))

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["ok"]

"""Plain versions and tables that the tests of the operators share."""

import re
from collections import defaultdict

import duckdb

SF = "/root/testdata/sf0.001"


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def word_sets(rows, width=5):
    """The word n-grams of (id, text) rows, by place in the list."""
    out = []
    for _, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def near_groups(sets, num=4, den=5):
    """For each set the places of the others at least num/den alike, and the least place of its component."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    near = [set() for _ in sets]
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
        near[i] = {j for j, n in shared.items() if j != i and n * den >= num * (len(s) + len(sets[j]) - n)}
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            low = min([root[i], *(root[j] for j in near[i])])
            if low < root[i]:
                root[i], changed = low, True
    return near, root

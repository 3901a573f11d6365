"""Search against the scores of all documents, and the parts of texts that it shows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import search as se
from leafmill.operators.keywords import STOP_WORDS


def cut(text):
    return [w for w in re.findall(r"\w{2,}", text.lower()) if w not in STOP_WORDS]


def every_score(queries, docs):
    counts = {k: Counter(cut(t)) for k, t in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries.items():
        for k, c in counts.items():
            hits = [w for w in dict.fromkeys(cut(text)) if w in c]
            if hits:
                out[q, k] = round(sum(c[w] / c.total() * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in hits), 6)
    return out


@pytest.mark.parametrize("best", [1, 3, 10])
def test_search_finds_the_best_of_all(spark, best):
    rng = random.Random(best)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # some words are in most documents
    docs = {k: " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 2, 5, 40, 300]))) for k in range(400)}
    docs[400], docs[401], docs[402] = "", "the", docs[7]  # nothing, nothing but a stop word, an equal text
    queries = {q: " ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for q in range(25)} | {90: "rare nothing", 91: "", 92: "w59 rare"}
    scores = every_score(queries, docs)
    want = []
    for q in queries:
        mine = sorted(((k, s) for (i, k), s in scores.items() if i == q), key=lambda x: (-x[1], x[0]))
        want += [(q, k, rank, s, len(mine)) for rank, (k, s) in enumerate(mine[:best], 1)]
    found = se.search(spark.createDataFrame(list(queries.items()), "query_id long, query string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"), max_results=best)
    got = sorted(tuple(r) for r in found.select("query_id", "doc_id", "rank", "score", "total_results").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])


def test_no_query_and_no_document(spark):
    queries = spark.createDataFrame([(1, "word")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    assert se.search(queries.where("false"), docs).collect() == []
    assert se.search(queries, docs.where("false")).collect() == []


def test_a_snippet_is_around_a_whole_word(spark):
    text = "start " * 30 + "here is art, and more"
    rows = spark.createDataFrame([(text, ["art"]), (text, ["none"]), (text, []), ("Art first", ["art"]), ("x" * 200, ["x"])], "t string, w array<string>")
    got = [r[0] for r in rows.select(se.snippet(F.col("t"), F.col("w"), 10)).collect()]
    assert got == ["t here is art, and m", text[:20], text[:20], "Art first", "x" * 20]

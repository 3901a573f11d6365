"""Keywords: scores and choices against plain Python, and what moves between tasks."""

import math
import random
from collections import Counter

import pytest

from leafmill.operators import keywords as kw

WORDS = ["data", "engine", "große", "naïve", "x_1", "数据", "ab", "abc", "zz", "2024", "ключ", "the"]


def corpus(seed, n=60):
    """Texts of few words, with many equal scores; some keys and texts come twice or are null."""
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, [20 // (i + 1) + 1 for i in range(len(WORDS))], k=rng.randrange(0, 40)))) for k in range(n)]
    return [*rows, rows[3], (4, rows[5][1]), (None, rows[6][1]), (None, rows[7][1]), (n, None), (n + 1, ""), (n + 2, "a i")]


def terms_of(text, low, high):
    words = [w for w in (text or "").split() if len(w) > 1 and w not in kw.STOP_WORDS]
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(rows, low, high):
    counts = [(k, Counter(terms_of(t, low, high))) for k, t in rows]
    df = Counter(t for _, c in counts for t in c)
    return [(k, t, round(tf / c.total() * (math.log((1 + len(rows)) / (1 + df[t])) + 1), 9)) for k, c in counts for t, tf in c.items()]


def by_text(rows):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in rows)


def compared(got, want):
    got, want = by_text(map(tuple, got)), by_text(want)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-9)


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3)])
def test_scores_of_every_length_against_python(spark, low, high):
    rows = corpus(low * 10 + high)
    docs = spark.createDataFrame(rows, "id long, text string")
    compared(kw.score_candidates(docs, "id", "text", (low, high)).collect(), brute(rows, low, high))


def test_terms_do_not_move_to_meet_their_frequencies(spark):
    docs = spark.createDataFrame(corpus(1), "id long, text string")
    plan = kw.score_candidates(docs, "id", "text", best=5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "term-counts" not in plan


@pytest.mark.parametrize("best", [1, 3, 10])
def test_best_terms_of_equal_scores(spark, best):
    rows = corpus(best, 120)
    docs = spark.createDataFrame(rows, "id long, text string")
    whole, part = kw.score_candidates(docs, "id", "text"), kw.score_candidates(docs, "id", "text", best=best)
    assert part.count() < whole.count()
    assert by_text(map(tuple, kw.top_keywords(part, "id", best).collect())) == by_text(map(tuple, kw.top_keywords(whole, "id", best).collect()))


@pytest.mark.parametrize("top_n, diversity, high", [(3, 0.7, 2), (2, 0.2, 2), (4, 0.9, 1), (3, 0.5, 3), (3, 1.0, 2)])
def test_mmr_of_the_terms_it_may_choose(spark, top_n, diversity, high):
    rng = random.Random(top_n)
    rows = corpus(top_n, 80) + [(1000 + k, " ".join(f"w{min(int(rng.expovariate(0.1)), 99)}" for _ in range(300))) for k in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string")
    whole, part = kw.score_candidates(docs, "id", "text", (1, high)), kw.score_candidates(docs, "id", "text", (1, high), apart=(top_n, diversity))
    if diversity < 1:
        assert part.count() < whole.count()
    assert by_text(map(tuple, kw.mmr_keywords(part, "id", top_n, diversity).collect())) == by_text(map(tuple, kw.mmr_keywords(whole, "id", top_n, diversity).collect()))


def greedy(terms, top_n, diversity):
    """(term, score) pairs, chosen step by step."""
    left, picked = sorted(terms, key=lambda t: (-t[1], t[0])), []
    best = left[0][1]
    alike = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    while left and len(picked) < top_n:
        gain = lambda t: round((1 - diversity) * t[1] / best - diversity * max((alike(t[0], p[0]) for p in picked), default=0), 9)
        picked.append(min(left, key=lambda t: (-gain(t), t[0])) if picked else left[0])
        left.remove(picked[-1])
    return picked


def test_mmr_against_python(spark):
    rows = [r for r in corpus(9, 40) if r[0] is not None]
    docs = spark.createDataFrame(rows, "id long, text string")
    scored = kw.score_candidates(docs, "id", "text")
    groups = {}
    for r in scored.collect():
        groups.setdefault(r.id, []).append((r.term, r.score))
    want = sorted((k, t, s, i) for k, terms in groups.items() for i, (t, s) in enumerate(greedy(terms, 3, 0.7), 1))
    got = kw.mmr_keywords(kw.score_candidates(docs, "id", "text", apart=(3, 0.7)), "id", 3, 0.7)
    assert sorted(map(tuple, got.collect())) == want


def test_maxsum_takes_no_call_for_each_key(spark):
    rows = [(k, f"t{i}", 1.0 / (i + 1)) for k in range(5) for i in range(k + 1)]
    scored = spark.createDataFrame(rows, "id long, term string, score double")
    chosen = kw.maxsum_keywords(scored, "id", 3, 4)
    assert sorted(map(tuple, chosen.collect())) == sorted((k, f"t{i}", 1.0 / (i + 1), i + 1) for k in range(5) for i in range(min(3, k + 1)))
    assert "FlatMapGroupsInPandas" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_score(spark):
    for rows in ([], [(1, None), (2, "a")]):
        docs = spark.createDataFrame(rows, "id long, text string")
        for options in ({}, {"best": 2}, {"apart": (3, 0.7)}):
            scored = kw.score_candidates(docs, "id", "text", **options)
            assert scored.collect() == [] and kw.mmr_keywords(scored, "id").collect() == []

import functools

import public_tokenizers
import pytest

from leafmill.llm.token_counts import UnigramCounter, counter, token_counts
from tests.llm.helpers import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(own):
    @functools.cache
    def best(word):
        """(score, -tokens) of the best split, from the last piece."""
        if not word:
            return 0.0, 0
        n = len(word[-1].encode())
        before = best(word[:-1])
        out = (before[0] + n * own.byte_score, before[1] - n)
        for size in range(1, len(word) + 1):
            if word[-size:] in own.scores:
                before = best(word[:-size])
                out = max(out, (before[0] + own.scores[word[-size:]], before[1] - 1))
        return out

    return best


def test_documents(spark):
    rows = table("documents", "doc_id, text") + [(-1, None), (-2, ""), (-3, "  \n"), (-4, "日é\U0001f600 x"), (-5, "the " * 60000), (-6, "the a"), (-6, "the a")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    best, got = plain(counter(PATH)), {}
    for r in token_counts(docs, PATH).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_tokens, r.log_score))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        found = [best("▁" + w) for w in (t or "").split()]
        for n, tokens, score in got[i]:
            assert (n, tokens) == (len(found), -sum(x[1] for x in found)), t
            assert score == pytest.approx(sum(x[0] for x in found))


def test_shared_prefixes_are_computed_once():
    own = UnigramCounter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -4.0}, -9.0)
    seen = []
    place = own._place
    own._place = lambda word, at, best: (seen.append(word[:at]), place(word, at, best))[1]
    own.learn(["abc", "ab", "abd", "b"])
    assert seen == ["▁", "▁a", "▁ab", "▁abc", "▁abd", "▁b"]


def test_forgetting_changes_nothing():
    a, b = counter(PATH), UnigramCounter(counter(PATH).scores, counter(PATH).byte_score, kept=3)
    texts = ["one two three", "four five six", "one six seven"]
    for t in texts:
        assert [x.tolist() for x in a.texts([t])] == [x.tolist() for x in b.texts([t])]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []

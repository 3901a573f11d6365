"""Words are told apart by their characters, also where their hashes agree."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import words
from leafmill.llm.bpe import encode
from leafmill.llm.packing import ByteLevelIds


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIR = [thue_morse(2048), thue_morse(2048, "b", "a")]


def test_the_hashes_of_these_words_agree():
    points = words.code_points("".join(PAIR))
    hashes = words.word_hashes(points, np.array([0, 2048]), np.array([2048, 4096]))
    assert hashes[0] == hashes[1]


def test_distinct_words():
    rng = random.Random(2)
    given = [*PAIR, "x", PAIR[1], "y", "x", PAIR[0][:1024], PAIR[1][:1024], PAIR[0], *["".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(200)]]
    points, bounds = words.code_points("".join(given)), words.bounds_of(given)
    first, kind = words.distinct_words(points, bounds[:-1], bounds[1:])
    assert [given[first[k]] for k in kind] == given
    assert len(first) == len(set(given)) == len(set(kind.tolist()))


def texts():
    rng = random.Random(8)
    long = ["".join(rng.choices("abc", k=rng.randint(500, 3000))) for _ in range(100)]
    return [" ".join(PAIR), PAIR[1], PAIR[0], " ".join(long), *PAIR]


def test_byte_level_ids_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts(), ByteLevelIds(path)(texts()), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_ids_are_those_of_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode(docs, path, decoded=True).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts())}


@pytest.mark.parametrize("text", ["", "a"])
def test_few_words(text):
    points = words.code_points(text)
    first, kind = words.distinct_words(points, np.arange(len(text)), np.arange(len(text)) + 1)
    assert (first.tolist(), kind.tolist()) == (list(range(len(text))),) * 2

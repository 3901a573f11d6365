import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafmill.llm import words
from leafmill.llm.bpe import codec, decode, encode
from leafmill.llm.packing import ids_of
from tests.llm.helpers import table

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"ab 'stdmrevl\n\t 1!<é.,", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "ߐ", "日", "Σ", "É", "İ", "é", " ", " "]


def texts():
    rng = random.Random(2)
    out = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    out += ["".join(rng.choice("aaaaaabcdehinort") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    return out + ["", " ", "a" * 5000, "ab " * 30000] + [t for (t,) in table("documents", "text")]


def test_ids_are_those_of_the_library():
    library, own, given = Tokenizer.from_file(WORDS), codec(WORDS), texts()
    found = [x for a, b in words.slices(given, 50_000) for x in own.encode(given[a:b])]
    for text, mine, theirs in zip(given, found, library.encode_batch(given, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids, text[:80]
        assert own.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False)


def test_byte_level_ids_are_those_of_the_library():
    library, given = Tokenizer.from_file(BYTES), texts()
    for text, mine in zip(given, ids_of(BYTES)(given), strict=True):
        assert mine.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_tables(spark):
    rows = [(1, "Hello  world", 5), (2, None, 6), (None, "", 7), (2, "Hello  world", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    made = encode(docs, WORDS, decoded=True)
    library = Tokenizer.from_file(WORDS)
    for r in made.collect():
        want = library.encode("" if r.n_tokens == 0 else "Hello  world", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    again = decode(encode(docs, WORDS), WORDS)
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in made.collect())
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), WORDS, decoded=True).collect() == []


def test_forgetting_words_changes_nothing():
    own = words.WordIds(lambda w: [len(w)], kept=2)
    joined = "aa bbb c aa dddd"
    points, begin, end = words.code_points(joined), np.array([0, 3, 7, 9, 12]), np.array([2, 6, 8, 11, 16])
    for _ in range(3):
        assert [x.tolist() for x in own.texts(joined, points, np.array([0, 8, 16]), begin, end)] == [[2, 3, 1], [2, 4]]

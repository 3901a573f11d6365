"""Operators that learn: language and quality."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmill.llm import language, quality, words

SF01 = "/root/testdata/sf0.01"


def held_out(doc_id, n, r):
    return zlib.crc32(str(doc_id).encode()) % n == r


def plain_phrases(text, sample):
    """Phrases of a greedy parse of text by longest matches in sample; a symbol that sample lacks is a phrase."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_parser_against_plain():
    rng = random.Random(1)
    for _ in range(30):
        sample = [rng.choice([3, 4, 5]) for _ in range(rng.randint(1, 60))]
        text = [rng.choice([3, 4, 5, 6]) for _ in range(rng.randint(1, 80))]
        (moves, state), n = language.parser(sample, 7), 0
        for c in text:
            state = int(moves[state + c])
            n += state >> 30
            state &= (1 << 30) - 1
        assert n == plain_phrases("".join(map(chr, text)), "".join(map(chr, sample)))


@pytest.mark.parametrize("make", [language.table_step, language.search_step])
def test_steps_against_plain(make):
    rng = random.Random(2)
    for _ in range(30):
        sample = [rng.choice([1, 3, 4, 5]) for _ in range(rng.randint(0, 60))]
        text = [rng.choice([0, 1, 3, 4, 5, 6]) for _ in range(rng.randint(1, 80))]
        step, begin = make(sample, 7)
        state, n = np.array([begin]), 0
        for c in [*text, 2, 2]:
            state, new = step(state, np.array([c]))
            n += int(new[0])
        assert n == plain_phrases("".join(map(chr, text)), "".join(map(chr, sample)))


@pytest.mark.parametrize("tables", [language.TABLES, 0])
def test_languages_of_many_letters(spark, tables, monkeypatch):
    rng = random.Random(5)
    parts = {"zh": "今天 天气 很好 我们 一起 公园 散步 孩子 唱歌 时候", "ja": "きょう てんき とても いい わたし いっしょ こうえん さんぽ こども うた",
             "ko": "오늘 날씨 매우 좋다 우리 함께 공원 산책 아이 노래", "ru": "сегодня погода очень хорошая мы вместе парк гулять дети песня",
             "uk": "сьогодні погода дуже гарна ми разом парк гуляти діти пісня їжа", "el": "σήμερα καιρός πολύ καλός εμείς μαζί πάρκο βόλτα παιδιά τραγούδι"}

    def text(name):
        gap = "" if name in ("zh", "ja", "ko") else " "
        return gap.join(rng.choice(parts[name].split()) for _ in range(40))

    rows = [(k, text(name), name) for k, name in enumerate(list(parts) * 8)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id") < 36)
    monkeypatch.setattr(language, "TABLES", tables)
    found = learned.score([t for _, t, _ in rows[36:]])
    assert [name for name, _ in found] == [name for _, _, name in rows[36:]]
    assert learned.symbols(["今。天\U0001f600"])[0].tolist() == [learned.codes[ord("今")], 1, learned.codes[ord("天")], 1]


def test_languages_are_bounded(spark):
    rows = [(k, "the of and", f"id {k}") for k in range(30)] + [(50 + k, "der die das", "de") for k in range(2)] + [(60 + k, "le la les", "fr") for k in range(3)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), most=3)
    assert learned.names == ["de", "fr", "id 0"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    learned = language.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert all(len(s) <= language.PASSAGES * (language.PASSAGE_LENGTH + 1) for s in learned.samples)
    rows = [r for r in language.predict(docs, learned).collect() if held_out(r.doc_id, 4, 2)]
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    rows = [(1, "the of and " * 30, "en", "s"), (2, "der die das " * 30, "de", None), (3, None, "en", ""), (4, "123 !", None, ""),
            (5, "the and", None, ""), (5, "the and", None, ""), (None, "die der das die", "de", ""), (6, "", None, ""), (7, "the of " * 40000, None, ""), (8, "日本", "en", "")]
    docs = spark.createDataFrame(rows, schema)
    learned = language.learn(docs, F.lit(True))
    assert learned.names == ["de", "en"]
    got = language.predict(docs, learned).collect()
    assert len(got) == len(rows) and [r.lang_pred for r in got if r.doc_id in (1, 5, 7)] == ["en"] * 4
    assert [r.lang_pred for r in got if r.doc_id in (3, 4, 6)] == ["und"] * 3
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"] and all(r.lang_pred != "und" for r in got if r.doc_id == 8)
    empty = spark.createDataFrame([], schema)
    nothing = language.learn(empty, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language.predict(empty, learned).collect() == []


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, usable=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.score, r.predicted, marks[r.doc_id]) for r in quality.score(docs, model).collect() if r.doc_id in marks and held_out(r.doc_id, 3, 1)]
    assert all((s >= 0.5) == (p == 1) for s, p, _ in rows)
    assert np.mean([p == m for _, p, m in rows]) > 0.93
    good, bad = ([s for s, _, m in rows if m == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text", 5), (1, "good text", 6), (2, None, 7), (None, "", 8), (3, "bad " * 50000, 9)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    flat = quality.fit(docs, none)
    assert {(r.score, r.predicted) for r in quality.score(docs, flat).collect()} == {(0.5, 1)}
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (2, 0), (None, 1), (1, None), (9, 7)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert scores[1] > 0.5 > scores[3] and scores[2] == scores[None]
    assert quality.score(docs.limit(0), model).collect() == []


def test_a_long_text_does_not_empty_the_sample(spark):
    rows = [(k, "good text " if k % 2 else "bad words ") for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id bigint, quality int")
    first = min(range(20), key=lambda k: spark.range(k, k + 1).select(F.xxhash64("id")).first()[0])
    docs = spark.createDataFrame([(k, t * (1000 if k == first else 1)) for k, t in rows], "doc_id bigint, text string")
    assert quality._sample(docs, labels, "quality", F.lit(True), 4000, 5000).count() == 19
    assert np.any(quality.fit(docs, labels, characters=5000))


def test_features_do_not_depend_on_the_slice():
    texts = ["One two  two", "", "a", " b c ", "längere Wörter und\tmehr"]
    together = quality.features(texts)
    for k, t in enumerate(texts):
        alone = quality.features([t])
        assert sorted(together[0][together[1] == k].tolist()) == sorted(alone[0].tolist())


@pytest.mark.parametrize("most", [3, 10, 10**6])
def test_slices(most):
    texts = ["aa", "b", "", "cccc", "dd"]
    assert [t for a, b in words.slices(texts, most) for t in texts[a:b]] == texts


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "bad noise there"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)] + [(i, i % 2) for i in range(1000, 21000)], "doc_id long, quality int")
    sample = quality._sample(docs, labels, "quality", F.lit(True), 4000, 10**6).collect()
    assert sorted((r.text, r.label) for r in sample) == [("bad noise there", 0), ("good text here", 1)]
    assert len({r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}) > 1


def test_texts_that_cannot_teach_take_no_place_in_the_sample(spark):
    rows = [(i, "wordsofit" + "".join(chr(97 + int(c)) for c in f"{i:05d}") if i % 100 == 0 else None if i % 2 else "12 34", "en") for i in range(40_000)]
    found = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), passages=300, length=12)
    assert len(found.samples[0]) > 300 * 11


def test_a_batch_is_parsed_in_small_slices():
    class Sizes(language.Languages):
        """Instead of a score, what is parsed at once."""

        def score(self, texts):
            return [("x", float(sum(map(len, texts))))] * len(texts)

    # a table that gives the function of its tasks
    docs = SimpleNamespace(columns=["id", "text"], schema=StructType([StructField("id", LongType()), StructField("text", StringType())]), mapInArrow=lambda run, _: run,
                           sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    docs.drop = lambda *_: docs
    texts = ["b" * 300_000 if i == 7 else "a" * 1000 for i in range(2000)]
    run = language.predict(docs, Sizes([], {}, []))
    found = [r for b in run(iter([pa.record_batch([pa.array(range(2000)), pa.array(texts)], names=["id", "text"])])) for r in b.to_pylist()]
    assert [(r["id"], r["text"]) for r in found] == list(enumerate(texts))
    assert max(r["score"] for r in found if r["id"] != 7) <= words.PIECE < 300_000 == max(r["score"] for r in found)

"""Every stage against a plain version, on the input that the stage before gave."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from leafmill.session import materialise
from tests.llm.helpers import SF, near_groups, word_sets
from tests.llm.test_pii import luhn

PERSONAL = r"[\w.]+@[\w.]+\.\w+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 ...", "en", "s", 7), (-3, "", None, None, None), (-4, "lonely words", None, "s", 12),
                                 (-4, "lonely words", None, "s", 12)], docs.schema)
    out = [docs.union(odd)]
    for name, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language(stages):
    assert sorted(rows(stages[1]), key=repr) == sorted(((i, t) for i, t in rows(stages[0]) if re.search(r"[^\W\d_]", t or "")), key=repr)
    assert stages[1].where("lang IS NULL").isEmpty()


def test_predicted_language_takes_effect(spark):
    made = [(k, "the of and to in " * 9 if k % 2 else "der die das und ist " * 9, "en" if k % 2 else "de", "s", 1) for k in range(20)]
    wrong = [(30, "the of and to in " * 9, "de", "s", 1), (31, "der die das und ist " * 9, None, "s", 1), (32, "12 ...", "en", "s", 1)]
    docs = spark.createDataFrame(made + wrong, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r.lang for r in pipeline.language_id(spark, docs, "").collect()}
    assert found == {k: lang for k, _, lang, _, _ in made} | {30: "en", 31: "de"}


def test_exact(stages):
    groups = defaultdict(list)
    for i, t in rows(stages[1]):
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(i)
    assert sorted(i for i, _ in rows(stages[2])) == sorted(max(ids) for ids in groups.values())


def test_near(stages):
    given = sorted(rows(stages[2]))
    _, root = near_groups(word_sets(given))
    assert sorted(i for i, _ in rows(stages[3])) == [i for k, (i, _) in enumerate(given) if root[k] == k]


def test_pii(stages):
    before, after = dict(rows(stages[3])), {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        found = [v for v in re.findall(PERSONAL, text) if not re.fullmatch(r"\d{16}", v) or luhn(v) == 0]
        assert all(v not in after[i].text for v in found)
        if not re.search(r"\d", text):
            assert after[i].text == text
    changed = [r for r in after.values() if len(r.text) != len(before[r.doc_id])]
    assert all(r.n_chars == len(r.text) for r in changed)


def test_packing(stages):
    out = stages[5].collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows(stages[4])}
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []

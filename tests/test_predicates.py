"""Attribute, list and file checks on values of every type."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions.attributes import attribute, try_json
from leafmill.functions.globs import glob_to_regex
from leafmill.operators.evaluate import evaluate_stages
from leafmill.operators.filters import list_filter, match_expression, split_assignment
from leafmill.operators.requirements import (
    AttributeCheck,
    FilePresence,
    ListCheck,
    Requirements,
    RuleTable,
    StageDefinition,
    attribute_check,
    file_presence,
    list_check,
    requirements_met,
)

VALUES = {
    "text": '"alpha"', "upper": '"ALPHA"', "int": "1", "float": "1.0", "frac": "0.72", "true": "true", "false": "false", "null": "null",
    "list": '["a", "B", null]', "empty": "[]", "zero": "0", "blank": '""', "digits": '"0.72"', "object": '{"k": 1}', "nan": '"nan"',
}


@pytest.fixture(scope="module")
def docs(spark):
    data = [(k, f'{{"x": {v}}}') for k, v in VALUES.items()] + [("absent", "{}")]
    return spark.createDataFrame(data, "id string, j string").select("id", F.parse_json("j").alias("attrs")).cache()


def ids(docs, column):
    return {r.id for r in docs.where(column).select("id").collect()}


@pytest.mark.parametrize("operator,value,fold,expected", [
    ("EQ", "alpha", False, {"text"}),
    ("EQ", "alpha", True, {"text", "upper"}),
    ("EQ", 1, False, {"int", "float", "true"}),
    ("EQ", True, False, {"int", "float", "true"}),
    ("EQ", 0.72, False, {"frac"}),
    ("EQ", None, False, set()),
    ("NE", "alpha", False, set(VALUES) - {"text", "null"}),
    ("NE", 0, False, set(VALUES) - {"zero", "false", "null"}),
    ("GT", 0.5, False, {"int", "float", "frac", "true"}),
    ("LTE", 0, False, {"zero", "false"}),
    ("GTE", "alpha", False, {"text", "nan"}),
    ("LT", "a", False, {"upper", "blank", "digits"}),
    ("IS", True, False, {"true"}),
    ("IS", None, False, set()),
    ("IS_NOT", None, False, set(VALUES) - {"null"}),
    ("CP", "al*", False, {"text"}),
    ("CP", "AL*", True, {"text", "upper"}),
    ("NP", "al*", False, set(VALUES) - {"text", "null"}),
    ("CP", 5, False, set()),
    ("REGEX", "^a.p", False, {"text"}),
    ("REGEX", "lph", False, {"text"}),
    ("REGEX", "[bad", False, set()),
    ("NOT_REGEX", "[bad", False, set(VALUES) - {"null"}),
    ("REGEX", r"\D", True, {"digits"}),
])
def test_attribute_check(docs, operator, value, fold, expected):
    assert ids(docs, attribute_check(docs, AttributeCheck("x", operator, value, case_sensitive=not fold))) == expected


@pytest.mark.parametrize("operator,value,fold,expected", [
    ("HAS", "a", False, {"list"}),
    ("CONTAINS", "b", False, set()),
    ("INCLUDES", "b", True, {"list"}),
    ("HAS", None, False, {"list"}),
    ("NOT_HAS", "a", False, {"empty"}),
    ("NOT_CONTAINS", "b", False, {"list", "empty"}),
    ("NOT_INCLUDES", "z", False, {"list", "empty"}),
])
def test_list_check(docs, operator, value, fold, expected):
    assert ids(docs, list_check(docs, ListCheck("x", operator, value, case_sensitive=not fold))) == expected


def test_list_check_on_a_column_with_null_elements(spark):
    d = spark.createDataFrame([("a", ["x", None]), ("b", None), ("c", ["y"])], "id string, tags array<string>")
    assert ids(d, list_check(d, ListCheck("tags", "HAS", "x"))) == {"a"}
    assert ids(d, list_check(d, ListCheck("tags", "NOT_HAS", "x"))) == {"c"}


def test_unknown_operators(docs, spark):
    with pytest.raises(ValueError):
        attribute_check(docs, AttributeCheck("x", "LIKE", 1))
    with pytest.raises(ValueError):
        list_check(docs, ListCheck("x", "LIKE", 1))
    d = spark.createDataFrame([("a", [("k", "f")])], "id string, file_refs array<struct<key:string,filename:string>>")
    assert ids(d, file_presence(FilePresence("k", 9, "~"))) == {"a"}


@pytest.mark.parametrize("expression,expected", [
    (">0.5", {"int", "float", "frac", "true", "digits"}),
    ("==0.72", {"frac", "digits"}),
    ("!= 1", {"frac", "false", "zero", "digits"}),
    (">abc", set()),
    ("exists", set(VALUES) - {"false", "null", "empty", "zero", "blank"}),
    ("True", {"true"}),
    ("al?ha", {"text"}),
    ("[[]'a'*", {"list"}),
])
def test_list_expressions(docs, expression, expected):
    assert ids(docs, match_expression(attribute(docs, "x"), expression)) == expected


def test_list_filter(docs):
    assert split_assignment(" a.b = '>=0.5' ") == ("a.b", ">=0.5")
    assert ids(docs, list_filter(docs, ["x=*", "x=>0.9"])) == {"int", "float", "true"}
    assert ids(docs, list_filter(docs, ["x.k=1"])) == {"object"}
    with pytest.raises(ValueError):
        list_filter(docs, ["x"])


@pytest.mark.parametrize("pattern,text,hit", [
    ("a*c", "abc", True), ("a*c", "abc\n", False), ("a.c", "abc", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False),
    ("[]]x", "]x", True), ("a[", "a[", True), ("*", "a\nb", True), ("a+b", "a+b", True), ("[a-c]", "b", True),
])
def test_globs(spark, pattern, text, hit):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(glob_to_regex(pattern))).first()
    assert row[0] is hit


@pytest.mark.parametrize("text,good", [('{"a":1}', True), ('{"a":1}]', False), ("1}", False), ("1,2", False), ('1,"a":2', False), ("", False), ('"x"', True), ("[1]", True)])
def test_strict_json(spark, text, good):
    assert (spark.createDataFrame([(text,)], "t string").select(try_json(F.col("t")).isNotNull()).first()[0] or False) is good


def test_a_table_of_rules_is_the_single_checks(spark):
    """Checks with equal values of other types, folded text, patterns and lists, all in one array."""
    rows = [("A", 1, True, 2.5, '{"v":1,"t":["x","Y"],"n":null}'), ("b", None, False, float("nan"), '{"v":true,"t":"x"}'), (None, 0, None, None, '{"v":"1","t":[1,2]}'), ("a", 3, True, -1.0, "{}")]
    docs = spark.createDataFrame(rows, "s string, i int, b boolean, x double, j string").withColumn("attrs", F.parse_json("j"))
    docs = docs.withColumn("file_refs", F.array(F.struct(F.lit("k").alias("key"))))
    values = ["a", "A", 1, 1.0, True, 0, False, None, 2.5, float("nan"), "1", "b*", "["]
    checks = [AttributeCheck(a, o, v, c) for a in ("s", "i", "b", "x", "v", "t", "n", "missing") for o in ("EQ", "NE", "GT", "LT", "GTE", "LTE", "IS", "IS_NOT", "CP", "REGEX")
              for v in values for c in (True, False) if c or isinstance(v, str)]
    checks = random.Random(1).sample(checks, 150) + [AttributeCheck("v", "IS", 1), AttributeCheck("v", "IS", True), AttributeCheck("i", "EQ", 1), AttributeCheck("i", "EQ", True)]
    definitions = [StageDefinition(f"d{i}", requirements=Requirements(attribute_checks=(c,))) for i, c in enumerate(checks)]
    definitions.append(StageDefinition("all", requirements=Requirements(
        file_presence=FilePresence("k", 1, "=="), attribute_checks=(checks[0],), list_checks=(ListCheck("t", "HAS", "y", False), ListCheck("t", "NOT_HAS", 3)), extras=("e",))))
    definitions.append(StageDefinition("none", no_eval=True, requirements=Requirements(attribute_checks=(checks[0],))))
    rules = RuleTable(docs, definitions)
    as_table = docs.withColumn("_hits", rules.hits).select(F.expr("array(" + ", ".join(rules.met(d, "_hits", {"e"}) for d in definitions) + ")").alias("m"))
    one_by_one = docs.select(F.array(*[requirements_met(docs, d, {"e"}) for d in definitions]).alias("m"))
    assert [r.m for r in as_table.collect()] == [r.m for r in one_by_one.collect()]
    assert rules.met(definitions[-2], "_hits", set()) == "false"


def test_the_plan_of_many_definitions_is_made_fast(spark):
    definitions = [StageDefinition(f"it's `{i}`", multiple_callable=i % 5 == 0, requirements=Requirements(
        stages={f"it's `{i - 1}`": "active"} if i % 2 else {},
        attribute_checks=tuple(AttributeCheck("p", o, i / 100) for o in ("GT", "LTE", "NE"))[: 1 + i % 3])) for i in range(100)]
    docs = spark.createDataFrame([(1, "inbox", 0.5), (2, "active", 0.0)], "doc_id long, status string, p double")
    stages = spark.createDataFrame([], "doc_id long, name string, counter long, status string")
    evaluate_stages(docs, stages, definitions[:1], passes=3)  # what only the first call loads
    start = time.time()
    outcomes = evaluate_stages(docs, stages, definitions, passes=3).outcomes
    outcomes._jdf.queryExecution().executedPlan()
    assert time.time() - start < 10
    started = {(r.doc_id, r.definition) for r in outcomes.where("outcome = 'started'").collect()}
    want, rules = set(), {"GT": lambda p, v: p > v, "LTE": lambda p, v: p <= v, "NE": lambda p, v: p != v}
    for doc, p in ((1, 0.5), (2, 0.0)):
        for i in range(100):
            if all(rules[o](p, i / 100) for o in ("GT", "LTE", "NE")[: 1 + i % 3]) and (i % 2 == 0 or (doc, f"it's `{i - 1}`") in want):
                want.add((doc, f"it's `{i}`"))
    assert started == want

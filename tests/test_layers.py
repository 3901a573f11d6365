"""Definitions merged from the octets of VARIANT values."""

import json
import random
from functools import reduce

from pyspark.sql import functions as F

from leafmill.operators import catalog as cat


def definitions(done):
    return {r.name: r.j for r in done.definitions().select("name", F.to_json("definition").alias("j")).collect()}


def test_a_definition_is_merged_by_the_task_that_has_its_files(spark, monkeypatch):
    """No row for each path moves, and what is taken apart and put together level by level is the same."""
    random.seed(8)

    def tree(depth):
        if depth == 0 or random.random() < 0.2:
            return random.choice([1, 2**40, 1.5, "é" * random.choice([1, 70, 300]), None, False, [1, {"z": "q", "é": [2, {}]}], [], {}])
        out = {k: tree(depth - 1) for k in random.sample(["a", "b.c", "[d", "\\e", "é", "𝄞", "ﬀ", *(f"k{i}" for i in range(300))], random.choice([1, 3, 270]))}
        if random.random() < 0.6:
            names = random.sample(["p", "q", 7, 1.5, True, None], random.randint(0, 4))
            out["workflows"] = [{"name": n, "x": tree(depth - 1)} for n in names] + random.choice([[], ["loose"], [{"a": 1}, [{"name": "p"}]]])
        return out

    rows = [(n, i, "{}" if i % 5 == 4 else json.dumps(tree(2))) for n in [*range(12), None] for i in range(6)]
    df = spark.createDataFrame(rows, "name long, layer long, j string").select("name", "layer", F.parse_json("j").alias("payload"))
    written = []
    monkeypatch.setattr(cat, "materialise", lambda df, name, keep=cat.materialise: written.append((name, df.columns)) or keep(df, name))
    one = definitions(cat.deep_merge(df, ["name"], ["layer"]))
    assert written == [("merged", ["name", "definition"])] and one[None] == "{}"
    monkeypatch.setattr(cat, "MANY", 1)
    spread = definitions(cat.deep_merge(df, ["name"], ["layer"]))
    assert one == spread and len(one) == 13 and max(map(len, one.values())) > 10_000


def test_values_of_every_type_are_kept(spark):
    values = ["1Y", "300S", "70000", "5000000000L", "1.25BD", "CAST(1 AS DECIMAL(38, 5))", "12345678901.5BD", "1.5F", "1e300", "true", "DATE'2024-02-03'", "TIMESTAMP'2024-02-03 04:05:06'",
              "TIMESTAMP_NTZ'2024-02-03 04:05:06'", "X'0102'", "'short'", f"'{'long' * 30}'", "array(1, 2)", "array(named_struct('u', 1, 't', 'x'))"]
    struct = ", ".join(f"'c{i}', {v}" for i, v in enumerate(values))
    df = spark.sql(f"SELECT 'n' AS name, i AS layer, to_variant_object(if(i = 0, named_struct('m', named_struct({struct})), named_struct('m', named_struct({struct})))) AS payload FROM VALUES (0), (1) AS t(i)")
    found = cat.deep_merge(df, ["name"], ["layer"]).definitions()
    pick = [F.to_json("v"), F.schema_of_variant("v")]
    want = df.where("layer = 1").select(F.col("payload").alias("v")).select(*pick).first()
    assert found.select(F.col("definition").alias("v")).select(*pick).first() == want


def test_files_of_one_definition_in_many_batches(spark):
    rows = [(k, i, json.dumps({f"k{i % 50}": i, "workflows": [{"name": f"w{i % 3}", "at": i}, f"x{i}"]})) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "name string, layer long, j string").select("name", "layer", F.parse_json("j").alias("payload"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = definitions(cat.deep_merge(df, ["name"], ["layer"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    keys = reduce(lambda done, i: done | {f"k{i % 50}": i}, range(200), {})
    named = [{"at": 199, "name": "w1"}, "x199", {"at": 198, "name": "w0"}, {"at": 197, "name": "w2"}]
    want = keys | {"workflows": [f"x{i}" for i in range(199)] + named}
    assert {k: json.loads(j) for k, j in got.items()} == {"a": want, "b": want}

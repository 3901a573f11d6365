"""Rows of a save are made once; text that is no list or object is not parsed as one."""

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.sources import store as st


def test_a_save_makes_its_rows_once(spark, tmp_path):
    """Before, every row was made again for each look at the rows."""
    path, made = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    st.write_store(spark.range(20).selectExpr("CAST(id AS STRING) AS id", "'inbox' AS status", "id AS n"), path, buckets=2)

    @F.udf("long")
    def again(n):
        made.add(1)
        return n + 1 if n < 5 else n

    st.save_changed(spark, path, st.read_store(spark, path).withColumn("n", again.asNondeterministic()("n")))
    assert made.value == 20
    assert sorted(r.n for r in st.read_store(spark, path).collect()) == sorted([1, 2, 3, 4, 5, *range(5, 20)])


def test_lists_and_objects_are_told_by_their_first_sign(spark):
    texts = ["[1, 'x']", " \t[1]", "{'a': [2]}", "[1", "1], [2", "x [1]", "", "'[1]'", "12", "None", "true"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kind = tx.literal_kind(F.col("t"))
    got = [r.k for r in df.select("i", kind.alias("k")).orderBy("i").collect()]
    assert got == ["list", "list", "object", "text", "text", "text", "text", "string", "number", "null", "boolean"]
    assert r"^\s*[\[{]" in df.select(kind)._jdf.queryExecution().optimizedPlan().toString()  # before: all text was parsed

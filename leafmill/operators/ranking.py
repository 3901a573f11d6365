"""Ranks and joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(
    df: DataFrame, keys: list[str], order: list[Column | str], bucket: list[Column], out: str
) -> DataFrame:
    """1..n per key in ``order``, without sorting a whole key in one task.

    ``bucket`` columns are coarser forms of the leading order columns (the hour of a timestamp, the
    first letters of a name): rows are numbered inside (key, bucket), and the sizes of the earlier
    buckets of the key are added. The row numbering and the join on (key, bucket) share one shuffle.
    """
    # The part is one struct: it is never null itself and equals another with the same null fields, so
    # the window, the join and null keys all get along with one plain hash partitioning.
    ks = {f"k{i}": F.col(k) for i, k in enumerate(keys)}
    bs = {f"b{i}": b for i, b in enumerate(bucket)}
    rows = df.withColumn("_part", F.struct(*[c.alias(n) for n, c in (ks | bs).items()]))
    before = (
        Window.partitionBy(*[f"_part.{k}" for k in ks]).orderBy(*[f"_part.{b}" for b in bs])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    numbered = local.join(offsets, "_part")
    return numbered.select(*df.columns, (F.col(out).cast("bigint") + F.col("_before")).alias(out))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. Spark limits each map task to ``k`` rows per key
    before the shuffle (WindowGroupLimit), so the size of a key does not matter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k).withColumn(out, F.col(out).cast("bigint"))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    winner = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(winner.alias("_row")).select(*keys, "_row.*")


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    spread: list[str],
    how: str = "inner",
    hot: list | tuple = (),
    salts: int = 64,
) -> DataFrame:
    """Join in which the values of the first ``on`` column that the caller names as hot are spread over ``salts`` tasks.

    Large partitions of a plain join are split by the adaptive execution; this is for keys that the
    caller knows beforehand. The facts of a hot value get a salt from a hash of ``spread``, and only the
    lookup rows of hot values are repeated, once per salt. The salt depends on row values alone, so
    a task that runs again after a lost executor gives the same rows.
    """
    on = [on] if isinstance(on, str) else on
    if not hot:
        return facts.join(lookup, on, how)
    key = F.col(on[0])
    values = [v for v in hot if v is not None]
    is_hot = F.coalesce(key.isin(values), F.lit(False)) if values else F.lit(False)
    slot = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", F.when(is_hot | key.isNull(), slot).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(copies))
    return left.join(right, [*on, "_salt"], how).drop("_salt")

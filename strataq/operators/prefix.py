"""Running sums over long sequences without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sums(rows: DataFrame, keys: list[str], order: str, value: str, block: int = 1024, groups: int = 1 << 20) -> DataFrame:
    """Append ``before``: the sum of ``value`` over smaller ``order`` (whole numbers, each once per key) within ``keys``.

    In three levels, so that no task gathers all values, whatever the gaps between them (hashes as well as running numbers): blocks
    of ``block`` values of ``order``, groups of ``groups`` blocks, and groups of groups up to the range of a whole number. A level sees one row
    per group of the level below.
    """
    levels = ["_b1", "_b2", "_b3"]
    rows = rows.withColumn("_b1", F.floor(F.col(order) / F.lit(block)).cast("long"))
    rows = rows.withColumn("_b2", F.floor(F.col("_b1") / F.lit(groups)).cast("long")).withColumn("_b3", F.floor(F.col("_b2") / F.lit(groups)).cast("long"))

    def earlier(by: list[str], at: str, what: str):
        over = W.partitionBy(*(by or [F.lit(0)])).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(over), F.lit(0))

    one = rows.groupBy(*keys, *levels).agg(F.sum(value).alias("_s1"))
    two = one.groupBy(*keys, "_b2", "_b3").agg(F.sum("_s1").alias("_s2"))
    three = two.groupBy(*keys, "_b3").agg(F.sum("_s2").alias("_s3"))
    three = three.select(*keys, "_b3", earlier(keys, "_b3", "_s3").alias("_e3"))
    two = two.withColumn("_e2", earlier([*keys, "_b3"], "_b2", "_s2")).join(three, [*keys, "_b3"]).select(*keys, "_b2", (F.col("_e2") + F.col("_e3")).alias("_e2"))
    one = one.withColumn("_e1", earlier([*keys, "_b2"], "_b1", "_s1")).join(two, [*keys, "_b2"]).select(*keys, "_b1", (F.col("_e1") + F.col("_e2")).alias("_base"))
    rows = rows.withColumn("_inner", earlier([*keys, "_b1"], order, value))
    return rows.join(one, [*keys, "_b1"]).withColumn("before", F.col("_base") + F.col("_inner")).drop(*levels, "_inner", "_base")

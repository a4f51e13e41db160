"""Sessions, test tables and lineage cuts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataq")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder named by spark.checkpoint.dir.

    Only where a local session names no folder (tests on one machine) a temporary one is used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strataq-"))
    return df.checkpoint(eager)


def let(value: Column, body) -> Column:
    """Bind a column to a lambda variable, so that it is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``, ties broken by the remaining comparable columns.

    Null keys are dropped, as they identify nothing. It aggregates on the map side before its one shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = order + [c for c in rest if c not in order]
    packed = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    packed = packed.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_latest"))
    return packed.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest])

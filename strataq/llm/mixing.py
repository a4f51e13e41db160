"""Sources mixed to target shares of the tokens (problem 6).

Every document gets a hash-random key; within each source documents stand in the order of their keys, cut into ranges of keys
of about equal size; prefix sums of the tokens run through the ranges, and each source is cut at its exact budget. A source
whose budget exceeds its tokens goes through further epochs, up to its cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.tokens import source_key
from strataq.operators.prefix import prefix_sums

#: Keys are whole numbers below KEYS; a range of keys is key * ranges / KEYS.
KEYS = 1 << 52
#: Up to so many targets the budgets are broadcast, some 50 bytes each.
MANY_SOURCES = 100_000


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, documents, available, budget), one row per target source.

    The total is the largest at which every source that has tokens can give its share within its cap, or ``total_tokens`` if
    that is less. A source without tokens gets nothing, and the others keep their proportions: ``share`` is the share among
    those. Shares that are null or not positive count as 0, caps below 1 or null as 1; targets that are spelled alike add up.
    """
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats")
    )
    have = sizes.where("tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    rows = want.join(have, "source", "left").fillna({"documents": 0, "available": 0})
    everything = W.partitionBy(F.lit(0))  # the targets: a handful of rows
    live = (F.col("available") > 0) & (F.col("target_share") > 0)
    rows = rows.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(everything)).otherwise(0.0))
    most = F.min(F.when(live, F.col("available") * F.col("max_repeats") / F.col("share"))).over(everything)
    total = F.coalesce(most if total_tokens is None else F.least(most, F.lit(float(total_tokens))), F.lit(0.0))
    budget = F.least(F.floor(F.col("share") * total + F.lit(1e-6)), F.col("available") * F.col("max_repeats"))
    return rows.withColumn("budget", budget.cast("long"))


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, range_documents: int = 20_000, seed: int = 42) -> DataFrame:
    """(source, doc_id, epoch, tokens, key) of every use of a document; epochs count from 1.

    ``sizes`` is (doc_id, source, tokens), best checkpointed. Documents come whole, so a source ends within half a document
    of its budget. Documents without tokens or with a null id and sources without a target give no rows; rows of
    one doc_id each count, so ``sizes`` should hold it once. Other columns are not looked at. Ranges of keys hold about
    ``range_documents`` documents whatever their source, as the keys are uniform; ties of the key are broken by doc_id. The
    budgets, one row per target source, are broadcast up to MANY_SOURCES targets; beyond that Spark decides.
    """
    sizes = sizes.where("doc_id IS NOT NULL").select("doc_id", "source", "tokens")
    n = sizes.count()
    ranges = max(1, -(-n // range_documents))
    plan = budgets(sizes, targets, total_tokens).where("budget > 0").select("source", "available", "budget", "max_repeats")
    if targets.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES:
        plan = F.broadcast(plan)
    rows = sizes.where("tokens > 0").join(plan, "source")
    rows = rows.withColumn("key", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(KEYS)))
    rows = rows.withColumn("range", F.floor(F.col("key") / F.lit(KEYS / ranges)).cast("long"))
    by = prefix_sums(rows.groupBy("source", "range").agg(F.sum("tokens").alias("tokens")), ["source"], "range", "tokens")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("tokens").over(inside)).join(by.select("source", "range", "before"), ["source", "range"])
    whole = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - whole * F.col("available")
    middle = F.col("before") + F.col("_upto") - F.col("tokens") / 2
    uses = whole + F.when(middle <= rest, 1).otherwise(0)  # the cut nearest to the budget
    uses = F.least(uses, F.col("max_repeats")).cast("int")
    rows = rows.withColumn("_uses", uses).where("_uses > 0")
    return rows.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("_uses"))).alias("epoch"), "tokens", "key")


def mixture_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: its share, budget and what was reached."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("epoch").alias("most_uses"), F.count("*").alias("uses"))
    rows = plan.join(got, "source", "left").fillna({"tokens": 0, "most_uses": 0, "uses": 0})
    actual = F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), 6)
    return rows.select("source", "target_share", F.round("share", 6).alias("share"), "max_repeats", "documents", "available", "budget", "tokens", "uses", "most_uses", F.coalesce(actual, F.lit(0.0)).alias("actual_share"))

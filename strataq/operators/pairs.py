"""Pairs of questions and municipalities: keys, joins, sampling, splitting and batching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.text import id_key
from strataq.operators.prefix import prefix_sums

#: The sources that have a folder, of their own name.
FOLDERS = ["ordinet", "legalpress", "codelibrary"]
#: So many ids go into one literal.
BLOCK = 10_000


def muni_key(unit: Column, census: Column, state: Column) -> Column:
    return F.concat(unit, F.lit("#"), census.cast("string"), F.lit("#"), state)


def text_path(root: str, source: Column, state: Column, key: Column) -> Column:
    """root/source/state/key.json; null for a source without a folder."""
    folder = F.lower(F.trim(source))
    return F.when(folder.isin(FOLDERS), F.concat(F.lit(f"{root}/"), folder, F.lit("/"), state, F.lit("/"), key, F.lit(".json")))


def resolved_paths(munis: DataFrame, root: str) -> DataFrame:
    """(muni, path, error): a source without a folder makes an error row, and so does a missing one."""
    path = text_path(root, F.col("source"), F.col("state"), F.col("muni"))
    return munis.select("muni", path.alias("path"), F.when(path.isNull(), F.concat(F.lit("no folder for source "), F.coalesce("source", F.lit("null")))).alias("error"))


def with_tree(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """Pairs with the tree of their municipality (muni, tree_json); a missing tree makes an error row."""
    out = pairs.join(trees.select("muni", "tree_json"), "muni", "left")
    return out.withColumn("error", F.when(F.col("tree_json").isNull(), F.lit("no tree")))


def municipalities(sample: DataFrame) -> DataFrame:
    """Distinct municipalities by key, with the least source that is not null."""
    keyed = sample.select(muni_key(F.col("unit_name"), F.col("census_id"), F.col("state")).alias("muni"), "state", F.lower(F.trim("source")).alias("source"))
    return keyed.where("muni IS NOT NULL").groupBy("muni", "state").agg(F.min("source").alias("source"))


def all_pairs(munis: DataFrame, questions: DataFrame) -> DataFrame:
    """Every municipality with every question. The questions are a stated set: their ids become literals that each row explodes."""
    # In blocks of BLOCK ids, however many there are.
    ids = [r[0] for r in questions.where("question_id IS NOT NULL").select("question_id").distinct().orderBy("question_id").toLocalIterator()]
    blocks = [ids[i : i + BLOCK] for i in range(0, max(1, len(ids)), BLOCK)]
    parts = [munis.select("muni", F.explode(F.array(*[F.lit(i) for i in part]).cast("array<string>")).alias("question_id")) for part in blocks]
    return reduce(DataFrame.unionByName, parts)


def reversed_queue(queue: DataFrame, place: str) -> DataFrame:
    """The queue from its last pair to its first."""
    return queue.orderBy(F.col(place).desc())


def select_municipalities(sample: DataFrame, embedded: DataFrame, size: int | None = None, nodes: int = 1, seed: str = "42") -> DataFrame:
    """(muni, node): the municipalities of the sample that are embedded, ``size`` of them by hash if given, in contiguous slices per node.

    Every node draws the same sample before it takes its slice.
    """
    found = municipalities(sample).join(embedded.select("muni"), "muni", "left_semi").select("muni")
    return node_split(found if size is None else hash_sample(found, "muni", size, seed), nodes)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, the same whatever the partitioning: those with the least md5 of seed and key."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key)))).orderBy("_h", key).limit(n).drop("_h")


def node_split(munis: DataFrame, nodes: int) -> DataFrame:
    """Contiguous slices whose sizes differ by one at most, the larger first. Municipalities are a catalogue, not data that grows."""
    return munis.withColumn("node", F.ntile(nodes).over(W.partitionBy(F.lit(0)).orderBy("muni")).cast("long"))


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its first response by time and id; null where there is none yet.

    custom_id links the two apart from its spelling; of several spellings of a request the least one stands.
    """
    keys = ["batch_id", "_key"]
    requests, responses = (d.withColumn("_key", id_key(F.col("custom_id"))) for d in (requests, responses))
    first = responses.where("response IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("received_at", "record_id")).alias("_f"), F.countDistinct("record_id").alias("answers"))
    asked = requests.groupBy(*keys).agg(F.min("custom_id").alias("custom_id"), F.min("sent_at").alias("sent_at"))
    return asked.join(first.select(*keys, "_f.record_id", "_f.received_at", "answers"), keys, "left").drop("_key").fillna({"answers": 0})


def pack_batch(queue: DataFrame, order: str, tokens: str, max_tokens: int, max_requests: int, key: list[str] | None = None) -> DataFrame:
    """The longest prefix, by ``order`` (whole numbers, each once), within both caps; what alone exceeds the cap is an error.

    Running sums come in two levels, so the queue is never gathered in one task.
    """
    over = queue.withColumn("error", F.when(F.col(tokens) > max_tokens, F.lit("larger than a batch")))
    run = prefix_sums(prefix_sums(over.withColumns({"_t": F.when(F.col("error").isNull(), F.col(tokens)).otherwise(0), "_one": F.when(F.col("error").isNull(), 1).otherwise(0)}), key or [], order, "_t").withColumnRenamed("before", "_bt"), key or [], order, "_one")
    sent = F.col("error").isNull() & (F.col("_bt") + F.col("_t") <= max_tokens) & (F.col("before") + F.col("_one") <= max_requests)
    return run.withColumn("sent", sent).withColumn("running", F.col("_bt") + F.col("_t")).drop("_t", "_one", "_bt", "before")


def captured(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results, and (record_id, error) of the rows that failed: an error text, a status of 400 or more, or no response; each record once."""
    status = F.when(F.col("status_code") >= 400, F.concat(F.lit("status "), F.col("status_code").cast("string")))
    reason = F.coalesce(F.col("error"), status, F.when(F.col("response").isNull(), F.lit("no response")))
    failed = responses.where(reason.isNotNull()).groupBy("record_id").agg(F.min(reason).alias("error"))
    return responses.where(reason.isNull()), failed


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def expired(rows: DataFrame, at: str, now: str, days: int = 7) -> DataFrame:
    return rows.where(F.col(at) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))

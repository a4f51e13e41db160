"""Answers: parsing of free text and of tool calls, and aggregation by vote and median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import after_marker, strict_float, strip

DISTRICTS = "array<struct<district_name:string,min_lot_size:bigint,unit:string,estate:boolean>>"
UNKNOWN = "I DON'T KNOW"


def parse_answers(rows: DataFrame, text: str = "content", kind: str = "question_type") -> DataFrame:
    """Append answer_text, dont_know, answer_bool, answer_num and needs_parse.

    Only the segment after the first marker counts. Exactly UNKNOWN is a don't-know; Binary takes exactly YES or NO, Numerical
    a strict number. Any other text, and every size list, needs a parse by a model. Nulls need one too.
    """
    answer = after_marker(F.col(text))
    out = rows.withColumn("answer_text", answer).withColumn("_up", F.upper("answer_text"))
    unknown = F.coalesce(F.col("_up") == UNKNOWN, F.lit(False))
    yes_no = F.when((F.col(kind) == "Binary") & F.col("_up").isin("YES", "NO"), F.initcap(F.lower("_up")))
    number = F.when((F.col(kind) == "Numerical") & ~unknown, strict_float(F.col("answer_text")))
    out = out.withColumns({"dont_know": unknown, "answer_bool": yes_no, "answer_num": number})
    return out.withColumn("needs_parse", ~F.col("dont_know") & F.col("answer_bool").isNull() & F.col("answer_num").isNull()).drop("_up")


def parse_calls(rows: DataFrame, arguments: str = "arguments") -> DataFrame:
    """Append valid, dont_know and answer of a tool call. Missing don't-know counts as one, and so do broken arguments."""
    valid = F.try_parse_json(F.col(arguments)).isNotNull() & F.coalesce(F.substring(F.ltrim(F.col(arguments)), 1, 1) == "{", F.lit(False))
    known = F.get_json_object(arguments, "$.Dont_Know")
    return rows.withColumns(
        {
            "valid": valid,
            "dont_know": F.when(valid, F.coalesce(F.lower(known) == "true", F.lit(True))).otherwise(True),
            "answer": F.when(valid, F.get_json_object(arguments, "$.Answer")),
        }
    )


def districts(rows: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """One row per district of a size answer; answers that are no list give none."""
    return rows.select(*keys, F.posexplode(F.from_json(F.col(answer), DISTRICTS)).alias("pos", "_d")).select(*keys, F.col("pos").cast("long").alias("pos"), "_d.*")


def vote(rows: DataFrame, keys: list[str], answer: str = "answer", dont_know: str = "dont_know") -> DataFrame:
    """Majority of yes and no among known answers; a tie, or none, is a don't-know."""
    valid = ~F.coalesce(F.col(dont_know), F.lit(True))
    low = F.lower(F.col(answer))
    sums = rows.groupBy(*keys).agg(F.count_if(valid & (low == "yes")).alias("yes"), F.count_if(valid & (low == "no")).alias("no"))
    winner = F.when(F.col("yes") > F.col("no"), "Yes").when(F.col("no") > F.col("yes"), "No")
    return sums.select(*keys, "yes", "no", winner.alias("answer"), winner.isNull().alias("dont_know"))


def median_answer(rows: DataFrame, keys: list[str], answer: str = "answer", dont_know: str = "dont_know") -> DataFrame:
    """Median of the known numbers, the mean of the middle two of an even count; none is a don't-know.

    Values are counted first, so that a group moves as its distinct values, whatever its rows; the median is then exact.
    """
    number = F.when(~F.coalesce(F.col(dont_know), F.lit(True)), strict_float(F.col(answer).cast("string")))
    counted = rows.groupBy(*keys, number.alias("_x")).agg(F.count("*").alias("_n"))
    out = counted.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_n"))), F.lit(0)).alias("answers"), F.percentile("_x", 0.5, F.col("_n")).alias("answer"))
    return out.select(*keys, "answers", "answer", F.col("answer").isNull().alias("dont_know"))


def aggregate_answers(rows: DataFrame, keys: list[str], kind: str = "question_type") -> DataFrame:
    """Vote for Binary, median for Numerical, the first by ``location`` for Lot Size; any other kind is an error row."""
    same = [*keys, kind]
    text = lambda d: d.select(*same, F.col("answer").cast("string").alias("answer"), "dont_know")
    binary = text(vote(rows.where(F.col(kind) == "Binary"), same))
    numbers = text(median_answer(rows.where(F.col(kind) == "Numerical"), same))
    first = rows.where(F.col(kind) == "Lot Size").groupBy(*same).agg(F.min(F.struct("location", "answer", "dont_know")).alias("_f"))
    lots = first.select(*same, "_f.answer", "_f.dont_know")
    other = rows.where(F.col(kind).isNull() | ~F.col(kind).isin("Binary", "Numerical", "Lot Size")).select(*same).distinct()
    errors = other.select(*same, F.lit(None).cast("string").alias("answer"), F.lit(True).alias("dont_know")).withColumn("error", F.lit("unsupported question type"))
    good = binary.unionByName(numbers).unionByName(lots).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors)


def clean_subtask(text: Column) -> Column:
    """Heading marks out, the longer ones first."""
    return strip(F.replace(F.replace(text, F.lit("###"), F.lit("")), F.lit("##"), F.lit("")))

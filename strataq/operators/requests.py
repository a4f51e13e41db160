"""Prompts and requests, and their wire form."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import after_marker, csv_ids, strip

FUNCTIONS = {"Binary": "answer_question_yes_no", "Numerical": "answer_question_numerical", "Lot Size": "answer_question_lot_size_residential"}


def format_prompt(**sections: Column) -> Column:
    """``#Name:`` and its text per section, a blank line between, in the order given; null sections are left out."""
    return F.concat_ws("\n\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"#{k}:\n"), v)) for k, v in sections.items()])


def custom_id(muni: Column, kind: str, question_id: Column, location: Column | None = None) -> Column:
    parts = [muni, F.lit(f"_{kind}_"), question_id]
    return F.concat(*parts, *([F.lit("_"), location.cast("string")] if location is not None else []))


def function_name(kind: Column) -> Column:
    """The tool by question type; null for any other type."""
    out = F.lit(None).cast("string")
    for k, v in FUNCTIONS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def request(id_: Column, model: str, system: Column, user: Column, n: int = 1, temperature: float | None = 0.0, seed: int | None = 42, top_p: float | None = None, tools: Column | None = None, tool_choice: Column | None = None) -> Column:
    """The request as JSON text; options that are null are left out."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    null = F.lit(None).cast("string")
    body = F.struct(
        F.lit(model).alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), F.lit(n).alias("n"), F.lit(temperature).cast("double").alias("temperature"),
        F.lit(seed).cast("int").alias("seed"), F.lit(top_p).cast("double").alias("top_p"), (tools if tools is not None else null).alias("tools"), (tool_choice if tool_choice is not None else null).alias("tool_choice"),
    )
    return F.to_json(F.struct(id_.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def match_subtasks(questions: DataFrame, subtasks: DataFrame) -> DataFrame:
    """The first subtask, by ordinal, whose comma-separated list holds the question's id. Ids are texts."""
    each = subtasks.where("subtask_questions IS NOT NULL").select("ordinal", "instructions", "description", F.explode(csv_ids(F.col("subtask_questions"))).alias("question_id"))
    first = each.groupBy("question_id").agg(F.min(F.struct("ordinal", "instructions", "description")).alias("_f")).select("question_id", "_f.*")
    return questions.join(first, "question_id", "left")


def with_background(questions: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Append background and error: it may be missing for Numerical questions only."""
    out = questions.join(backgrounds.groupBy("question_id").agg(F.max("text").alias("background")), "question_id", "left")
    must = F.col("question_type").isin("Binary", "Lot Size") & F.col("background").isNull()
    return out.withColumn("error", F.when(must, F.lit("no background")))


def keywords(wide: DataFrame, columns: list[str]) -> DataFrame:
    """One column per question, rows in priority order, to (question_id, priority, keyword); nulls and blanks go."""
    long = wide.unpivot("priority", columns, "question_id", "keyword")
    return long.where(F.col("keyword").isNotNull() & (strip(F.col("keyword")) != ""))


def tool(kind: Column) -> Column:
    """The tool that a parse must call, as JSON, by question type; null for any other type."""
    out = F.lit(None).cast("string")
    for k, answer in ANSWERS.items():
        out = F.when(kind == k, F.lit(json.dumps(tool_template(FUNCTIONS[k], answer)))).otherwise(out)
    return out


def tool_template(name: str, answer: dict) -> dict:
    fields = {"Dont_Know": {"type": "boolean", "description": "Whether the answer is unknown"}, "Answer": answer}
    return {"type": "function", "function": {"name": name, "parameters": {"type": "object", "properties": fields, "required": ["Dont_Know"]}}}


#: The answer that each kind of question takes.
ANSWERS = {
    "Binary": {"type": "string", "enum": ["Yes", "No"]},
    "Numerical": {"type": "integer"},
    "Lot Size": {"type": "array", "items": {"type": "object", "properties": {"district_name": {"type": "string"}, "min_lot_size": {"type": "integer"}, "unit": {"type": "string"}, "estate": {"type": "boolean"}}}},
}


def question_requests(pairs: DataFrame, system: Column, model: str = "offline", double_check: bool = False) -> DataFrame:
    """Append custom_id, prompt, request and error to pairs (muni, question_id, question_rephrase, double_check_question, background, context[, subtask, subtask_answer]).

    The question is asked in its rephrased form, or by its double-check question; a blank one, or a null context, is an error. The
    answer of a subtask comes last, under the subtask's description.
    """
    asked = F.col("double_check_question" if double_check else "question_rephrase")
    asked = F.when(strip(asked) != "", asked)
    prompt = format_prompt(Question=asked, Background=F.col("background"), Context=F.col("context"))
    if "subtask" in pairs.columns:
        prompt = F.concat_ws("\n\n", prompt, F.when(F.col("subtask_answer").isNotNull(), F.concat(F.lit("#"), F.col("subtask"), F.lit(":\n"), F.col("subtask_answer"))))
    error = F.when(asked.isNull(), F.lit("no question")).when(F.col("context").isNull(), F.lit("no context"))
    out = pairs.withColumn("custom_id", custom_id(F.col("muni"), "main", F.col("question_id"))).withColumn("error", error).withColumn("prompt", F.when(error.isNull(), prompt))
    return out.withColumn("request", F.when(F.col("error").isNull(), request(F.col("custom_id"), model, system, F.col("prompt"))))


def subtask_requests(pairs: DataFrame, system: Column, model: str = "offline") -> DataFrame:
    """Append custom_id, prompt and request of the subtask to pairs (muni, question_id, instructions, context); pairs without instructions get none."""
    prompt = format_prompt(**{"System Info": system, "Question": F.col("instructions"), "Context": F.col("context")})
    out = pairs.withColumn("custom_id", custom_id(F.col("muni"), "subtask", F.col("question_id"))).withColumn("prompt", F.when(F.col("instructions").isNotNull(), prompt))
    return out.withColumn("request", F.when(F.col("prompt").isNotNull(), request(F.col("custom_id"), model, system, F.col("prompt"))))


def parse_requests(answers: DataFrame, system: Column, model: str = "offline") -> DataFrame:
    """Append custom_id, prompt and request to free answers (muni, question_id, question_type, location, content).

    What stands behind the marker is to be parsed, the whole answer if there is none; the question's type decides on the tool. A type
    without a tool is an error row.
    """
    prompt = F.coalesce(after_marker(F.col("content")), F.col("content"))
    choice = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(function_name(F.col("question_type")).alias("name")).alias("function")))
    out = answers.withColumn("custom_id", custom_id(F.col("muni"), "parse", F.col("question_id"), F.col("location"))).withColumn("prompt", prompt)
    out = out.withColumn("error", F.when(function_name(F.col("question_type")).isNull(), F.lit("unsupported question type")))
    made = request(F.col("custom_id"), model, system, F.col("prompt"), tools=tool(F.col("question_type")), tool_choice=choice)
    return out.withColumn("request", F.when(F.col("error").isNull(), made))

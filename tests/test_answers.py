import json
import random
from statistics import median

import pytest

from strataq.operators import answers as A
from strataq.operators import requests as Q
from strataq.queries import answers as Q_answers
from strataq.functions.text import join_keywords, strict_float, strip
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("x ANSWER: YES", "Binary", (False, "Yes", None, False)), ("ANSWER: yes ", "Binary", (False, "Yes", None, False)), ("ANSWER: YES.", "Binary", (False, None, None, True)), ("no marker", "Binary", (False, None, None, True)),
        ("ANSWER: NO ANSWER: YES", "Binary", (False, "No", None, False)), ("ANSWER: I don't know", "Lot Size", (True, None, None, False)), ("ANSWER: I DON’T KNOW", "Binary", (False, None, None, True)),
        ("ANSWER: 3", "Numerical", (False, None, 3.0, False)), ("ANSWER: 1,000", "Numerical", (False, None, None, True)), ("ANSWER: 5 acres", "Numerical", (False, None, None, True)), ("ANSWER: 1e3", "Numerical", (False, None, 1000.0, False)),
        ("ANSWER: nan", "Numerical", (False, None, None, True)), ("ANSWER: 5d", "Numerical", (False, None, None, True)), ("ANSWER: 0x1p3", "Numerical", (False, None, None, True)), ("ANSWER:   7  ", "Numerical", (False, None, 7.0, False)),
        ("ANSWER: R-1, 1, Acres, No", "Lot Size", (False, None, None, True)), (None, "Binary", (False, None, None, True)), ("", None, (False, None, None, True)),
    ],
)
def test_parse_of_one_answer(spark, text, kind, want):
    r = A.parse_answers(spark.createDataFrame([(text, kind)], "content string, question_type string")).first()
    assert (r["dont_know"], r["answer_bool"], r["answer_num"], r["needs_parse"]) == want


def test_tool_calls(spark):
    rows = ['{"Dont_Know":false,"Answer":"Yes"}', '{"Answer":"No"}', '{"Dont_Know":"false","Answer":3}', '{"Dont_Know":true}', "{broken", None, "[1]"]
    got = [tuple(r)[1:] for r in A.parse_calls(spark.createDataFrame([(x,) for x in rows], "arguments string")).collect()]
    assert got == [(True, False, "Yes"), (True, True, "No"), (True, False, "3"), (True, True, None), (False, True, None), (False, True, None), (False, True, None)]


def test_vote_and_median_against_loops(spark):
    r = random.Random(8)
    rows = [(f"q{r.randrange(12)}", r.choice(["yes", "No", "YES", "maybe", None]), r.random() < 0.3) for _ in range(200)]
    for x in A.vote(spark.createDataFrame(rows, "k string, answer string, dont_know boolean"), ["k"]).collect():
        mine = [(a or "").lower() for k, a, d in rows if k == x["k"] and not d]
        y, n = mine.count("yes"), mine.count("no")
        assert (x["answer"], x["dont_know"]) == ("Yes" if y > n else "No" if n > y else None, y == n)
    rows = [(f"q{r.randrange(9)}", r.choice(["1", "2.5", "10", "x", None, "1e2"]), r.random() < 0.3) for _ in range(150)] + [("none", "x", False)]
    for x in A.median_answer(spark.createDataFrame(rows, "k string, answer string, dont_know boolean"), ["k"]).collect():
        mine = [float(a) for k, a, d in rows if k == x["k"] and not d and a not in (None, "x")]
        assert x["answer"] == (median(mine) if mine else None) and x["dont_know"] == (not mine)


def test_dispatch_has_an_error_row_for_other_types(spark):
    rows = [("a", "Binary", "Yes", False, 0), ("b", "Numerical", "4", False, 0), ("c", "Lot Size", "[2]", False, 1), ("c", "Lot Size", "[1]", False, 0), ("d", "Odd", "x", False, 0), ("e", None, "x", False, 0)]
    got = {r["k"]: (r["answer"], r["error"]) for r in A.aggregate_answers(spark.createDataFrame(rows, "k string, question_type string, answer string, dont_know boolean, location int"), ["k"]).collect()}
    assert got == {"a": ("Yes", None), "b": ("4.0", None), "c": ("[1]", None), "d": (None, "unsupported question type"), "e": (None, "unsupported question type")}


CALLS = "record_id bigint, custom_id string, response struct<body: struct<choices: array<struct<index: int, message: struct<content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>>>>"


def write_calls(spark, path, calls):
    rows = [(i, custom_id, (([(0, (None, [((None, f'{{"Dont_Know":false,"Answer":{answer}}}'),)]))],),)) for i, custom_id, answer in calls]
    spark.createDataFrame(rows, CALLS).write.parquet(f"{path}/api_response.parquet")
    spark.createDataFrame([("1", "Binary"), ("4a", "Numerical"), ("23", "Lot Size")], "id string, question_type string").write.parquet(f"{path}/question.parquet")
    return str(path)


def test_dispatch_takes_the_first_size_list_by_location(spark, tmp_path):
    lots = [(1, "Elm#7#tessaly_parse_23_10", "[10]"), (2, "ELM%237#tessaly_parse_23_2 ", "[2]"), (3, "Elm#7#tessaly_parse_23_2", "[3]"), (4, "Elm#7#tessaly_parse_1_0", '"Yes"')]
    rows = Q_answers.aggregate_dispatch(spark, write_calls(spark, tmp_path, lots)).collect()
    assert {(r["question_id"], r["question_type"], r["answer"], r["dont_know"]) for r in rows} == {("23", "Lot Size", "[2]", False), ("1", "Binary", "Yes", False)}


def test_aggregates_are_those_of_a_pair(spark, tmp_path):
    a, b = ["Old Elm#7#north alder", "OLD%20ELM%237#north alder"], ["Ash#8#tessaly"] * 2
    binary = [(a[0], '"Yes"'), (a[1], '"Yes"'), (a[0], '"No"'), (b[0], '"No"'), (b[1], '"Yes"')]
    numbers = [(a[0], 1), (a[1], 4), (b[0], 9), (b[0], 10), (b[1], 40)]
    lots = [(b[0], "[8]"), (a[1], "[7]"), (a[0], "[6]")]
    calls = [(m, q, i, x) for q, xs in (("1", binary), ("4a", numbers), ("23", lots)) for i, (m, x) in enumerate(xs)]
    d = write_calls(spark, tmp_path, [(n, f"{m}_parse_{q}_{i}", x) for n, (m, q, i, x) in enumerate(calls)])
    elm, ash = "old_elm_7_north_alder", "ash_8_tessaly"
    assert {tuple(r) for r in Q_answers.vote_binary(spark, d).collect()} == {(elm, "1", 2, 1, "Yes", False), (ash, "1", 1, 1, None, True)}
    assert {tuple(r) for r in Q_answers.median_numeric(spark, d).collect()} == {(elm, "4a", 2, 2.5, False), (ash, "4a", 3, 10.0, False)}
    got = {(r["muni"], r["question_id"]): (r["answer"], r["dont_know"]) for r in Q_answers.aggregate_dispatch(spark, d).collect()}
    assert got == {(elm, "1"): ("Yes", False), (ash, "1"): (None, True), (elm, "4a"): ("2.5", False), (ash, "4a"): ("10.0", False), (elm, "23"): ("[7]", False), (ash, "23"): ("[8]", False)}


def test_prompts_requests_and_lookups(spark):
    one = spark.range(1)
    assert one.select(Q.format_prompt(Question=F.lit("q"), Background=F.lit(None).cast("string"), Context=F.lit("c")).alias("p")).first()["p"] == "#Question:\nq\n\n#Context:\nc"
    text = one.select(Q.request(F.lit("m_main_1"), "x", F.lit("s"), F.lit("u")).alias("r")).first()["r"]
    assert '"seed":42' in text and "top_p" not in text and "tools" not in text
    wide = spark.createDataFrame([(1, "a", None), (2, " ", "b")], "priority int, `1` string, `2w` string")
    assert {tuple(r) for r in Q.keywords(wide, ["1", "2w"]).collect()} == {(1, "1", "a"), (2, "2w", "b")}
    row = spark.createDataFrame([("  a\tb \n", "1_000", "Fees (building permit), parking")], "a string, b string, c string").select(strip(F.col("a")), strict_float(F.col("b")), join_keywords(F.col("c"), ["building permit"])).first()
    assert tuple(row) == ("a\tb", None, "fees  building_permit   parking")
    assert one.select(A.clean_subtask(F.lit("### A\n## B"))).first()[0] == "A\n B"


def test_requests_of_questions_subtasks_and_answers(spark):
    cols = "muni string, question_id string, question_rephrase string, double_check_question string, background string, context string, subtask string, subtask_answer string"
    rows = [("m", "1", "May I?", "Surely?", "Houses.", "##a", "uses", "barns"), ("m", "2", " ", None, None, "##a", None, None), ("m", "3", "How?", " ", None, None, None, None), ("m", "4", "How?", "So?", None, "", "uses", None)]
    pairs = spark.createDataFrame(rows, cols)
    main = {r["question_id"]: r for r in Q.question_requests(pairs, F.lit("sys")).collect()}
    assert main["1"]["prompt"] == "#Question:\nMay I?\n\n#Background:\nHouses.\n\n#Context:\n##a\n\n#uses:\nbarns" and main["1"]["custom_id"] == "m_main_1"
    assert [m["content"] for m in json.loads(main["1"]["request"])["body"]["messages"]] == ["sys", main["1"]["prompt"]]
    assert main["2"]["error"] == "no question" and main["3"]["error"] == "no context" and main["2"]["request"] is None and main["4"]["prompt"] == "#Question:\nHow?\n\n#Context:\n"
    again = {r["question_id"]: (r["error"], r["prompt"]) for r in Q.question_requests(pairs, F.lit("sys"), double_check=True).collect()}
    assert again["1"][1].startswith("#Question:\nSurely?") and again["2"][0] == again["3"][0] == "no question"
    sub = {r["question_id"]: r for r in Q.subtask_requests(pairs.withColumn("instructions", F.when(F.col("question_id") == "1", "find")), F.lit("sys")).collect()}
    assert sub["1"]["prompt"] == "#System Info:\nsys\n\n#Question:\nfind\n\n#Context:\n##a" and sub["1"]["custom_id"] == "m_subtask_1" and sub["2"]["request"] is None
    free = [("m", "1", "Binary", 0, "well. ANSWER: YES ANSWER: x"), ("m", "2", "Numerical", 3, "no marker"), ("m", "3", "Lot Size", 1, None), ("m", "4", "Odd", 0, "z"), ("m", "5", None, 0, "z")]
    out = {r["question_id"]: r for r in Q.parse_requests(spark.createDataFrame(free, "muni string, question_id string, question_type string, location int, content string"), F.lit("sys")).collect()}
    body = json.loads(out["1"]["request"])["body"]
    assert out["1"]["prompt"] == "YES" and out["2"]["prompt"] == "no marker" and out["2"]["custom_id"] == "m_parse_2_3" and out["3"]["prompt"] is None
    assert json.loads(body["tools"])["function"]["name"] == json.loads(body["tool_choice"])["function"]["name"] == "answer_question_yes_no"
    assert out["4"]["error"] == out["5"]["error"] == "unsupported question type" and out["4"]["request"] is None


def test_keywords_of_a_sheet(spark):
    sheet = spark.createDataFrame([(1, "barn", None), (2, " ", "fence"), (3, "shed", "yard")], "priority int, `4a` string, `7` string")
    got = {(r["question_id"], r["priority"], r["keyword"]) for r in Q.keywords(sheet, ["4a", "7"]).collect()}
    assert got == {("4a", 1, "barn"), ("4a", 3, "shed"), ("7", 2, "fence"), ("7", 3, "yard")}

"""Queries on answers, requests and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.text import id_key, token_len
from strataq.operators import answers as A
from strataq.operators import pairs as P
from strataq.operators import requests as Q
from strataq.providers import complete_requests
from strataq.session import table
from strataq.sources.wire import RESULT, parse_results

KIND = r"_(main|subtask|parse)_"


def _choices(spark, sf_dir):
    rows = table(spark, sf_dir, "api_response").where("response IS NOT NULL").select("record_id", id_key(F.col("custom_id")).alias("custom_id"), F.explode("response.body.choices").alias("_c"))
    qid = F.regexp_extract("custom_id", r"_(?:main|subtask|parse)_([0-9a-z]+)", 1)
    muni = F.regexp_extract("custom_id", r"^(.*?)_(?:main|subtask|parse)_", 1)  # in the spelling of id_key
    rows = rows.select("record_id", "custom_id", muni.alias("muni"), F.regexp_extract("custom_id", KIND, 1).alias("kind"), qid.alias("question_id"), F.col("_c.index").cast("long").alias("choice"), F.col("_c.message.content").alias("content"),
                       F.try_element_at(F.col("_c.message.tool_calls"), F.lit(1))["function"]["arguments"].alias("arguments"))
    types = table(spark, sf_dir, "question").select(F.col("id").alias("question_id"), "question_type")
    return rows.join(types, "question_id")


def _main(spark, sf_dir):
    """Parsed first, so that repeated rows are dropped without moving whole answers."""
    rows = A.parse_answers(_choices(spark, sf_dir).where("kind = 'main' AND content IS NOT NULL"))
    return rows.drop("content", "arguments").dropDuplicates(["record_id", "choice"])


def answer_extract(spark, sf_dir):
    return _main(spark, sf_dir).select("record_id", "choice", "answer_text")


def answer_parse_binary(spark, sf_dir):
    return _main(spark, sf_dir).where("question_type = 'Binary'").select("record_id", "choice", "dont_know", "answer_bool")


def answer_parse_numeric(spark, sf_dir):
    return _main(spark, sf_dir).where("question_type = 'Numerical'").select("record_id", "choice", "dont_know", "answer_num")


def answer_needs_llm(spark, sf_dir):
    return _main(spark, sf_dir).groupBy("question_type").agg(F.count_if("needs_parse").alias("needs_parse"), F.count("*").alias("answers"))


def _calls(spark, sf_dir):
    rows = A.parse_calls(_choices(spark, sf_dir).where("kind = 'parse'"))
    return rows.drop("content", "arguments").dropDuplicates(["record_id", "choice"])


def tool_json_parse(spark, sf_dir):
    return _calls(spark, sf_dir).where("question_type <> 'Lot Size'").select("record_id", "choice", "valid", "dont_know", F.when(F.col("answer") != "", F.col("answer")).alias("answer"))


def lot_size_explode(spark, sf_dir):
    return A.districts(_calls(spark, sf_dir).where("question_type = 'Lot Size' AND valid"), ["record_id", "choice"])


#: What is aggregated: the parsed responses of one municipality to one question.
PAIR = ["muni", "question_id"]


def vote_binary(spark, sf_dir):
    return A.vote(_calls(spark, sf_dir).where("question_type = 'Binary'"), PAIR)


def median_numeric(spark, sf_dir):
    return A.median_answer(_calls(spark, sf_dir).where("question_type = 'Numerical'"), PAIR)


def _location() -> Column:
    """The number at the end of custom_id, last if there is none; of equal ones the least record and choice come first."""
    number = F.regexp_extract("custom_id", "_([0-9]+)$", 1).try_cast("long")
    return F.struct(F.coalesce(number, F.lit(2**63 - 1)).alias("number"), "record_id", "choice")


def aggregate_dispatch(spark, sf_dir):
    rows = _calls(spark, sf_dir).withColumn("location", _location())
    out = A.aggregate_answers(rows, PAIR)
    return out.select(*PAIR, "question_type", F.when(F.col("question_type") == "Numerical", F.round(F.col("answer").try_cast("double"), 6).cast("string")).otherwise(F.col("answer")).alias("answer"), "dont_know")


def subtask_clean(spark, sf_dir):
    rows = _choices(spark, sf_dir).where("kind = 'subtask' AND content IS NOT NULL")
    return rows.select("record_id", "choice", A.clean_subtask(F.col("content")).alias("text")).dropDuplicates(["record_id", "choice"])


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "question").withColumnRenamed("id", "question_id")


def prompt_format(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(Q.format_prompt(Question=F.col("heading"), Background=F.col("source"), Context=F.col("text"))).alias("prompt_md5"))


def request_custom_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("muni IS NOT NULL")
    return d.select("doc_id", Q.custom_id(F.col("muni"), "main", F.col("doc_id").cast("string")).alias("main_id"), Q.custom_id(F.col("muni"), "parse", F.col("doc_id").cast("string"), F.lit(0)).alias("parse_id"))


def request_json(spark, sf_dir):
    q = _questions(spark, sf_dir)
    r = Q.request(F.col("question_id"), "offline", F.lit("Answer from the sections."), F.col("question_rephrase"))
    return q.select("question_id", F.get_json_object(r, "$.body.messages[1].content").alias("content"), F.get_json_object(r, "$.body.seed").alias("seed"), F.get_json_object(r, "$.body.top_p").alias("top_p"))


def function_type(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", Q.function_name(F.col("question_type")).alias("function"))


def subtask_match(spark, sf_dir):
    """One subtask per kind of question, behind one for all questions that ask about lots."""
    q = _questions(spark, sf_dir)
    kinds = q.where("question_type IS NOT NULL").groupBy("question_type").agg(F.array_join(F.array_sort(F.collect_list("question_id")), ", ").alias("subtask_questions"))
    lots = q.where("question_rephrase LIKE '%lot%'").agg(F.array_join(F.array_sort(F.collect_list("question_id")), " ,").alias("subtask_questions")).select(F.lit("lots").alias("question_type"), "subtask_questions")
    ordinal = F.when(F.col("question_type") == "lots", 1).when(F.col("question_type") == "Binary", 2).when(F.col("question_type") == "Numerical", 3).otherwise(4)
    s = lots.unionByName(kinds.select("question_type", "subtask_questions")).select(ordinal.alias("ordinal"), "subtask_questions", F.lit("find them").alias("instructions"), F.col("question_type").alias("description"))
    return Q.match_subtasks(q.select("question_id"), s).select("question_id", "ordinal", "description")


def background_join(spark, sf_dir):
    """A question's background is its double-check question, where it has one."""
    q = _questions(spark, sf_dir)
    b = q.where("trim(double_check_question) <> ''").select("question_id", F.col("double_check_question").alias("text"))
    return Q.with_background(q.select("question_id", "question_type"), b).select("question_id", "background", "error")


def _asked(spark, sf_dir):
    """Every document as the context of the question numbered by its id."""
    q = _questions(spark, sf_dir).where("question_id IS NOT NULL")
    n = q.count()
    numbered = q.withColumn("_n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("question_id")) - 1)  # a fixed table
    docs = table(spark, sf_dir, "documents").where("muni IS NOT NULL").select("doc_id", "muni", F.col("text").alias("context"), F.pmod("doc_id", F.lit(max(1, n))).cast("int").alias("_n"))
    return docs.join(numbered, "_n").withColumn("background", F.col("prior"))


def question_request(spark, sf_dir):
    out = Q.question_requests(_asked(spark, sf_dir), F.lit("Answer from the sections."))
    return out.select("doc_id", "custom_id", F.md5("prompt").alias("prompt_md5"), "error")


def double_check_request(spark, sf_dir):
    out = Q.question_requests(_asked(spark, sf_dir), F.lit("Answer from the sections."), double_check=True)
    return out.select("doc_id", "custom_id", F.md5("prompt").alias("prompt_md5"), "error")


def subtask_request(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumn("instructions", F.col("question_detail"))
    out = Q.subtask_requests(rows, F.lit("Be brief."))
    return out.select("doc_id", "custom_id", F.md5("prompt").alias("prompt_md5"))


def parse_request(spark, sf_dir):
    """What is asked to parse each free answer."""
    rows = _choices(spark, sf_dir).where("kind = 'main' AND content IS NOT NULL").withColumn("location", F.col("choice"))
    out = Q.parse_requests(rows, F.lit("Call the tool."))
    forced = F.get_json_object(F.get_json_object("request", "$.body.tool_choice"), "$.function.name")
    return out.select("record_id", "choice", "custom_id", F.md5("prompt").alias("prompt_md5"), forced.alias("forced")).distinct()


def municipality_selection(spark, sf_dir):
    return P.select_municipalities(table(spark, sf_dir, "muni_sample"), table(spark, sf_dir, "chunk").where("muni IS NOT NULL"), 200, 7)


def queue_reversed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return P.reversed_queue(o, "o_orderkey")


def request_tokens(spark, sf_dir):
    r = table(spark, sf_dir, "api_request").select("batch_id", "custom_id", "body.messages")
    sums = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + token_len(m["content"]))
    counted = r.select("batch_id", "custom_id", sums.alias("tokens"), F.xxhash64("messages").alias("_h"))  # a hash moves instead of the texts
    return counted.distinct().drop("_h")


def usage_totals(spark, sf_dir):
    u = table(spark, sf_dir, "api_response").where("response IS NOT NULL").select("record_id", F.col("response.body.model").alias("model"), "response.body.usage").distinct()
    return u.groupBy("model").agg(F.count("*").alias("responses"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"))


def error_capture(spark, sf_dir):
    """One error row per record that failed."""
    return P.captured(table(spark, sf_dir, "api_response").select("record_id", "error", "status_code", "response"))[1]


def batch_pack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("long").alias("tokens"))
    return P.pack_batch(o, "o_orderkey", "tokens", 250_000_000, 50_000).select("o_orderkey", "tokens", "sent")


def response_attach(spark, sf_dir):
    out = P.attach_responses(table(spark, sf_dir, "api_request"), table(spark, sf_dir, "api_response"))
    return out.select("batch_id", "custom_id", "record_id", "answers")


def sync_completion(spark, sf_dir):
    """Every question asked of the offline completer, its replies parsed by the wire schema."""
    q = _questions(spark, sf_dir).select(Q.request(Q.custom_id(F.lit("m"), "main", F.col("question_id")), "offline", F.lit("Answer from the sections."), F.col("question_rephrase")).alias("request"))
    done = complete_requests(q).select("error", F.from_json("response", RESULT).alias("_r"))
    return done.select("_r.custom_id", F.col("_r.response.status_code").alias("status_code"), F.size("_r.response.body.choices").alias("choices"), "error")


def muni_key(spark, sf_dir):
    return P.municipalities(table(spark, sf_dir, "muni_sample"))


def path_resolve(spark, sf_dir):
    return P.resolved_paths(P.municipalities(table(spark, sf_dir, "muni_sample")), "texts")


def pair_cross(spark, sf_dir):
    return P.all_pairs(P.municipalities(table(spark, sf_dir, "muni_sample")), _questions(spark, sf_dir))


def embedded_semi(spark, sf_dir):
    return P.municipalities(table(spark, sf_dir, "muni_sample")).join(table(spark, sf_dir, "chunk").select("muni"), "muni", "left_semi").select("muni")


def pending_anti(spark, sf_dir):
    return P.municipalities(table(spark, sf_dir, "muni_sample")).join(table(spark, sf_dir, "chunk").select("muni"), "muni", "left_anti").select("muni")


def embedding_catalogue(spark, sf_dir):
    return table(spark, sf_dir, "chunk").where("muni IS NOT NULL").select("muni").distinct()


def tree_lookup(spark, sf_dir):
    """Every municipality of the sample with its tree, or with an error."""
    from strataq.queries.trees import trees

    found = trees(spark, sf_dir).select(F.col("tree_id").alias("muni"), "tree_json")
    out = P.with_tree(P.municipalities(table(spark, sf_dir, "muni_sample")), found)
    return out.select("muni", "error", F.length("tree_json").isNotNull().alias("found"))


def node_split(spark, sf_dir):
    return P.node_split(P.municipalities(table(spark, sf_dir, "muni_sample")).select("muni"), 7)


def sample_hash(spark, sf_dir):
    return P.hash_sample(P.municipalities(table(spark, sf_dir, "muni_sample")).select("muni"), "muni", 100)


def testing_head(spark, sf_dir):
    """Testing mode: the first municipality and the first question."""
    first = P.municipalities(table(spark, sf_dir, "muni_sample")).orderBy("muni").limit(1)
    return P.all_pairs(first, _questions(spark, sf_dir).orderBy("question_id").limit(1))


def retention_filter(spark, sf_dir):
    return P.expired(table(spark, sf_dir, "events"), "ts", "2024-02-01 00:00:00").select("event_id")


def wire_parse(spark, sf_dir):
    """The request that each line of the result files answers; null for a broken line."""
    lines = table(spark, sf_dir, "batch_line").select("line_id", "line").where("line_id IS NOT NULL").distinct()
    return parse_results(lines).select("line_id", "custom_id")


FUNCTIONS = [
    answer_extract, answer_parse_binary, answer_parse_numeric, answer_needs_llm, tool_json_parse, lot_size_explode, vote_binary, median_numeric, aggregate_dispatch, subtask_clean,
    prompt_format, request_custom_id, request_json, function_type, subtask_match, background_join, question_request, double_check_request, subtask_request, parse_request, municipality_selection, queue_reversed, request_tokens, usage_totals, error_capture, batch_pack, response_attach, sync_completion,
    muni_key, path_resolve, pair_cross, embedded_semi, pending_anti, embedding_catalogue, tree_lookup, node_split, sample_hash, testing_head, retention_filter, wire_parse,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_S = r"[\s\x0B\x1C-\x1F\x{0085}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


_C = """WITH c AS (SELECT DISTINCT record_id, lower(trim(custom_id)) AS custom_id, unnest(response.body.choices) AS u FROM api_response WHERE response IS NOT NULL),
c2 AS (SELECT record_id, custom_id, regexp_extract(custom_id, '_(main|subtask|parse)_', 1) AS kind, regexp_extract(custom_id, '_(?:main|subtask|parse)_([0-9a-z]+)', 1) AS question_id,
  CAST(u.index AS BIGINT) AS choice, u.message.content AS content, u.message.tool_calls[1].function.arguments AS arguments FROM c),
ch AS (SELECT c2.*, q.question_type FROM c2 JOIN question q ON q.id = c2.question_id)"""
_MAIN = (
    _C
    + f""", m0 AS (SELECT *, {_strip("string_split(content, 'ANSWER:')[2]")} AS answer_text FROM ch WHERE kind = 'main' AND content IS NOT NULL),
m AS (SELECT *, coalesce(upper(answer_text) = 'I DON''T KNOW', false) AS dont_know, CASE WHEN question_type = 'Binary' AND upper(answer_text) = 'YES' THEN 'Yes' WHEN question_type = 'Binary' AND upper(answer_text) = 'NO' THEN 'No' END AS answer_bool,
  CASE WHEN question_type = 'Numerical' AND regexp_full_match(answer_text, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(answer_text AS DOUBLE) END AS answer_num FROM m0)"""
)
_P = (
    _C
    + """, p0 AS (SELECT *, json_valid(arguments) AND ltrim(arguments)[1] = '{' AS v FROM ch WHERE kind = 'parse'),
p AS (SELECT *, coalesce(v, false) AS valid, CASE WHEN v THEN coalesce(lower(json_extract_string(arguments, '$.Dont_Know')) = 'true', true) ELSE true END AS dont_know, CASE WHEN v THEN json_extract_string(arguments, '$.Answer') END AS answer FROM p0)"""
)
_KEY = "trim(regexp_replace(lower(regexp_replace({x}, '%(?:23|20|5[fF])', '#', 'g')), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"
# Per municipality, from the spelling of the key, and question.
_PAIRED = _P.replace("lower(trim(custom_id)) AS custom_id", _KEY.format(x="custom_id") + " AS custom_id") + """, pk AS (SELECT *, regexp_extract(custom_id, '^(.*?)_(?:main|subtask|parse)_', 1) AS muni,
  coalesce(TRY_CAST(nullif(regexp_extract(custom_id, '_([0-9]+)$', 1), '') AS BIGINT), 9223372036854775807) AS location FROM p)"""
_VOTE = """SELECT muni, question_id, count(*) FILTER (NOT dont_know AND lower(answer) = 'yes') AS yes, count(*) FILTER (NOT dont_know AND lower(answer) = 'no') AS no FROM pk WHERE question_type = 'Binary' GROUP BY 1, 2"""
_NUMBER = "CASE WHEN NOT dont_know AND regexp_full_match(answer, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(answer AS DOUBLE) END"
_MEDIAN = f"SELECT muni, question_id, count(x) AS answers, median(x) AS answer FROM (SELECT muni, question_id, {_NUMBER} AS x FROM pk WHERE question_type = 'Numerical') GROUP BY 1, 2"
_FIRST = "SELECT muni, question_id, arg_min(struct_pack(a := answer, d := dont_know), (location, record_id, choice)) AS f FROM pk WHERE question_type = 'Lot Size' GROUP BY 1, 2"
_MUNI = "WITH mu AS (SELECT unit_name || '#' || census_id || '#' || state AS muni, state, min(lower(trim(source))) AS source FROM muni_sample WHERE unit_name || census_id || state IS NOT NULL GROUP BY 1, 2) "
_ASKED = """WITH n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM question WHERE id IS NOT NULL),
a AS (SELECT d.doc_id, d.muni, d.text, n.* EXCLUDE (n) FROM documents d JOIN n ON n.n = d.doc_id % (SELECT count(*) FROM n) WHERE d.muni IS NOT NULL) """
_WRONG = "CASE WHEN coalesce(trim({q}), '') = '' THEN 'no question' WHEN text IS NULL THEN 'no context' END"
_PROMPT = "CASE WHEN trim({q}) <> '' AND text IS NOT NULL THEN md5(concat_ws(chr(10) || chr(10), '#Question:' || chr(10) || {q}, '#Background:' || chr(10) || prior, '#Context:' || chr(10) || text)) END"
ORACLES = {
    "answer_extract": _MAIN + " SELECT record_id, choice, answer_text FROM m",
    "answer_parse_binary": _MAIN + " SELECT record_id, choice, dont_know, answer_bool FROM m WHERE question_type = 'Binary'",
    "answer_parse_numeric": _MAIN + " SELECT record_id, choice, dont_know, answer_num FROM m WHERE question_type = 'Numerical'",
    "answer_needs_llm": _MAIN + " SELECT question_type, count(*) FILTER (NOT dont_know AND answer_bool IS NULL AND answer_num IS NULL) AS needs_parse, count(*) AS answers FROM m GROUP BY 1",
    "tool_json_parse": _P + " SELECT record_id, choice, valid, dont_know, CASE WHEN answer <> '' THEN answer END AS answer FROM p WHERE question_type <> 'Lot Size'",
    "lot_size_explode": _P
    + """ SELECT record_id, choice, CAST(i - 1 AS BIGINT) AS pos, json_extract_string(d, '$.district_name') AS district_name, TRY_CAST(json_extract_string(d, '$.min_lot_size') AS BIGINT) AS min_lot_size, json_extract_string(d, '$.unit') AS unit,
      TRY_CAST(json_extract_string(d, '$.estate') AS BOOLEAN) AS estate FROM (SELECT record_id, choice, unnest(range(1, len(ds) + 1)) AS i, unnest(ds) AS d FROM (SELECT record_id, choice, CAST(json_extract(arguments, '$.Answer') AS JSON[]) AS ds FROM p
      WHERE question_type = 'Lot Size' AND valid AND json_type(arguments, '$.Answer') = 'ARRAY'))""",
    "vote_binary": _PAIRED + f" SELECT muni, question_id, yes, no, CASE WHEN yes > no THEN 'Yes' WHEN no > yes THEN 'No' END AS answer, yes = no AS dont_know FROM ({_VOTE})",
    "median_numeric": _PAIRED + f" SELECT muni, question_id, answers, answer, answer IS NULL AS dont_know FROM ({_MEDIAN})",
    "aggregate_dispatch": _PAIRED
    + f""" SELECT muni, question_id, 'Binary' AS question_type, CASE WHEN yes > no THEN 'Yes' WHEN no > yes THEN 'No' END AS answer, yes = no AS dont_know FROM ({_VOTE})
      UNION ALL SELECT muni, question_id, 'Numerical', CAST(round(answer, 6) AS VARCHAR), answer IS NULL FROM ({_MEDIAN})
      UNION ALL SELECT muni, question_id, 'Lot Size', f.a, f.d FROM ({_FIRST})""",
    "subtask_clean": _C + f" SELECT record_id, choice, {_strip("replace(replace(content, '###', ''), '##', '')")} AS text FROM ch WHERE kind = 'subtask' AND content IS NOT NULL",
    "prompt_format": "SELECT doc_id, md5(concat_ws(chr(10) || chr(10), '#Question:' || chr(10) || heading, '#Background:' || chr(10) || source, '#Context:' || chr(10) || text)) AS prompt_md5 FROM documents",
    "request_custom_id": "SELECT doc_id, muni || '_main_' || doc_id AS main_id, muni || '_parse_' || doc_id || '_0' AS parse_id FROM documents WHERE muni IS NOT NULL",
    "request_json": "SELECT id AS question_id, question_rephrase AS content, '42' AS seed, CAST(NULL AS VARCHAR) AS top_p FROM question",
    "function_type": "SELECT id AS question_id, CASE question_type WHEN 'Binary' THEN 'answer_question_yes_no' WHEN 'Numerical' THEN 'answer_question_numerical' WHEN 'Lot Size' THEN 'answer_question_lot_size_residential' END AS function FROM question",
    "subtask_match": """WITH s AS (SELECT id, 1 AS ordinal, 'lots' AS description FROM question WHERE question_rephrase LIKE '%lot%'
        UNION ALL SELECT id, CASE question_type WHEN 'Binary' THEN 2 WHEN 'Numerical' THEN 3 ELSE 4 END, question_type FROM question WHERE question_type IS NOT NULL)
      SELECT q.id AS question_id, CAST(f.ordinal AS INTEGER) AS ordinal, f.description FROM question q LEFT JOIN (SELECT id, min(ordinal) AS ordinal, arg_min(description, ordinal) AS description FROM s GROUP BY 1) f ON f.id = q.id""",
    "background_join": """SELECT id AS question_id, CASE WHEN trim(double_check_question) <> '' THEN double_check_question END AS background,
      CASE WHEN question_type IN ('Binary', 'Lot Size') AND coalesce(trim(double_check_question), '') = '' THEN 'no background' END AS error FROM question""",
    "question_request": _ASKED + f"""SELECT doc_id, muni || '_main_' || id AS custom_id, {_PROMPT.format(q="question_rephrase")} AS prompt_md5, {_WRONG.format(q="question_rephrase")} AS error FROM a""",
    "double_check_request": _ASKED + f"""SELECT doc_id, muni || '_main_' || id AS custom_id, {_PROMPT.format(q="double_check_question")} AS prompt_md5, {_WRONG.format(q="double_check_question")} AS error FROM a""",
    "subtask_request": _ASKED
    + """SELECT doc_id, muni || '_subtask_' || id AS custom_id, CASE WHEN question_detail IS NOT NULL THEN
      md5(concat_ws(chr(10) || chr(10), '#System Info:' || chr(10) || 'Be brief.', '#Question:' || chr(10) || question_detail, '#Context:' || chr(10) || text)) END AS prompt_md5 FROM a""",
    "municipality_selection": _MUNI + "SELECT muni, ntile(7) OVER (ORDER BY muni) AS node FROM (SELECT muni FROM mu WHERE muni IN (SELECT muni FROM chunk) ORDER BY md5('42' || muni), muni LIMIT 200)",
    "queue_reversed": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC",
    "request_tokens": r"SELECT batch_id, custom_id, CAST(list_sum(list_transform(messages, lambda m: coalesce(len(regexp_extract_all(m.content, '[^ \n]+')), 0))) AS BIGINT) AS tokens FROM (SELECT DISTINCT batch_id, custom_id, body.messages AS messages FROM api_request)",
    "usage_totals": "SELECT model, count(*) AS responses, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.completion_tokens) AS BIGINT) AS completion_tokens FROM (SELECT DISTINCT record_id, response.body.model AS model, response.body.usage AS usage FROM api_response WHERE response IS NOT NULL) GROUP BY 1",
    "error_capture": """SELECT record_id, min(r) AS error FROM (SELECT record_id, coalesce(error, CASE WHEN status_code >= 400 THEN 'status ' || status_code END, CASE WHEN response IS NULL THEN 'no response' END) AS r FROM api_response)
      WHERE r IS NOT NULL GROUP BY 1""",
    "batch_pack": """SELECT o_orderkey, tokens, CAST(sum(tokens) OVER w AS BIGINT) <= 250000000 AND count(*) OVER w <= 50000 AS sent FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS tokens FROM orders) WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "response_attach": f"""SELECT q.batch_id, q.custom_id, record_id, coalesce(answers, 0) AS answers FROM (SELECT batch_id, {_KEY.format(x="custom_id")} AS k, min(custom_id) AS custom_id FROM api_request GROUP BY 1, 2) q
      LEFT JOIN (SELECT batch_id, {_KEY.format(x="custom_id")} AS k, arg_min(record_id, (received_at, record_id)) AS record_id, count(DISTINCT record_id) AS answers FROM api_response WHERE response IS NOT NULL GROUP BY 1, 2) r
      ON r.batch_id = q.batch_id AND r.k = q.k""",
    "sync_completion": "SELECT 'm_main_' || id AS custom_id, CAST(200 AS INTEGER) AS status_code, CAST(1 AS INTEGER) AS choices, CAST(NULL AS VARCHAR) AS error FROM question",
    "muni_key": _MUNI + "SELECT muni, state, source FROM mu",
    "path_resolve": _MUNI + """SELECT muni, CASE WHEN source IN ('ordinet', 'legalpress', 'codelibrary') THEN 'texts/' || source || '/' || state || '/' || muni || '.json' END AS path,
      CASE WHEN coalesce(source NOT IN ('ordinet', 'legalpress', 'codelibrary'), true) THEN 'no folder for source ' || coalesce(source, 'null') END AS error FROM mu""",
    "pair_cross": _MUNI + "SELECT muni, id AS question_id FROM mu, (SELECT DISTINCT id FROM question)",
    "embedded_semi": _MUNI + "SELECT muni FROM mu WHERE muni IN (SELECT muni FROM chunk)",
    "pending_anti": _MUNI + "SELECT muni FROM mu WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.muni = mu.muni)",
    "embedding_catalogue": "SELECT DISTINCT muni FROM chunk WHERE muni IS NOT NULL",
    "tree_lookup": _MUNI + """, t AS (SELECT DISTINCT muni FROM (SELECT chunk_id, arg_max({'m': muni, 'o': ord, 'p': tree_path}, ingested_at) AS l FROM chunk WHERE chunk_id IS NOT NULL GROUP BY 1), LATERAL (SELECT l.m AS muni) WHERE len(l.p) > 0 AND len(l.o) = len(l.p) + 1)
      SELECT muni, CASE WHEN muni NOT IN (SELECT muni FROM t WHERE muni IS NOT NULL) THEN 'no tree' END AS error, muni IN (SELECT muni FROM t WHERE muni IS NOT NULL) AS found FROM mu""",
    "node_split": _MUNI + "SELECT muni, ntile(7) OVER (ORDER BY muni) AS node FROM mu",
    "sample_hash": _MUNI + "SELECT muni FROM mu ORDER BY md5('42' || muni), muni LIMIT 100",
    "testing_head": _MUNI + "SELECT (SELECT min(muni) FROM mu) AS muni, (SELECT min(id) FROM question) AS question_id",
    "retention_filter": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00'",
    "wire_parse": "SELECT line_id, CASE WHEN json_valid(line) AND trim(line) <> '' THEN json_extract_string(line, '$.custom_id') END AS custom_id FROM (SELECT DISTINCT line_id, line FROM batch_line WHERE line_id IS NOT NULL)",
}

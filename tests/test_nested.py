import json
import random
import time

from strataq.operators.nested import flatten_lines

SCHEMA = "line_id bigint, batch_id string, read_at timestamp, line string"
NAME = "answer_question_lot_size_residential"


def unwrap(x):
    while isinstance(x, str):
        try:
            y = json.loads(x)
        except ValueError:
            return x
        if not isinstance(y, (str, dict, list)):
            return x
        x = y
    return x


def lone(x):
    x = unwrap(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def obj(x):
    x = unwrap(x)
    return x if isinstance(x, dict) else {}


def brute(rows):
    out = set()
    for i, line in rows:
        try:
            top = json.loads(line)
        except (ValueError, TypeError):
            continue
        response = obj(obj(top).get("response"))
        body = obj(response.get("body", response))
        for c, choice in enumerate(lone(body.get("choices"))):
            message = obj(obj(choice).get("message"))
            calls = lone(message["tool_calls"]) if message.get("tool_calls") is not None else lone(message.get("function_call"))
            for k, call in enumerate(calls):
                f = obj(obj(call).get("function", obj(call)))
                if f.get("name") != NAME:
                    continue
                count = [0]

                def walk(x, parent, i=i, c=c, k=k, count=count):
                    x = unwrap(x)
                    if isinstance(x, dict):
                        if "district_name" in x:
                            out.add((i, c, k, count[0], parent))
                            parent = count[0]
                            count[0] += 1
                        for v in x.values():
                            walk(v, parent)
                    elif isinstance(x, list):
                        for v in x:
                            walk(v, parent)

                walk(f.get("arguments"), -1)
    return out


def make(r, depth=0):
    d = {}
    keys = ["district_name", "unit", "note", "variants", "overlays"]
    r.shuffle(keys)
    for k in keys:
        if k == "district_name" and r.random() < 0.8:
            d[k] = r.choice(["R-1", 'say "x" {', "back\\slash", "é½", "}{][", ""])
        elif k in ("unit", "note") and r.random() < 0.5:
            d[k] = r.choice([None, "Acres", {"see": "{"}, "[not json", 'a "b": {'])
        elif k in ("variants", "overlays") and depth < 5 and r.random() < 0.45:
            inner = [make(r, depth + 1) for _ in range(r.randrange(3))]
            d[k] = r.choice([inner, inner[0] if inner else None, json.dumps(inner), json.dumps(json.dumps(inner))])
    return d


def line(r, i):
    def call():
        args = {"Dont_Know": False, "Answer": [make(r) for _ in range(r.randrange(4))]}
        if r.random() < 0.2:
            args["Answer"] = json.dumps(args["Answer"])
        text = r.choice([json.dumps(args), json.dumps(args, indent=1), args, json.dumps(json.dumps(args)), '{"Answer": [{"district_name": 1', None])
        return {"id": "c", "function": {"name": NAME if r.random() < 0.8 else "other", "arguments": text}}

    def choice(k):
        calls = [r.choice([call(), None]) if r.random() < 0.1 else call() for _ in range(r.randrange(3))]
        m = {"role": "assistant", "content": None, "tool_calls": r.choice([calls, calls[0] if calls else None])}
        return {"index": k, "message": m}

    choices = [choice(k) for k in range(r.randrange(3))]
    body = {"id": "x", "choices": r.choice([choices, choices[0] if choices else []])}
    top = {"custom_id": f"q{i}", "response": r.choice([{"body": body, "status_code": 200}, body, {"body": json.dumps(body)}, json.dumps({"body": body}), None])}
    text = json.dumps(top, ensure_ascii=r.random() < 0.5)
    return r.choice([text] * 8 + [text[: len(text) // 2], text + " x", "", None, "[1]", "null"])


def test_against_brute_force(spark):
    r = random.Random(11)
    rows = [(i, line(r, i)) for i in range(600)]
    table = spark.createDataFrame([(i, "b", None, t) for i, t in rows], SCHEMA)
    got = [tuple(x)[:5] for x in flatten_lines(table)["districts"].collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 300


def test_keys_link_children_to_parents(spark):
    r = random.Random(5)
    table = spark.createDataFrame([(i, "b", None, line(r, i)) for i in range(80)] * 2, SCHEMA)
    t = {k: v.collect() for k, v in flatten_lines(table).items()}
    lines = {x["line_id"] for x in t["responses"]}
    choices = {(x["line_id"], x["choice_pos"]) for x in t["choices"]}
    calls = {(x["line_id"], x["choice_pos"], x["call_pos"]) for x in t["calls"]}
    found = {(*x[:3], x["district_pos"]) for x in t["districts"]}
    assert len(t["responses"]) == len(lines) == 80 and len(choices) == len(t["choices"])
    assert {c[0] for c in choices} <= lines and {c[:2] for c in calls} <= choices and {d[:3] for d in found} <= calls
    assert all(x["parent_pos"] == -1 or (*x[:3], x["parent_pos"]) in found for x in t["districts"])


def test_nulls_repeats_deep_and_empty(spark):
    deep = '{"district_name":"a","v":[' * 60 + "]}" * 60
    args = json.dumps({"Answer": json.loads(deep)})
    good = json.dumps({"response": {"body": {"choices": {"message": {"function_call": {"name": NAME, "arguments": args}}}}}})
    rows = [(1, "b", None, good), (1, "b", None, good), (None, "b", None, good), (2, None, None, None), (3, None, None, " \n ")]
    t = flatten_lines(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(x)[:5] for x in t["districts"].collect())
    assert got == [(1, 0, 0, k, k - 1) for k in range(60)]
    assert {x["line_id"]: x["valid"] for x in t["responses"].collect()} == {1: True, 2: False, 3: False}
    none = flatten_lines(spark.createDataFrame([], SCHEMA + ", choices string, calls int"))
    assert all(v.count() == 0 for v in none.values())


def test_district_fields(spark):
    args = json.dumps({"Answer": [{"district_name": 'R "1"', "min_lot_size": {"value": 2}, "unit": "Acres", "estate": True}]})
    row = json.dumps({"response": {"body": {"choices": [{"index": 4, "message": {"tool_calls": [{"function": {"name": NAME, "arguments": args}}]}}]}}})
    d = flatten_lines(spark.createDataFrame([(1, "b", None, row)], SCHEMA))["districts"].first()
    assert (d["district_name"], d["min_lot_size"], d["unit"], d["estate"]) == ('R "1"', '{"value":2}', "Acres", True)


def one_call(arguments):
    return json.dumps({"response": {"body": {"choices": [{"index": 0, "message": {"tool_calls": [{"function": {"name": NAME, "arguments": arguments}}]}}]}}})


def test_escaped_keys_and_keys_in_strings(spark):
    args = '{"Answer":[{"district\\u005fname":"A"},{"a":{"\\u0064istrict_name" : 1, "v":[{"district_name":"x \\u007b \\"district_name\\": {"}]},"note":"district_name"},{"b":"\\"district_name\\": 1"}]}'
    assert json.loads(args)["Answer"][0] == {"district_name": "A"}
    rows = [(1, "b", None, one_call(args))]
    got = sorted(tuple(x)[:6] for x in flatten_lines(spark.createDataFrame(rows, SCHEMA))["districts"].collect())
    assert {g[:5] for g in got} == brute([(1, rows[0][3])]) and [g[4] for g in got] == [-1, -1, 1]
    assert [g[5] for g in got] == ["A", "1", 'x { "district_name": {']


def test_many_districts_of_one_call(spark):
    def seconds(n):
        args = json.dumps({"Answer": [{"district_name": f"R-{i}", "min_lot_size": i, "variants": [{"district_name": "v"}] if i % 7 == 0 else []} for i in range(n)]})
        lines = spark.createDataFrame([(1, "b", None, one_call(args))], SCHEMA)
        best = 9e9
        for _ in range(2):
            began = time.time()
            rows = flatten_lines(lines)["districts"].collect()
            best = min(best, time.time() - began)
        assert len(rows) == n + -(-n // 7) and sum(r["parent_pos"] >= 0 for r in rows) == -(-n // 7)
        return best

    assert seconds(2000) < 3 * seconds(1000) + 1  # no square of the districts

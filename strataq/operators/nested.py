"""Nested result lines flattened into related tables (problem 4).

Higher-order functions do all of it: nested ``transform`` calls attach the keys and positions of the ancestors, ``flatten``
joins the arrays, and one ``inline`` per table emits its rows. Objects that nest to any depth are found by a fold over the
text's objects, as a fixed schema can't describe them and a map of values would lose their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.session import latest, let

# Stand-ins, from the private use area, for an escaped backslash and an escaped quote.
SLASH, QUOTE = "", ""
#: How often a string within a string is unwrapped at most. It leaves none: as each level doubles the backslashes before the
#: quotes within, a text with more levels would be longer than a string can be.
ENCODINGS = 32
STRINGS = "array<string>"
_BODY = "id:string,model:string,created:string,choices:string,usage:string"
TOP = f"struct<custom_id:string,error:string,status_code:string,response:struct<status_code:string,body:struct<{_BODY}>,{_BODY}>>"
CHOICE = "struct<index:string,finish_reason:string,message:struct<role:string,content:string,tool_calls:string,function_call:string>>"
CALL = "struct<id:string,function:struct<name:string,arguments:string>>"


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value: then, and only then, it is the first of two elements here."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2, F.lit(False))


def unwrap(text: Column) -> Column:
    """A string that holds JSON counts as that JSON."""

    def once(t: Column, _: Column) -> Column:
        return F.when(F.ltrim(t).startswith('"'), F.from_json(F.concat(F.lit("["), t, F.lit("]")), STRINGS)[0]).otherwise(t)

    return let(text, lambda t: F.when(F.ltrim(t).startswith('"'), F.aggregate(F.sequence(F.lit(1), F.lit(ENCODINGS)), t, once)).otherwise(t))


def members(text: Column) -> Column:
    """The elements of a JSON array as texts; what stands alone is an array of one, anything else is empty."""

    def read(t: Column) -> Column:
        start = F.substring(F.ltrim(t), 1, 1)
        return F.when(start == "[", F.coalesce(F.from_json(t, STRINGS), F.array().cast(STRINGS))).when(start == "{", F.array(t)).otherwise(F.array().cast(STRINGS))

    return let(unwrap(text), read)


def fields(text: Column) -> Column:
    """A JSON object's values as texts, by key; empty for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(unwrap(text), "map<string,string>", {"mode": "PERMISSIVE"}), empty)


def at(obj: Column, key: str) -> Column:
    return F.try_element_at(obj, F.lit(key))


def _guarded(text: Column) -> Column:
    """Escapes become single stand-ins, so that every quote left opens or closes a string."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))


def _restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit('\\"'))


def expand_strings(text: Column) -> Column:
    """Strings that hold a JSON object or array, at any depth, are replaced by what they hold."""

    def piece(s: Column, i: Column) -> Column:
        quoted = F.concat(F.lit('"'), s, F.lit('"'))
        inner = F.from_json(F.concat(F.lit('["'), _restored(s), F.lit('"]')), STRINGS)[0]
        holds = (i % 2 == 1) & F.substring(F.ltrim(s), 1, 1).isin("{", "[", QUOTE)
        chosen = let(inner, lambda v: F.when(is_json(v), v).otherwise(_restored(quoted)))
        return F.when(holds, chosen).when(i % 2 == 1, _restored(quoted)).otherwise(s)

    def once(s: Column, _: Column) -> Column:
        new = F.array_join(F.transform(F.split(_guarded(s["text"]), '"'), piece), "")
        more = let(new, lambda n: F.struct(n.alias("text"), (n == s["text"]).alias("done")))
        return F.when(s["done"], s).otherwise(more)

    def loop(t: Column) -> Column:
        start = F.struct(t.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ENCODINGS)), start, once, lambda s: s["text"])

    return let(text, lambda t: F.when(t.contains('\\"'), loop(t)).otherwise(t))


#: Set before every object and behind it, so that a text splits into atoms; from the private use area.
EDGE = "\ue002"


def _plain_key(key: str, text: Column) -> Column:
    """A key that is spelled with escapes is spelled plainly, wherever it stands before a colon."""

    def piece(parts: Column, p: Column, i: Column) -> Column:
        plain = F.from_json(F.concat(F.lit('["'), _restored(p), F.lit('"]')), STRINGS)[0]
        before_colon = F.ltrim(F.coalesce(F.get(parts, i + 1), F.lit(""))).startswith(":")
        return F.when((i % 2 == 1) & p.contains("\\u") & before_colon & (plain == key), key).otherwise(p)

    def read(t: Column) -> Column:
        return F.array_join(let(F.split(t, '"'), lambda parts: F.transform(parts, lambda p, i: piece(parts, p, i))), '"')

    return let(text, lambda t: F.when(t.contains("\\u"), read(t)).otherwise(t))


def atoms_of(key: str, text: Column) -> Column:
    """A JSON text cut before every ``{`` and behind every ``}`` outside its strings; empty for what lacks the key or is no JSON.

    Escapes are stand-ins (see ``_guarded``) and strings that hold JSON are expanded, so what is joined again is valid JSON.
    """

    def read(t: Column) -> Column:
        mark = lambda p: F.replace(F.replace(p, F.lit("{"), F.lit(EDGE + "{")), F.lit("}"), F.lit("}" + EDGE))
        marked = F.transform(F.split(t, '"'), lambda p, i: F.when(i % 2 == 1, p).otherwise(mark(p)))
        return F.split(F.array_join(marked, '"'), EDGE)

    empty = F.array().cast(STRINGS)
    plain = let(_guarded(expand_strings(text)), lambda t: _plain_key(key, t))
    return let(plain, lambda t: F.when(F.contains(t, F.lit(f'"{key}"')) & is_json(_restored(t)), read(t)).otherwise(empty))


def objects_in(key: str, atoms: Column) -> Column:
    """array<struct<pos, parent_pos, from, to>> of the objects with a key, in the order in which they begin; from and to number atoms.

    parent_pos is the position of the nearest enclosing object that has the key, -1 if there is none. One fold over the atoms with
    the open objects as its stack, one over what it found: both look at a stack of the depth, never at all objects.
    """
    slot = "struct<from:int,has:boolean>"
    state = f"struct<i:int,open:array<{slot}>,found:string>"
    is_key = f'"{key}"\\s*:'

    def step(s: Column, x: Column) -> Column:
        i, opens, closes = s["i"], x.startswith("{"), x.endswith("}")
        pushed = F.when(opens, F.array_append(s["open"], F.struct(i.alias("from"), F.lit(False).alias("has")).cast(slot))).otherwise(s["open"])

        def within(stack: Column) -> Column:
            depth = F.size(stack)
            top = F.get(stack, depth - 1)
            below = F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))
            has = top["has"] | x.rlike(is_key)
            kept = F.when(closes | (depth == 0), below).when(has & ~top["has"], F.array_append(below, F.struct(top["from"].alias("from"), has.alias("has")).cast(slot))).otherwise(stack)
            # What is found is kept as text, "from:to;", as an array would be copied element by element at every step.
            found = F.when(closes & (depth > 0) & has, F.concat(s["found"], top["from"].cast("string"), F.lit(":"), i.cast("string"), F.lit(";"))).otherwise(s["found"])
            return F.struct((i + 1).alias("i"), kept.alias("open"), found.alias("found"))

        return let(pushed, within)

    start = F.struct(F.lit(0).alias("i"), F.array().cast(f"array<{slot}>").alias("open"), F.lit("").alias("found")).cast(state)

    def listed(text: Column) -> Column:
        return F.filter(F.split(text, ";"), lambda x: x != "")

    as_span = lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("from"), F.substring_index(x, ":", -1).cast("int").alias("to"))
    spans = F.array_sort(F.transform(listed(F.aggregate(atoms, start, step, lambda s: s["found"])), as_span))

    around = "struct<pos:bigint,to:int>"
    parents = f"struct<n:bigint,around:array<{around}>,parent:string>"

    def nest(s: Column, o: Column) -> Column:
        def within(left: Column) -> Column:
            parent = F.coalesce(F.get(left, F.size(left) - 1)["pos"], F.lit(-1).cast("bigint"))
            mine = F.struct(s["n"].alias("pos"), o["to"].alias("to")).cast(around)
            return F.struct((s["n"] + 1).alias("n"), F.array_append(left, mine).alias("around"), F.concat(s["parent"], parent.cast("string"), F.lit(";")).alias("parent"))

        return let(F.filter(s["around"], lambda a: a["to"] > o["from"]), within)

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast(f"array<{around}>").alias("around"), F.lit("").alias("parent")).cast(parents)

    def numbered(spans: Column) -> Column:
        above = F.transform(listed(F.aggregate(spans, none, nest, lambda s: s["parent"])), lambda p: p.cast("bigint"))
        return let(above, lambda ps: F.transform(spans, lambda o, pos: F.struct(pos.cast("bigint").alias("pos"), F.get(ps, pos).alias("parent_pos"), o["from"].alias("from"), o["to"].alias("to"))))

    empty = F.array().cast("array<struct<pos:bigint,parent_pos:bigint,from:int,to:int>>")
    return F.when(F.size(atoms) > 0, let(spans, numbered)).otherwise(empty)


def object_text(atoms: Column, first: Column, last: Column) -> Column:
    return _restored(F.array_join(F.slice(atoms, first + 1, last - first + 1), ""))


def result_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line", read_at: str = "read_at") -> DataFrame:
    """One row per line id (the latest read) with the nested arrays ``choices`` and ``calls`` of its line.

    Null, blank and broken lines keep their row with ``valid`` false and empty arrays; lines with a null id are dropped.
    Other columns, whatever their names, are not looked at.
    """
    one = latest(lines.select(F.col(line_id).alias("line_id"), F.col(line).alias("line"), F.col(read_at).alias("read_at")), ["line_id"], ["read_at"])
    valid = is_json(F.col("line")) & (F.trim("line") != "")
    one = one.select("line_id", "read_at", F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, F.col("line")).alias("_line"))
    # The usual layout takes one pass over the line; any other goes level by level.
    one = one.withColumn("_t", F.from_json("_line", TOP))
    usual = F.coalesce(F.col("_t.response.body.choices"), F.col("_t.response.choices"))
    response = fields(at(fields(F.col("_line")), "response"))
    body = let(response, lambda r: fields(F.coalesce(at(r, "body"), F.to_json(r))))
    one = one.withColumn("_b", F.when(usual.isNull() & F.col("_line").contains("choices"), body))

    def choice(c: Column, i: Column) -> Column:
        def made(index: Column, finish: Column, m, get) -> Column:
            return F.struct(
                F.col("line_id").alias("line_id"), i.cast("long").alias("choice_pos"), index.try_cast("long").alias("index"), get(m, "role").alias("role"), get(m, "content").alias("content"),
                finish.alias("finish_reason"), F.coalesce(F.nullif(get(m, "tool_calls"), F.lit("null")), get(m, "function_call")).alias("calls"),
            )

        def level(t: Column) -> Column:
            other = let(fields(c), lambda f: let(fields(at(f, "message")), lambda m: made(at(f, "index"), at(f, "finish_reason"), m, at)))
            return F.when(t["message"].isNotNull(), made(t["index"], t["finish_reason"], t["message"], lambda m, k: m[k])).otherwise(other)

        return let(F.from_json(c, CHOICE), level)

    one = one.withColumn("choices", F.transform(members(F.coalesce(usual, at(F.col("_b"), "choices"))), choice))

    def call(c: Column, x: Column, j: Column) -> Column:
        def made(call_id: Column, name: Column, arguments: Column) -> Column:
            return F.struct(F.col("line_id").alias("line_id"), c["choice_pos"].alias("choice_pos"), j.cast("long").alias("call_pos"), call_id.alias("call_id"), name.alias("name"), unwrap(arguments).alias("arguments"))

        def level(t: Column) -> Column:
            inner = lambda f: F.when(at(f, "function").isNotNull(), fields(at(f, "function"))).otherwise(f)
            other = let(fields(x), lambda f: let(inner(f), lambda g: made(at(f, "id"), at(g, "name"), at(g, "arguments"))))
            return F.when(t["function"].isNotNull(), made(t["id"], t["function"]["name"], t["function"]["arguments"])).otherwise(other)

        return let(F.from_json(x, CALL), level)

    return one.withColumn("calls", F.flatten(F.transform(F.col("choices"), lambda c: F.transform(members(c["calls"]), lambda x, j: call(c, x, j)))))


def flatten_lines(lines: DataFrame, function: str = "answer_question_lot_size_residential", key: str = "district_name") -> dict[str, DataFrame]:
    """responses, choices, calls and districts, each keyed by line_id and the positions of its ancestors.

    A district's fields are read from its part of the arguments after its row is emitted, so who selects keys alone pays for keys alone.
    """
    nested = result_lines(lines)
    body = lambda k: F.coalesce(F.col(f"_t.response.body.{k}"), F.col(f"_t.response.{k}"), at(F.col("_b"), k))
    usage = fields(body("usage"))
    responses = nested.select(
        "line_id", "valid", F.col("_t.custom_id").alias("custom_id"), F.col("_t.error").alias("error"), F.coalesce("_t.status_code", "_t.response.status_code").try_cast("int").alias("status_code"),
        body("id").alias("response_id"), body("model").alias("model"), body("created").try_cast("long").alias("created"),
        at(usage, "prompt_tokens").try_cast("long").alias("prompt_tokens"), at(usage, "completion_tokens").try_cast("long").alias("completion_tokens"), F.size("choices").cast("long").alias("choices"),
    )
    choices = nested.select(F.inline("choices")).drop("calls")
    calls = nested.select(F.inline("calls"))
    found = calls.where((F.col("name") == function) & F.col("arguments").isNotNull())
    found = found.select("line_id", "choice_pos", "call_pos", atoms_of(key, F.col("arguments")).alias("_atoms"))
    rows = found.select("line_id", "choice_pos", "call_pos", "_atoms", F.inline(objects_in(key, F.col("_atoms"))))
    values = let(fields(object_text(F.col("_atoms"), F.col("from"), F.col("to"))), lambda f: F.struct(at(f, key).alias(key), at(f, "min_lot_size").alias("min_lot_size"), at(f, "unit").alias("unit"), at(f, "estate").try_cast("boolean").alias("estate")))
    rows = rows.select("line_id", "choice_pos", "call_pos", F.col("pos").alias("district_pos"), "parent_pos", values.alias("_v"))
    districts = rows.select("line_id", "choice_pos", "call_pos", "district_pos", "parent_pos", "_v.*")
    return {"responses": responses, "choices": choices, "calls": calls, "districts": districts}

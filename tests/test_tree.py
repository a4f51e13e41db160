import json
import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import tree as T

LEAF = "array<struct<name:string,text:string,has_table:boolean>>"


def in_place(items, least):
    """The list is changed while it is walked, by index; a None text is a branch. Written from the description of the merge."""
    items = [dict(n=n, t=t, h=h, gone=False) for n, t, h in items]
    i = 0
    while i < len(items):
        x = items[i]
        if x["t"] is None or len(x["t"]) >= least:
            i += 1
            continue
        if not x["t"].strip():
            x["gone"] = True
            i += 1
            continue
        prev = items[i - 1] if i and items[i - 1]["t"] is not None else None
        nxt = items[i + 1] if i + 1 < len(items) and items[i + 1]["t"] is not None else None
        if prev is None and nxt is None:
            i += 1
            continue
        if nxt is None or (prev is not None and len(prev["t"]) <= len(nxt["t"])):
            prev.update(n=f"{prev['n']} & {x['n']}", t=f"{prev['t']}\n\n{x['n']}\n{x['t']}", h=prev["h"] or x["h"])
        else:
            nxt.update(n=f"{x['n']} & {nxt['n']}", t=f"{x['t']}\n\n{nxt['n']}\n{nxt['t']}", h=x["h"] or nxt["h"])
        del items[i]
        i += 1  # what moved up into this place is not looked at
    return [(x["n"], x["t"], x["h"]) for x in items if not x["gone"]]


def lists(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        yield [(f"n{i}", r.choice([None, "", "  ", "a", "bb", "ccc", "d" * 9, "e" * 12]), r.random() < 0.3) for i in range(r.randrange(9))]


def test_merge_fold_against_changing_the_list(spark):
    cases = list(lists(400, 3))
    rows = spark.createDataFrame(list(enumerate(cases)), f"i bigint, l {LEAF}")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in rows.select("i", T.merge_leaves(F.col("l"), 5, reference=True).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [in_place(c, 5) for c in cases]


def test_clean_merge_loses_no_text(spark):
    cases = list(lists(300, 4))
    rows = spark.createDataFrame(list(enumerate(cases)), f"i bigint, l {LEAF}")
    for r in rows.select("i", T.merge_leaves(F.col("l"), 5).alias("m")).collect():
        want = "".join(t.strip() for _, t, _ in cases[r["i"]] if t)
        text = "".join(x["text"] or "" for x in r["m"])
        assert sum(text.count(c) for c in "abcde") >= len(want)
        assert sum(x["text"] is None for x in r["m"]) == sum(t is None for _, t, _ in cases[r["i"]])


def test_sections_keep_order_and_drop_scalars(spark):
    trees = [
        (1, json.dumps({"z": {"Leaf_Text": "t", "x": {"Leaf_Text": "no"}}, "a": {"b": {"Leaf_Text": "u", "Has_Table": True}, "c": 5}, "e": {}})),
        (2, json.dumps({"Leaf_Text": "root"})), (3, "no json"), (4, None), (5, "[1]"), (6, json.dumps({str(i): {"Leaf_Text": str(i)} for i in range(12)})),
    ]
    s = T.tree_sections(spark.createDataFrame(trees, "tree_id bigint, tree_json string").withColumn("tree_id", F.col("tree_id").cast("string")))
    one = [(r["ord"], r["tree_path"], r["name"], r["is_leaf"], r["leaf_text"], r["has_table"]) for r in s.where("tree_id = 1").orderBy("ord").collect()]
    assert one == [([0], [], "Root", False, None, False), ([0, 0], ["Root"], "z", True, "t", False), ([0, 1], ["Root"], "a", False, None, False), ([0, 1, 0], ["Root", "a"], "b", True, "u", True), ([0, 2], ["Root"], "e", False, None, False)]
    assert [r["name"] for r in T.flatten_leaves(s).where("tree_id = 6").orderBy("ord").collect()] == [str(i) for i in range(12)]
    assert {r["tree_id"] for r in s.collect()} == {"1", "2", "6"}


@pytest.mark.parametrize(("n", "want"), [(0, [(0, 0)]), (10, [(0, 10)]), (11, [(1, 10), (2, 3)]), (26, [(1, 10), (2, 10), (3, 10)])])
def test_stride_windows(spark, n, want):
    row = spark.createDataFrame([(" ".join(map(str, range(n))),)], "t string").select(T.stride_split(F.col("t"), 10, 2).alias("p")).first()
    assert [(p["part"], p["tokens"]) for p in row["p"]] == want


def test_recursive_split_is_bounded_and_whole():
    r = random.Random(2)
    count = lambda p: len([w for x in p.split("\n") for w in x.split(" ") if w])
    for _ in range(60):
        text = "".join(r.choice(["word ", "a ", "\n", "\n\n", "longer-token "]) for _ in range(r.randrange(300)))
        spans = T.recursive_spans(text, 20, 4)
        parts = T.recursive_split(text, 20, 4)
        assert all(0 < count(p) <= 20 for p in parts)
        assert "".join(text[a + shared : b] for a, b, shared in spans) == (text if count(text) else "")
        assert all(0 <= count(text[a : a + shared]) <= 4 for a, _, shared in spans)
    assert T.recursive_split("w0 w1 w2 w3 w4", 2, 0) == ["w0 w1 ", "w2 w3 ", "w4"]
    assert T.recursive_split("a b\n\nc d\n\ne f", 4, 0) == ["a b\n\nc d\n\n", "e f"] and T.recursive_split("x" * 5000, 2, 0) == ["x" * 5000]


def nested(r, depth=0):
    """A tree with branches between leaves, blank and short ones, and sections of one name."""
    out = []
    for i in range(r.randrange(1, 6)):
        if depth < 3 and r.random() < 0.35:
            out.append((f"b{i}", nested(r, depth + 1)))
        else:
            out.append((r.choice(["n", f"n{i}"]), r.choice(["", "  ", "a", "bb", "ccc", "d" * 9, "e" * 12])))
    return out


def as_json(node):
    return "{" + ",".join(f"{json.dumps(k)}:" + (as_json(v) if isinstance(v, list) else json.dumps({"Leaf_Text": v})) for k, v in node) + "}"


def merged(node, at, least, reference, raw=False):
    """Sibling lists after the merge, by the place of their parent before it."""
    items = [(k, None if isinstance(v, list) else v, False) for k, v in node]
    seen = set(range(len(items)))
    if raw:
        out = items
    elif reference:
        out, seen = in_place(items, least), looked_at(items, least)
    else:
        out = in_order([x for x in items if x[1] is None or x[1].strip()], least)
    yield at, [(n, t) for n, t, _ in out]
    for i, (_, v) in enumerate(node):
        if isinstance(v, list):
            yield from merged(v, (*at, i), least, reference, raw or i not in seen)


def looked_at(items, least):
    """The places that the walk over a changing list visits."""
    rest = [dict(t=t, n=n, i=i) for i, (n, t, _) in enumerate(items)]
    seen, i = set(), 0
    while i < len(rest):
        x = rest[i]
        seen.add(x["i"])
        prev = rest[i - 1] if i and rest[i - 1]["t"] is not None else None
        nxt = rest[i + 1] if i + 1 < len(rest) and rest[i + 1]["t"] is not None else None
        if x["t"] is not None and len(x["t"]) < least and x["t"].strip() and (prev or nxt):
            if nxt is None or (prev is not None and len(prev["t"]) <= len(nxt["t"])):
                prev["t"] += f"\n\n{x['n']}\n{x['t']}"
            else:
                nxt["t"] = f"{x['t']}\n\n{nxt['n']}\n{nxt['t']}"
            del rest[i]
        i += 1
    return seen


def in_order(items, least):
    """Every sibling is looked at once; what is merged into the next is looked at with it no more."""
    out, i = [], 0
    while i < len(items):
        n, t, h = items[i]
        prev = out[-1] if out and out[-1][1] is not None else None
        nxt = items[i + 1] if i + 1 < len(items) and items[i + 1][1] is not None else None
        if t is None or len(t) >= least or (prev is None and nxt is None):
            out.append((n, t, h))
        elif prev is not None and (nxt is None or len(prev[1]) <= len(nxt[1])):
            out[-1] = (f"{prev[0]} & {n}", f"{prev[1]}\n\n{n}\n{t}", prev[2] or h)
        else:
            out.append((f"{n} & {nxt[0]}", f"{t}\n\n{nxt[0]}\n{nxt[1]}", h or nxt[2]))
            i += 1
        i += 1
    return out


@pytest.mark.parametrize("reference", [False, True])
def test_merge_over_branches_against_brute_force(spark, reference):
    r = random.Random(12)
    trees = {f"t{i}": nested(r) for i in range(80)}
    table = spark.createDataFrame([(k, as_json(v)) for k, v in trees.items()], "tree_id string, tree_json string")
    got = {}
    for x in T.merge_tree(T.tree_sections(table), 5, reference).collect():
        got.setdefault((x["tree_id"], tuple(x["parent"])), {})[x["pos"]] = (x["name"], x["leaf_text"])
    for k, tree in trees.items():
        for at, want in merged(tree, (0,), 5, reference):
            assert [got.get((k, at), {}).get(i) for i in range(len(want))] == want, (k, at)
            assert len(got.get((k, at), {})) == len(want)


def test_trees_are_put_together_in_order(spark):
    rows = [
        ("m", [0, 0, 3], ["Root", 'A "1"'], "x", "one", None), ("m", [0, 0, 1], ["Root", 'A "1"'], "x", "two", True), ("m", [0, 2], ["Root"], "z}", None, False), ("m", [0, 1, 0, 0], ["Root", "B", "C"], "y", "t" * 3, False),
        ("n", [0, 0], ["Root"], None, "", None), ("n", [0, 5], ["Root", "bad"], "w", "left out", None), ("n", None, ["Root"], "w", "x", None), (None, [0, 0], ["Root"], "w", "x", None), ("o", [0, 0], None, "w", "x", None),
    ]
    leaves = spark.createDataFrame(rows, "tree_id string, ord array<int>, tree_path array<string>, name string, leaf_text string, has_table boolean")
    got = {r["tree_id"]: r["tree_json"] for r in T.assemble_trees(leaves).collect()}
    assert list(got) == ["m", "n"] or set(got) == {"m", "n"}
    assert json.loads(got["m"], object_pairs_hook=lambda x: x) == [
        ('A "1"', [("x", [("Leaf_Text", "two"), ("Has_Table", True)]), ("x", [("Leaf_Text", "one"), ("Has_Table", False)])]),
        ("B", [("C", [("y", [("Leaf_Text", "ttt"), ("Has_Table", False)])])]), ("z}", [("Leaf_Text", None), ("Has_Table", False)]),
    ]
    s = T.tree_sections(T.assemble_trees(leaves))
    assert [(r["ord"], r["name"], r["leaf_text"]) for r in s.where("tree_id = 'm' AND is_leaf").orderBy("ord").collect()] == [([0, 0, 0], "x", "two"), ([0, 0, 1], "x", "one"), ([0, 1, 0, 0], "y", "ttt"), ([0, 2], "z}", None)]
    assert T.assemble_trees(leaves.limit(0)).count() == 0


def test_prepared_text(spark):
    rows = spark.createDataFrame([(1, ["Root", "A", "B"], "n", "  x y \n"), (2, ["Root"], "m", "z")], "chunk_id bigint, tree_path array<string>, name string, leaf_text string")
    out = {r["chunk_id"]: r for r in T.prepare_text(rows).collect()}
    assert out[1]["leaf_text"] == "Section Path: A->B->n\nSection Text: x y" and out[1]["embed_text"] == "Root->A->B\n" + out[1]["leaf_text"] and out[1]["tokens"] == 7
    assert out[2]["leaf_text"].startswith("Section Path: ->m\n")

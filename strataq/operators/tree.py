"""Hierarchical texts as ordered path tables: normalising, merging, splitting and preparing leaves."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.text import strip, token_len, tokens

SECTIONS = "tree_id string, ord array<int>, tree_path array<string>, name string, is_leaf boolean, leaf_text string, has_table boolean"


class Node(list):
    """A JSON object as its (key, value) pairs: sections of one name stand beside each other, and none is lost."""


def walk(tree: object) -> Iterator[tuple]:
    """(ord, path, name, is_leaf, text, has_table) of a nested tree in order, without recursion; keys keep their order."""
    stack: list[tuple] = [((0,), (), "Root", tree)]
    while stack:
        at, path, name, node = stack.pop()
        if not isinstance(node, Node):
            continue
        fields = dict(node)
        if "Leaf_Text" in fields:
            text = fields["Leaf_Text"]
            yield at, path, name, True, None if text is None else str(text), bool(fields.get("Has_Table", False))
            continue
        yield at, path, name, False, None, False
        inner = [(k, v) for k, v in node if isinstance(v, Node)]
        stack.extend(reversed([((*at, i), (*path, name), k, v) for i, (k, v) in enumerate(inner)]))


def tree_sections(trees: DataFrame) -> DataFrame:
    """(tree_id, tree_json) to one row per node. Text that is no JSON object gives no rows; scalar values are dropped.

    Paths hold the ancestors' names without the node's own; sections of one name stay apart; ``ord`` holds sibling ordinals from the root and sorts in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["tree_id"], pdf["tree_json"], strict=True):
                try:
                    tree = json.loads(text, object_pairs_hook=Node) if text else None
                except (ValueError, RecursionError):
                    tree = None
                rows += [(i, list(a), list(p), n, leaf, t, h) for a, p, n, leaf, t, h in walk(tree)]
            yield pd.DataFrame(rows, columns=["tree_id", "ord", "tree_path", "name", "is_leaf", "leaf_text", "has_table"])

    return trees.select("tree_id", "tree_json").mapInPandas(run, SECTIONS)


def quoted(name: Column) -> Column:
    """A name as a JSON string."""
    whole = F.to_json(F.array(F.coalesce(name, F.lit(""))))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def assemble_trees(leaves: DataFrame) -> DataFrame:
    """(tree_id, tree_json) from leaves (tree_id, ord, tree_path, name, leaf_text, has_table), one tree per tree_id, siblings by ``ord``.

    ``tree_path`` names the ancestors and ``ord`` numbers the node and each of them among its siblings, the root first. Level by
    level, from the greatest length of ord up, siblings are joined into their parent, so a task holds the children of one section; a
    tree is one text, as one file is. Leaves without an ord, a path or a fitting number of either are left out.
    """
    leaf = F.to_json(F.struct(F.col("leaf_text").alias("Leaf_Text"), F.coalesce("has_table", F.lit(False)).alias("Has_Table")), {"ignoreNullFields": "false"})
    rows = leaves.where((F.size("ord") == F.size("tree_path") + 1) & (F.size("tree_path") > 0) & F.col("tree_id").isNotNull())
    rows = rows.select("tree_id", "ord", "tree_path", F.concat(quoted(F.col("name")), F.lit(":"), leaf).alias("member"))
    deepest = rows.agg(F.max(F.size("ord"))).first()[0] or 1  # of a narrow column
    for depth in range(deepest, 1, -1):
        # Of a level above there is nothing to do yet; what is at this level moves into its parent.
        here, above = rows.where(F.size("ord") == depth), rows.where(F.size("ord") < depth)
        parent = F.slice("ord", 1, depth - 1)
        path = F.slice("tree_path", F.lit(1), F.lit(depth - 2))
        name = F.get("tree_path", F.lit(depth - 2))
        joined = here.groupBy("tree_id", parent.alias("ord"), path.alias("tree_path"), name.alias("_name")).agg(F.array_sort(F.collect_list(F.struct(F.get("ord", F.lit(depth - 1)).alias("at"), "member"))).alias("_m"))
        inner = F.concat(F.lit("{"), F.array_join(F.transform("_m", lambda m: m["member"]), ","), F.lit("}"))
        member = inner if depth == 2 else F.concat(quoted(F.col("_name")), F.lit(":"), inner)
        rows = above.unionByName(joined.select("tree_id", "ord", "tree_path", member.alias("member")))
    return rows.groupBy("tree_id").agg(F.max("member").alias("tree_json"))


def flatten_leaves(sections: DataFrame) -> DataFrame:
    return sections.where("is_leaf").select("tree_id", "ord", "name", "leaf_text")


LEAF = "struct<name:string,text:string,has_table:boolean>"


def merge_leaves(leaves: Column, least: int = 200, reference: bool = False) -> Column:
    """Fold of one sibling list, array<struct<name, text, has_table>>; a null text stands for a branch.

    A leaf shorter than ``least`` characters joins the leaf beside it that is shorter, the one before on a tie. Blank leaves are
    dropped first, unless ``reference``: then they are still merged into, and after a merge the sibling that moves up is not
    looked at, as when a list is changed while it is walked.
    """
    state = f"struct<out:array<struct<name:string,text:string,has_table:boolean,gone:boolean>>,skip:boolean>"
    item = "struct<name:string,text:string,has_table:boolean,gone:boolean>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(False).alias("skip")).cast(state)
    if not reference:
        leaves = F.filter(leaves, lambda x: x["text"].isNull() | (strip(x["text"]) != ""))

    def made(x: Column, gone: Column) -> Column:
        return F.struct(x["name"].alias("name"), x["text"].alias("text"), x["has_table"].alias("has_table"), gone.alias("gone")).cast(item)

    def joined(a: Column, b: Column, gone: Column) -> Column:
        text = F.concat(a["text"], F.lit("\n\n"), b["name"], F.lit("\n"), b["text"])
        table = F.coalesce(a["has_table"], F.lit(False)) | F.coalesce(b["has_table"], F.lit(False))
        return F.struct(F.concat(a["name"], F.lit(" & "), b["name"]).alias("name"), text.alias("text"), table.alias("has_table"), gone.alias("gone")).cast(item)

    no = F.lit(False)

    def fold(xs: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            x, out = F.get(xs, j), s["out"]
            last, after = F.try_element_at(out, F.lit(-1)), F.get(xs, j + 1)
            has_last = (F.size(out) > 0) & last["text"].isNotNull()
            has_next = (j + 1 < F.size(xs)) & after["text"].isNotNull()
            there = j + 1 < F.size(xs)
            pack = lambda o, k: F.struct(o.alias("out"), k.alias("skip")).cast(state)
            back = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
            into_last = F.concat(back, F.array(joined(last, x, last["gone"])))
            moved_up = F.when(there, F.concat(into_last, F.array(made(after, no)))).otherwise(into_last)
            blank = strip(x["text"]) == ""
            keep = x["text"].isNull() | (F.length(x["text"]) >= least)
            to_last = ~has_next | (has_last & (F.length(last["text"]) <= F.length(after["text"])))
            # Without the reference's mode the sibling that moves up is folded in its turn.
            on_last = pack(moved_up, there) if reference else pack(into_last, no)
            on_next = pack(F.concat(out, F.array(joined(x, after, no))), F.lit(True))
            return (
                F.when(s["skip"], pack(out, no))
                .when(keep, pack(F.concat(out, F.array(made(x, no))), no))
                .when(blank, pack(F.concat(out, F.array(made(x, F.lit(True)))), no))
                .when(~has_last & ~has_next, pack(F.concat(out, F.array(made(x, no))), no))
                .when(to_last & has_last, on_last)
                .otherwise(on_next)
            )

        done = F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1), start, step, lambda s: F.filter(s["out"], lambda o: ~o["gone"]))
        return F.when(F.size(xs) > 0, done).otherwise(F.array().cast(f"array<{item}>"))

    return F.transform(F.transform(F.array(leaves), fold)[0], lambda o: F.struct(o["name"].alias("name"), o["text"].alias("text"), o["has_table"].alias("has_table")))


def merge_tree(sections: DataFrame, least: int = 200, reference: bool = False) -> DataFrame:
    """Small leaves of whole trees merged, siblings by siblings: (tree_id, parent, pos, name, leaf_text, has_table, is_leaf).

    ``sections`` is what ``tree_sections`` gives; ``parent`` is the ord of the parent and pos the new place among its children. A
    merge never makes a leaf a branch or the other way round, so every list of siblings is folded on its own and a task holds the
    children of one section. With ``reference`` a branch that moves up in a changed list is not looked at, and so nothing below
    it is merged or dropped; below, ``merge_leaves`` says what else that mode does.
    """
    parent = F.slice("ord", F.lit(1), F.size("ord") - 1)
    item = F.struct(F.element_at("ord", -1).alias("at"), "name", F.when(F.col("is_leaf"), F.coalesce("leaf_text", F.lit(""))).alias("text"), "has_table", "ord")
    lists = sections.where(F.size("ord") > 1).groupBy("tree_id", parent.alias("parent")).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    plain = F.transform("_l", lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"), x["has_table"].alias("has_table")))
    merged = merge_leaves(plain, least, reference)
    if reference:
        # The branches that are skipped: those that follow a small leaf which was merged into the leaf before it.
        skipped = F.filter("_l", lambda x, i: x["text"].isNull() & F.array_contains(unvisited(plain, least), i))
        unseen = lists.select("tree_id", F.explode(skipped).alias("_s")).select(F.col("tree_id").alias("_t"), F.col("_s.ord").alias("_root"))
        above = F.transform(F.sequence(F.lit(1), F.size("parent")), lambda n: F.slice("parent", F.lit(1), n))
        roots = lists.select("tree_id", "parent", F.explode(above).alias("_root")).join(unseen.withColumnRenamed("_t", "tree_id"), ["tree_id", "_root"], "left_semi").select("tree_id", "parent").distinct()
        lists = lists.join(roots.withColumn("_raw", F.lit(True)), ["tree_id", "parent"], "left")
        merged = F.when(F.coalesce("_raw", F.lit(False)), plain).otherwise(merged)
    rows = lists.select("tree_id", "parent", F.posexplode(merged).alias("pos", "_m"))
    return rows.select("tree_id", "parent", F.col("pos").cast("long").alias("pos"), "_m.name", F.col("_m.text").alias("leaf_text"), "_m.has_table", F.col("_m.text").isNotNull().alias("is_leaf"))


def unvisited(leaves: Column, least: int = 200) -> Column:
    """The places of the siblings that the reference's merge doesn't look at: each follows one that was merged."""
    state = "struct<last:int,skip:boolean,out:array<int>>"
    length = lambda x: F.when(x["text"].isNotNull(), F.length(x["text"]))

    def fold(xs: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            x, after, there = F.get(xs, j), F.get(xs, j + 1), j + 1 < F.size(xs)
            n, m, last = length(x), length(after), s["last"]
            small = n.isNotNull() & (n < least) & (strip(x["text"]) != "")
            back = small & last.isNotNull() & (m.isNull() | (last <= m))
            on = small & ~back & m.isNotNull()
            pack = lambda a, b, c: F.struct(a.cast("int").alias("last"), b.alias("skip"), c.alias("out")).cast(state)
            no, yes = F.lit(False), F.lit(True)
            # What stands last afterwards: the sibling that moved up, or the one that was merged into.
            moved = F.when(there, m).otherwise(last + n + F.length(x["name"]) + 3)
            return (
                F.when(s["skip"], pack(last, no, s["out"]))
                .when(back, pack(moved, there, F.when(there, F.array_append(s["out"], j + 1)).otherwise(s["out"])))
                .when(on, pack(n + m + F.length(after["name"]) + 3, yes, F.array_append(s["out"], j + 1)))
                .otherwise(pack(n, no, s["out"]))
            )

        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(False).alias("skip"), F.array().cast("array<int>").alias("out")).cast(state)
        done = F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1), start, step, lambda s: s["out"])
        return F.when(F.size(xs) > 0, done).otherwise(F.array().cast("array<int>"))

    return F.transform(F.array(leaves), fold)[0]


def stride_split(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<part, tokens, text>> of windows of ``size`` tokens, each ``overlap`` into the one before; one part 0 if it fits."""
    step = size - overlap

    def windows(ts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ts) - overlap - 1, F.lit(0)), F.lit(step))

        def window(at: Column, i: Column) -> Column:
            words = F.slice(ts, at + 1, F.lit(size))
            return F.struct((i + 1).cast("long").alias("part"), F.size(words).cast("long").alias("tokens"), F.array_join(words, " ").alias("text"))

        whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.size(ts).cast("long").alias("tokens"), F.array_join(ts, " ").alias("text")))
        return F.when(F.size(ts) > size, F.transform(starts, window)).otherwise(whole)

    return F.transform(F.array(tokens(text)), windows)[0]


SEPARATORS = ("\n\n", "\n", " ")


def recursive_spans(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int, int]]:
    """(start, end, shared) of parts of at most ``size`` tokens, cut at the coarsest separator that does; every piece keeps its own.

    ``shared`` is how many characters at the start repeat the end of the part before, up to ``overlap`` tokens; without them the
    parts are the text, whole. A single token is never cut, whatever its length.
    """

    def count(a: int, b: int) -> int:
        return sum(1 for _ in TOKEN.finditer(text, a, b))

    def pieces(a: int, b: int, k: int) -> Iterator[tuple[int, int]]:
        while k < len(separators) and text.find(separators[k], a, b) < 0:
            k += 1
        if k == len(separators) or count(a, b) <= size:
            yield a, b
            return
        while a < b:  # up to and including each separator
            at = text.find(separators[k], a, b)
            end = b if at < 0 else at + len(separators[k])
            yield from pieces(a, end, k + 1)
            a = end

    out: list[tuple[int, int, int]] = []
    window: list[tuple[int, int, int]] = []
    held, done = 0, 0
    for a, b in pieces(0, len(text), 0):
        n = count(a, b)
        if window and held + n > size:
            out.append((window[0][0], window[-1][1], done - window[0][0]))
            done = window[-1][1]
            while window and (held > overlap or held + n > size):
                held -= window.pop(0)[2]
        window.append((a, b, n))
        held += n
    if window and held:
        out.append((window[0][0], window[-1][1], done - window[0][0]))
    elif window and out:  # nothing but separators is left: they end the last part
        first, _, shared = out[-1]
        out[-1] = (first, window[-1][1], shared)
    return out


TOKEN = re.compile(r"[^ \n]+")


def recursive_split(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [text[a:b] for a, b, _ in recursive_spans(text, size, overlap, separators)]


def split_recursively(leaves: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id, part, shared, tokens, leaf_text); long leaves only go to Python, the others stay whole as part 0. Null texts give no rows."""
    rows = leaves.select("chunk_id", "leaf_text").where("leaf_text IS NOT NULL").withColumn("_n", token_len(F.col("leaf_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k + 1, s, t[a:b]) for i, t in zip(pdf["chunk_id"], pdf["leaf_text"], strict=True) for k, (a, b, s) in enumerate(recursive_spans(t, size, overlap))]
            yield pd.DataFrame(out, columns=["chunk_id", "part", "shared", "leaf_text"])

    long = rows.where(F.col("_n") > size).mapInPandas(run, "chunk_id bigint, part int, shared int, leaf_text string")
    short = rows.where(F.col("_n") <= size).select("chunk_id", F.lit(0).alias("part"), F.lit(0).alias("shared"), "leaf_text")
    return long.unionByName(short).withColumn("tokens", token_len(F.col("leaf_text")))


def prepare_text(leaves: DataFrame) -> DataFrame:
    """Leaf texts with their section path, the text to embed, and the tokens of the former."""
    path = F.array_join(F.slice("tree_path", F.lit(2), F.greatest(F.size("tree_path") - 1, F.lit(0))), "->")
    leaf = F.concat(F.lit("Section Path: "), path, F.lit("->"), F.col("name"), F.lit("\nSection Text: "), strip(F.col("leaf_text")))
    out = leaves.withColumn("leaf_text", leaf)
    return out.withColumns({"embed_text": F.concat(F.array_join("tree_path", "->"), F.lit("\n"), F.col("leaf_text")), "tokens": token_len(F.col("leaf_text"))})

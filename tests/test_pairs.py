import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataq import providers, session
from strataq.config import EngineConfig
from strataq.operators import pairs as P
from strataq.operators.prefix import prefix_sums
from strataq.operators.tree import tree_sections
from strataq.sources import wire
from strataq.streaming import resume

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize(("block", "groups", "most"), [(3, 4, 200), (1024, 1 << 20, 200), (1024, 1 << 20, 1 << 62)])
def test_prefix_sums_against_a_loop(spark, block, groups, most):
    r = random.Random(1)
    rows = [("a" if r.random() < 0.7 else "b", i, r.randrange(10)) for i in r.sample(range(most), 80)]
    got = {(x["k"], x["o"]): x["before"] for x in prefix_sums(spark.createDataFrame(rows, "k string, o bigint, v bigint"), ["k"], "o", "v", block, groups).collect()}
    assert got == {(k, o): sum(w for j, p, w in rows if j == k and p < o) for k, o, _ in rows}


def test_latest_row_of_each_key(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(40)]), r.choice([None, 1, 2, 3]), r.choice(["x", "y", None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, v string").withColumn("_n", F.lit(1))
    got = {x["k"]: (x["t"], x["v"]) for x in session.latest(df, ["k"], ["t"]).collect()}
    least = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    want = {}
    for k, t, v in rows:
        if k is not None and (k not in want or (least(t), (v is not None, v or "")) > (least(want[k][0]), (want[k][1] is not None, want[k][1] or ""))):
            want[k] = (t, v)
    assert got == want and session.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_batch_against_a_loop(spark):
    r = random.Random(4)
    for case in range(6):
        queue = [(i, r.randrange(1, 30)) for i in range(40)] + [(40, 500)]
        r.shuffle(queue)
        limit, most = r.choice([(200, 100), (10_000, 7), (25, 3)])
        want, total, n, full = {}, 0, 0, False
        for i, t in sorted(queue):
            if t > limit:
                want[i] = (False, "larger than a batch")
                continue
            full = full or total + t > limit or n + 1 > most
            want[i] = (not full, None)
            if not full:
                total, n = total + t, n + 1
        got = {x["i"]: (x["sent"], x["error"]) for x in P.pack_batch(spark.createDataFrame(queue, "i bigint, t bigint"), "i", "t", limit, most).collect()}
        assert got == want, case


def test_sampling_splitting_and_pairs(spark):
    munis = spark.createDataFrame([(f"m{i:03}",) for i in range(50)], "muni string")
    one = [r[0] for r in P.hash_sample(munis.repartition(7), "muni", 10).collect()]
    assert one == [r[0] for r in P.hash_sample(munis.coalesce(1), "muni", 10).collect()] and len(set(one)) == 10
    sizes = [r["count"] for r in P.node_split(munis, 7).groupBy("node").count().orderBy("node").collect()]
    assert sizes == [8, 7, 7, 7, 7, 7, 7]
    q = spark.createDataFrame([("1",), ("7w",), (None,)], "question_id string")
    assert P.all_pairs(munis, q).count() == 100 and P.all_pairs(munis, q.limit(0)).count() == 0
    s = spark.createDataFrame([("lundane", "A", "1", " Ordinet "), ("lundane", "A", "1", None), (None, "B", "2", "x")], "state string, unit_name string, census_id string, source string")
    m = P.municipalities(s).collect()
    assert [(r["muni"], r["source"]) for r in m] == [("A#1#lundane", "ordinet")]


def test_selection_reversal_blocks_and_errors(spark, monkeypatch):
    sample = spark.createDataFrame([("s", f"u{i:02}", "1", r) for i in range(30) for r in ("Ordinet ", None)] + [("s", "odd", "2", "elsewhere"), ("s", "none", "3", None)], "state string, unit_name string, census_id string, source string")
    embedded = spark.createDataFrame([(f"u{i:02}#1#s",) for i in range(0, 30, 2)] * 2 + [(None,)], "muni string")
    got = P.select_municipalities(sample, embedded, 7, 3).collect()
    assert len(got) == 7 and sorted(r["node"] for r in got) == [1, 1, 1, 2, 2, 3, 3] and all(int(r["muni"][1:3]) % 2 == 0 for r in got)
    assert P.select_municipalities(sample, embedded).count() == 15
    assert [r[0] for r in P.reversed_queue(spark.range(5), "id").collect()] == [4, 3, 2, 1, 0]
    errors = {r["muni"]: r["error"] for r in P.resolved_paths(P.municipalities(sample), "t").collect()}
    assert errors["u00#1#s"] is None and errors["odd#2#s"] == "no folder for source elsewhere" and errors["none#3#s"] == "no folder for source null"
    trees = spark.createDataFrame([("u00#1#s", "{}")], "muni string, tree_json string")
    assert {r["muni"]: r["error"] for r in P.with_tree(P.municipalities(sample), trees).collect()}["u01#1#s"] == "no tree"
    monkeypatch.setattr(P, "BLOCK", 3)
    q = spark.createDataFrame([(str(i),) for i in range(8)], "question_id string")
    assert P.all_pairs(embedded.where("muni IS NOT NULL").distinct(), q).distinct().count() == 15 * 8
    rows = [(1, None, 200, "r"), (2, "boom", None, None), (2, "boom", None, None), (3, None, 500, "r"), (4, None, None, None)]
    good, bad = P.captured(spark.createDataFrame(rows, "record_id bigint, error string, status_code int, response string"))
    assert [r["record_id"] for r in good.collect()] == [1] and {tuple(r) for r in bad.collect()} == {(2, "boom"), (3, "status 500"), (4, "no response")}
    day = spark.range(1).select(P.from_epoch(F.lit(86400)).cast("string").alias("t")).first()
    assert day["t"].startswith("1970-01-02")


def test_runs_leave_a_status_and_batches_an_id(spark, tmp_path):
    path = str(tmp_path / "status")
    assert wire.read_status(spark, path, "a") == (None, True)
    reqs = spark.createDataFrame([(f'{{"custom_id":"{i}"}}',) for i in range(5)], "request string")
    submitter = wire.FolderSubmitter(str(tmp_path / "batches"))
    one = submitter.submit(reqs)
    assert one == submitter.submit(reqs.repartition(3)) != submitter.submit(reqs.limit(2)) and spark.read.text(str(tmp_path / "batches" / one)).count() == 5
    wire.write_status(spark, path, "a", one, True)
    wire.write_status(spark, path, "b", None, True)
    wire.write_status(spark, path, "a", one, False)
    assert wire.read_status(spark, path, "a") == (one, False) and wire.read_status(spark, path, "b") == (None, True) and wire.read_status(spark, path, "c") == (None, True)
    (tmp_path / "sheet.csv").write_text('id,text\n1,"a\nb"\n2,\n')
    assert [tuple(r) for r in wire.read_sheet(spark, str(tmp_path / "sheet.csv"), "id string, text string").collect()] == [("1", "a\nb"), ("2", None)]


def test_settings_reach_the_operators(spark):
    spark.conf.set("strataq.nodes", "2")
    spark.conf.set("strataq.sample_size", "all")
    spark.conf.set("strataq.max_batch_tokens", "20")
    try:
        c = EngineConfig.of(spark)
        assert (c.nodes, c.sample_size, c.max_batch_tokens, c.top_k) == (2, None, 20, 50)
        queue = spark.createDataFrame([(i, 4) for i in range(5)], "i bigint, t bigint")
        assert [r["sent"] for r in c.pack(queue, "i", "t").orderBy("i").collect()] == [True, True, False, False, False]
        leaves = spark.createDataFrame([(1, "a b c d e f g")], "chunk_id bigint, leaf_text string")
        assert EngineConfig(chunk_tokens=3, chunk_overlap=1).split(leaves).count() > 2 and c.split(leaves).count() == 1
        tree = spark.createDataFrame([("t", '{"a":{"Leaf_Text":"x"},"b":{"Leaf_Text":"yy"}}')], "tree_id string, tree_json string")
        assert c.merge(tree_sections(tree)).count() == 1 and EngineConfig(merge_below_chars=1).merge(tree_sections(tree)).count() == 2
        assert c.expired(spark.sql("SELECT timestamp'2024-01-01 00:00:00' t"), "t", "2024-01-08 00:00:01").count() == 1
    finally:
        for k in ("nodes", "sample_size", "max_batch_tokens"):
            spark.conf.unset(f"strataq.{k}")


def test_a_tokenizer_may_be_replaced(spark):
    class Letters:
        def count(self, texts):
            return [len(t) for t in texts]

    rows = spark.createDataFrame([("a bc",), (None,)], "t string")
    assert [r[0] for r in rows.select(providers.count_tokens(F.col("t"))).collect()] == [2, 0]
    assert [r[0] for r in rows.select(providers.count_tokens(F.col("t"), Letters())).collect()] == [4, 0]


def test_attach_takes_the_first_and_keeps_the_unanswered(spark):
    req = spark.createDataFrame([("b", "x", 1), ("b", "x", 1), ("b", "y", 2)], "batch_id string, custom_id string, sent_at bigint")
    res = spark.createDataFrame([("b", "x", 9, 5, "r"), ("b", "x", 8, 4, "r"), ("b", "x", 7, 3, None), ("b", "z", 6, 1, "r")], "batch_id string, custom_id string, record_id bigint, received_at bigint, response string")
    got = {r["custom_id"]: (r["record_id"], r["answers"]) for r in P.attach_responses(req, res).collect()}
    assert got == {"x": (8, 2), "y": (None, 0)}


def test_attach_links_uneven_spellings(spark):
    req = spark.createDataFrame([("b", "Old Elm#7#tessaly_main_4a", 1), ("b", "Old Elm#7#tessaly_main_4", 2), ("c", "Old Elm#7#tessaly_main_4a", 3)], "batch_id string, custom_id string, sent_at bigint")
    spelled = ["Old Elm%237%23tessaly_main_4a", "OLD ELM#7#TESSALY_MAIN_4A", " Old Elm#7#tessaly_main_4a ", "Old%20Elm#7#tessaly_main_4a"]
    res = spark.createDataFrame([("b", s, 9 - i, 5 - i, "r") for i, s in enumerate(spelled)], "batch_id string, custom_id string, record_id bigint, received_at bigint, response string")
    got = {(r["batch_id"], r["custom_id"]): (r["record_id"], r["answers"]) for r in P.attach_responses(req, res).collect()}
    assert got == {("b", "Old Elm#7#tessaly_main_4a"): (6, 4), ("b", "Old Elm#7#tessaly_main_4"): (None, 0), ("c", "Old Elm#7#tessaly_main_4a"): (None, 0)}


def test_wire_round_trip_and_stream(spark, tmp_path):
    body = lambda i: {"model": "m", "messages": [{"role": "user", "content": f"u {i}"}]}
    reqs = spark.createDataFrame([(json.dumps({"custom_id": f"c{i}", "body": body(i)}),) for i in range(5)] + [("not json",)], "request string")
    wire.write_requests(reqs, str(tmp_path / "req"))
    done = providers.complete_requests(reqs)
    assert done.where("error IS NOT NULL").count() == 1
    done.where("error IS NULL").select(F.col("response").alias("value")).write.text(str(tmp_path / "res"))
    back = wire.read_results(spark, str(tmp_path / "res"))
    assert {r["custom_id"] for r in back.collect()} == {f"c{i}" for i in range(5)}
    assert wire.fetch_results(spark, "in_progress", "").count() == 0
    with pytest.raises(RuntimeError):
        wire.fetch_results(spark, "failed", "")
    for _ in range(2):
        resume.resume(spark, str(tmp_path / "res"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done.where("error IS NULL").select(F.col("response").alias("value")).write.mode("append").text(str(tmp_path / "res"))
    resume.resume(spark, str(tmp_path / "res"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["custom_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"c{i}" for i in range(5)]
    wire.append(back.select("custom_id", F.lit("m#1").alias("muni")), str(tmp_path / "t"), "muni")
    assert [r[0] for r in wire.catalogue(spark, str(tmp_path / "t")).collect()] == ["m#1"]


def test_files_by_name(spark, tmp_path):
    (tmp_path / "7w.txt").write_text("winds “here”\nand there", encoding="utf-8")
    assert [tuple(r) for r in wire.read_backgrounds(spark, str(tmp_path)).collect()] == [("7w", "winds “here”\nand there")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A b+c#1#x.json").write_text('{"a":{"Leaf_Text":"x"}}')
    assert [tuple(r) for r in wire.read_trees(spark, str(tmp_path / "t")).collect()] == [("A b+c#1#x", '{"a":{"Leaf_Text":"x"}}')]


def test_embedder_is_deterministic(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, None)], "i bigint, t string")
    v = {r["i"]: r["vec"] for r in providers.embed_texts(rows, "i", "t").collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1) and not any(v[3]) and not any(v[4])


def test_the_core_stands_without_the_llm_package():
    for p in (ROOT / "strataq").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "strataq.llm" not in p.read_text(), p
    code = "import sys; sys.modules['strataq.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_query_runs(spark, sf):
    import __spark_entry__ as e

    for name, query in e.queries().items():
        df = query(spark, sf)
        assert df.columns == list(dict.fromkeys(df.columns)), name
        assert df.count() >= 0, name
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

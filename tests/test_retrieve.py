import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.operators import retrieve as R
from strataq.providers import LexicalReranker

CHUNK = "muni string, chunk_id bigint, tokens bigint, vec array<double>, text string"


def fixture(spark, n=90, seed=1):
    r = random.Random(seed)
    chunks = [(f"m{r.randrange(3)}", i, r.randrange(0, 40), [r.gauss(0, 1) for _ in range(4)] if i % 11 else r.choice([None, [], [0.0] * 4]), r.choice(["a Parking rule", "fence here", "PERMIT for parking", "", None])) for i in range(n)]
    questions = [(f"q{k}", [r.gauss(0, 1) for _ in range(4)], "parking permit", kind) for k, kind in enumerate(["semantic", "keyword", None, "keyword"])]
    return chunks, questions, spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(questions, "question_id string, vec array<double>, rephrase string, rerank_type string")


def cosines(chunks, vec):
    out = {}
    for _, i, _, v, _ in chunks:
        ok = v is not None and len(v) == 4 and any(v)
        out[i] = round(float(np.dot(v, vec) / np.linalg.norm(v) / np.linalg.norm(vec)), 9) if ok else -1.0
    return out


def test_scores_missing_vectors_and_keywords(spark):
    chunks, questions, c, q = fixture(spark)
    words = {"q1": ["permit", "parking"], "q3": []}
    got = R.score_chunks(c, q, words).collect()
    assert len(got) == len(chunks) * len(questions)
    text = {x[1]: (x[4] or "").lower() for x in chunks}
    for k, vec, *_ in questions:
        want = cosines(chunks, vec)
        for r in got:
            if r["question_id"] == k:
                assert abs(r["cosine"] - want[r["chunk_id"]]) < 1e-8
                place = next((i + 1 for i, w in enumerate(words.get(k, [])) if w in text[r["chunk_id"]]), None)
                assert r["priority"] == place


def test_keyword_rank_against_pulling(spark):
    chunks, questions, c, q = fixture(spark)
    words = ["permit", "parking"]
    scored = R.score_chunks(c, q, {"q1": words})
    for k in (5, 500):
        got = {}
        for r in R.ranked(scored.where("question_id = 'q1'"), k, by_keyword=True).orderBy("pos").collect():
            got.setdefault(r["muni"], []).append(r["chunk_id"])
        cos = cosines(chunks, questions[1][1])
        for m in {x[0] for x in chunks}:
            left = sorted([x for x in chunks if x[0] == m], key=lambda x: (-cos[x[1]], x[1]))
            order = []
            for w in words:
                order += [x for x in left if w in (x[4] or "").lower()]
                left = [x for x in left if w not in (x[4] or "").lower()]
            assert got[m] == [x[1] for x in order + left][:k]


def test_budget_stops_at_the_first_overflow(spark):
    r = random.Random(6)
    rows, want = [], set()
    for p in range(40):
        total, stopped = 0, False
        for place in range(1, r.randrange(1, 12)):
            n = r.randrange(0, 30)
            rows.append(("q", f"m{p}", p * 100 + place, n, place))
            stopped = stopped or total + n > 60
            if not stopped:
                total += n
                want.add(p * 100 + place)
    placed = spark.createDataFrame(rows, "question_id string, muni string, chunk_id bigint, tokens bigint, place int")
    assert {x["chunk_id"] for x in R.within_budget(placed, 60).collect()} == want


def test_semantic_rerank_zero_deviation_and_empty_context(spark):
    c = spark.createDataFrame([("m", 1, 3, [1.0, 0.0, 0.0, 0.0], "parking"), ("m", 2, 3, [1.0, 0.0, 0.0, 0.0], "parking")], CHUNK)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0], "parking", "semantic")], "question_id string, vec array<double>, rephrase string, rerank_type string")
    ranked = R.semantic_rerank(R.with_relevance(R.best_chunks(c, q), q, c))
    out = ranked.orderBy("place").collect()
    assert [(r["chunk_id"], r["combined"]) for r in out] == [(1, 0.0), (2, 0.0)]
    pairs = spark.createDataFrame([("q", "m"), ("q", "none")], "question_id string, muni string")
    ctx = {r["muni"]: r["context"] for r in R.contexts(R.within_budget(ranked.drop("cosine"), 3), pairs, c).collect()}
    assert ctx == {"m": "##parking", "none": ""}


def test_dispatch_and_empty_tables(spark):
    chunks, questions, c, q = fixture(spark)
    out = R.rerank(c, q, {"q1": ["parking"]}, k=5).collect()
    per = {}
    for r in out:
        per.setdefault((r["question_id"], r["muni"]), []).append(r["place"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    assert max(len(v) for (k, _), v in per.items() if k == "q0") == 5 and max(len(v) for (k, _), v in per.items() if k == "q2") > 5
    assert R.score_chunks(c.limit(0), q).count() == 0 and R.score_chunks(c, q.limit(0)).count() == 0
    assert R.best_chunks(c.limit(0), q).count() == 0 and R.best_chunks(c, q.limit(0)).count() == 0


def wanted(chunks, questions, words, budget, k):
    """What each pair may select, by brute force: (question, municipality) -> chunk ids in order."""
    out = {}
    for name, vec, _, kind in questions:
        cos = cosines(chunks, vec)
        mine = words.get(name, []) if kind == "keyword" else []
        place = lambda x: next((i for i, w in enumerate(mine) if w in (x[4] or "").lower()), len(mine))  # noqa: B023, E731
        for m in {x[0] for x in chunks}:
            order = sorted([x for x in chunks if x[0] == m], key=lambda x: (place(x), -cos[x[1]], x[1]))
            if kind == "semantic":
                order = order[:k]
            total, got = 0, []
            for x in order:
                total += x[2]
                if total > budget and kind != "semantic":
                    break
                got.append(x[1])
            out[name, m] = got
    return out


@pytest.mark.parametrize("held", [8, 4096])
def test_one_pass_keeps_all_that_can_be_selected(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD", held)  # pruned often, or never
    chunks, questions, c, q = fixture(spark, n=400, seed=9)
    words = {"q1": ["permit", "parking"], "q3": ["fence"]}
    for parts in (1, 6):
        best = R.best_chunks(c.repartition(parts), q, words, k=7, budget=60)
        want = wanted(chunks, questions, words, 60, 7)
        got = {}
        for r in R.within_budget(best.withColumnRenamed("pos", "place"), 60).collect():
            got.setdefault((r["question_id"], r["muni"]), {})[r["place"]] = r["chunk_id"]
        for (name, m), ids in want.items():
            mine = got.get((name, m), {})
            if name != "q0":
                assert [mine[i] for i in sorted(mine)] == ids
        stats = {(r["question_id"], r["muni"]): (r["chunks"], r["mean"], r["sd"]) for r in best.where("pos = 1").collect()}
        for name, vec, *_ in questions:
            cos = cosines(chunks, vec)
            for m in {x[0] for x in chunks}:
                xs = [cos[x[1]] for x in chunks if x[0] == m]
                assert stats[name, m] == pytest.approx((len(xs), np.mean(xs), np.std(xs)))
        top = R.rerank_best(c.repartition(parts), q, words, k=7, budget=60)
        n = {(r["question_id"], r["muni"]): r["n"] for r in top.groupBy("question_id", "muni").agg(F.count("*").alias("n")).collect()}
        assert {n["q0", m] for m in {x[0] for x in chunks}} == {7}


def test_equal_cosines_have_no_deviation(spark):
    c = spark.createDataFrame([("m", i, 1, [0.3, 0.1, 0.7, 0.2], "x") for i in range(300)], CHUNK).repartition(7)
    q = spark.createDataFrame([("q", [0.2, 0.9, 0.4, 0.1])], "question_id string, vec array<double>")
    assert {r["sd"] < 1e-12 for r in R.best_chunks(c, q).collect()} == {True}


def test_relevance_by_words_and_by_a_reranker(spark):
    chunks, questions, c, q = fixture(spark)
    top = R.best_chunks(c, q.drop("rerank_type"), k=9)
    text = {x[1]: x[4] for x in chunks}
    a = {(r["question_id"], r["chunk_id"]): r["relevance"] for r in R.with_relevance(top, q, c).collect()}
    b = {(r["question_id"], r["chunk_id"]): r["relevance"] for r in R.with_relevance(top, q, c, LexicalReranker()).collect()}
    assert a == b and len(a) == top.count() and a[next(iter(a))] == pytest.approx(len(R.query_words("parking permit") & R.query_words(text[next(iter(a))[1]])) / 2)
    none = R.with_relevance(top, q.withColumn("rephrase", F.lit(None).cast("string")), c.withColumn("text", F.lit(None).cast("string")))
    assert {r["relevance"] for r in none.collect()} == {0.0}


def test_vectors_from_the_store_or_the_embedder(spark):
    q = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c"), ("4", None)], "question_id string, detail string")
    store = spark.createDataFrame([("c", [1.0, 2.0])], "detail string, vec array<double>")
    got = {r["question_id"]: (r["from_store"], r["vec"]) for r in R.look_up_vectors(q, store).collect()}
    assert got["3"] == (True, [1.0, 2.0]) and got["1"] == got["2"] and got["1"][0] is False and len(got["1"][1]) == 64 and got["4"] == (False, None)
    assert [r["detail"] for r in R.missing_vectors(q, store).collect()] == ["a b"]


def test_whole_order_over_many_ranges(spark):
    chunks, questions, c, q = fixture(spark, n=700)
    chunks = [("m0" if x[0] == "m1" else x[0], *x[1:]) for x in chunks]  # a hot one spreads over ranges
    c = spark.createDataFrame(chunks, CHUNK).repartition(5)
    got = {}
    for r in R.rerank(c, q, {"q1": ["permit", "parking"]}, k=50).collect():
        got.setdefault((r["question_id"], r["muni"]), {})[r["place"]] = r["chunk_id"]
    for k, vec, _, kind in questions[1:]:
        cos, words = cosines(chunks, vec), ["permit", "parking"] if k == "q1" else []
        for m in {x[0] for x in chunks}:
            place = lambda x: next((i for i, w in enumerate(words) if w in (x[4] or "").lower()), len(words))  # noqa: B023, E731
            want = sorted([x for x in chunks if x[0] == m], key=lambda x: (place(x), -cos[x[1]], x[1]))
            assert got[k, m] == {i + 1: x[1] for i, x in enumerate(want)}
    assert all(len(v) == 50 for (k, _), v in got.items() if k == "q0")


def test_rerank_queries_leave_no_chunk_out(spark, sf):
    from strataq.queries import retrieval as Q

    chunks = Q.chunks(spark, sf).count()
    assert {r["count"] for r in Q.keyword_rerank(spark, sf).groupBy("question_id").count().collect()} == {chunks}
    semantic = {r["question_id"] for r in Q.questions(spark, sf).where("lower(rerank_type) = 'semantic'").collect()}
    counts = {r["question_id"]: r["count"] for r in Q.rerank_dispatch(spark, sf).groupBy("question_id").count().collect()}
    assert len(set(counts) - semantic) > 0 and {n for k, n in counts.items() if k not in semantic} == {chunks}


def test_every_vector_is_read_and_every_document_stays(spark, tmp_path):
    from strataq.queries import retrieval as Q

    ids = [i for i in range(700) if i != 650]  # 699 vectors, and one number without any
    spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [0, 499, 500, 620, 650, 698, 699, 1000]
    spark.createDataFrame([(i, "some text", "m") for i in docs], "doc_id bigint, text string, muni string").write.parquet(f"{tmp_path}/documents.parquet")
    question = [("1", "x" * 600, "x", None), ("2", None, "x", None)]
    spark.createDataFrame(question, "id string, question_detail string, question_rephrase string, double_check_context string").write.parquet(f"{tmp_path}/question.parquet")
    got = {r["chunk_id"]: r["vec"] and r["vec"][0] for r in Q.chunks(spark, str(tmp_path)).collect()}
    assert got == {i: None if i % 699 == 650 else float(i % 699) for i in docs}
    assert {r["question_id"]: r["vec"] and r["vec"][0] for r in Q.questions(spark, str(tmp_path)).collect()} == {"1": 600.0, "2": None}
    scores = {(r["question_id"], r["chunk_id"]): r["cosine"] for r in Q.cosine_scores(spark, str(tmp_path)).collect()}
    assert len(scores) == 16 and scores["1", 650] == -1.0 and scores["2", 0] == -1.0 and scores["1", 500] > 0.9


def test_greatest_cosine_of_several_vectors(spark):
    chunks, questions, _, q = fixture(spark)
    r = random.Random(3)
    several = [(m, i, t, None if i % 13 == 0 else [r.choice([[r.gauss(0, 1) for _ in range(4)], None, [0.0] * 4, []]) for _ in range(r.randrange(4))]) for m, i, t, *_ in chunks]
    c = spark.createDataFrame(several, "muni string, chunk_id bigint, tokens bigint, vec array<array<double>>")
    got = {(x["question_id"], x["chunk_id"]): x["cosine"] for x in R.score_chunks(c, q).collect()}
    assert len(got) == len(chunks) * len(questions)
    for k, vec, *_ in questions:
        for m, i, t, vs in several:
            want = max((cosines([(m, 0, t, v, "")], vec)[0] for v in vs or []), default=-1.0)
            assert abs(got[k, i] - want) < 1e-8
    assert {x["cosine"] for x in R.score_chunks(c.where("vec IS NULL"), q).collect()} == {-1.0}

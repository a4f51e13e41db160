import random
from collections import Counter

import pytest

from strataq.llm.mixing import budgets, mix_sources, mixture_report
from strataq.llm.packing import container_fill, fill_windows, pack_documents
from strataq.llm.tokens import TokenizerSpec, encoder, token_sizes

SIZES = "doc_id bigint, source string, tokens bigint"


def corpus(n, seed, hot=0.4):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < hot else f"s{r.randrange(5)}", r.choice([0, 1, 7, 7, r.randrange(1, 90), r.randrange(1, 900)])) for i in range(n)]


def test_windows_hold_every_item_once_and_little_room():
    r = random.Random(2)
    for _ in range(40):
        cap = r.choice([10, 64, 200])
        sizes = [r.randrange(1, cap + 1) for _ in range(r.randrange(0, 300))]
        sources = [r.choice("abc") for _ in sizes]
        windows = fill_windows(sizes, sources, cap, {"a": 0.5, "b": 0.3, "c": 0.2}, {})
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in w) <= cap for w in windows)
        lone = sum(s > cap / 2 for s in sizes)  # no two of these share a window
        assert len(windows) <= 1.25 * max(lone, -(-sum(sizes) // cap)) + 1


def test_windows_follow_the_target_proportions():
    sizes, sources = [5] * 3000, ["a"] * 1500 + ["b"] * 900 + ["c"] * 600
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    for w in fill_windows(sizes, sources, 100, share, {})[:-3]:
        n = Counter(sources[i] for i in w)
        assert all(abs(n[s] * 5 - 100 * share[s]) <= 5 for s in share)
    first = fill_windows(sizes, sources, 100, share, {"c": 100.0})[0]
    assert Counter(sources[i] for i in first)["c"] > 10  # a carried deficit is paid first


@pytest.mark.parametrize("bucket", [300, 10_000_000])
def test_documents_are_placed_whole(spark, bucket):
    docs = corpus(400, 5)
    packed = pack_documents(spark.createDataFrame(docs, SIZES), [("s", 50), ("l", 400)], bucket_tokens=bucket)
    rows = packed.collect()
    for spec, cap in [("s", 50), ("l", 400)]:
        mine = [r for r in rows if r["spec_name"] == spec]
        boxes = Counter()
        for r in mine:
            boxes[r["container_id"]] += r["tokens"]
        assert max(boxes.values()) <= cap
        pieces = {}
        for r in mine:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["tokens"]))
        for i, _, n in docs:
            got = sorted(pieces.get(i, []))
            assert sum(x[2] for x in got) == n and (n <= cap) == (len(got) <= 1)
            assert [x[1] for x in got] == [k * cap for k in range(len(got))] and all(x[2] == cap for x in got[:-1])
    if bucket > 1000:
        assert all(r["unused"] < 0.03 for r in container_fill(packed).collect())


def test_packing_is_repeatable_and_takes_nothing(spark):
    df = spark.createDataFrame(corpus(200, 6), SIZES)
    a = {tuple(r) for r in pack_documents(df, [("x", 80)]).collect()}
    assert a == {tuple(r) for r in pack_documents(df.repartition(7), [("x", 80)]).collect()}
    assert pack_documents(df.limit(0), [("x", 80)]).count() == 0
    with pytest.raises(ValueError, match="positive"):
        pack_documents(df, [("x", 0)])


def test_mixture_against_a_loop(spark):
    docs = corpus(600, 8)
    targets = [("HOT", 0.5, 1), ("s0", 0.2, 3), (" S1 ", 0.2, 2), ("none", 0.1, 4)]
    sizes, target = spark.createDataFrame(docs, SIZES), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    plan = {r["source"]: r for r in budgets(sizes, target).collect()}
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    most = min(have[s] * m / (w / 0.9) for s, w, m in [("hot", 0.5, 1), ("s0", 0.2, 3), ("s1", 0.2, 2)])
    assert all(plan[s]["budget"] == int(w / 0.9 * most + 1e-6) for s, w in [("hot", 0.5), ("s0", 0.2), ("s1", 0.2)]) and plan["none"]["budget"] == 0
    for span in (50, 100_000):
        rows = mix_sources(sizes, target, range_documents=span).collect()
        uses = Counter((r["source"], r["doc_id"]) for r in rows)
        for s in ("hot", "s0", "s1"):
            order = sorted({(r["key"], r["doc_id"], r["tokens"]) for r in rows if r["source"] == s})
            counts = [uses[s, d] for _, d, _ in order]
            assert counts == sorted(counts, reverse=True) and max(counts) - min(counts) <= 1 and max(counts) <= plan[s]["max_repeats"]
            got = sum(r["tokens"] for r in rows if r["source"] == s)
            assert abs(got - plan[s]["budget"]) <= 900 / 2
        assert {r["source"] for r in rows} == {"hot", "s0", "s1"}
    report = {r["source"]: r for r in mixture_report(mix_sources(sizes, target), budgets(sizes, target)).collect()}
    assert report["none"]["actual_share"] == 0 and abs(report["s0"]["actual_share"] - 0.2 / 0.9) < 0.02


def test_mixture_of_odd_tables(spark):
    sizes = spark.createDataFrame(corpus(50, 1), SIZES)
    odd = spark.createDataFrame([("hot", None, None), (None, 0.5, 2), ("s0", -1.0, 0)], "source string, target_share double, max_repeats int")
    assert mix_sources(sizes, odd).count() == 0 and mix_sources(sizes, odd.limit(0)).count() == 0 and mix_sources(sizes.limit(0), odd).count() == 0
    some = mix_sources(sizes, spark.createDataFrame([("hot", 1.0, 5)], "source string, target_share double, max_repeats int"), total_tokens=100).collect()
    assert len({r["epoch"] for r in some}) <= 1


def test_sizes_of_odd_documents(spark):
    rows = [(1, "a word", "A-B ", 0), (1, "a word", "A-B ", 0), (2, None, None, 0), (3, "", "x", 0), (None, "y", "x", 0), (4, "long " * 30_000, "a b", 0), (5, "x" * 100_000, "A_B", 0)]
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in token_sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")).collect()}
    n = len(encoder(TokenizerSpec()).encode_ordinary("long " * 30_000))
    assert got[1] == ("a_b", 2) and got[2] == ("unknown", 0) and got[3] == ("x", 0) and got[4] == ("a_b", n) and got[5][0] == "a_b" and len(got) == 5


def test_clashing_columns_and_null_ids(spark):
    docs = corpus(60, 9) + [(None, "hot", 5)]
    plain = spark.createDataFrame(docs, SIZES)
    odd = spark.createDataFrame([(*d, 1, 2, 3, 4, "x", 6) for d in docs], SIZES + ", capacity int, budget int, bucket int, share int, key string, range int")
    assert {tuple(r) for r in pack_documents(plain, [("x", 80)]).collect()} == {tuple(r) for r in pack_documents(odd, [("x", 80)]).collect()}
    target = spark.createDataFrame([("hot", 0.5, 2, 1), ("s1", 0.5, 2, 1)], "source string, target_share double, max_repeats int, budget int")
    a, b = [{tuple(r) for r in mix_sources(d, target).collect()} for d in (plain, odd)]
    assert a == b and a and all(r[1] is not None for r in a)


def distances(sizes, sources, capacity):
    total, own = sum(sizes), Counter()
    for n, s in zip(sizes, sources, strict=True):
        own[s] += n
    share = {s: n / total for s, n in own.items()}
    windows, far = fill_windows(sizes, sources, capacity, share, {}), []
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= capacity for w in windows)
    for w in windows[:-1]:
        got = Counter()
        for i in w:
            got[sources[i]] += sizes[i]
        far.append(sum(abs(got[s] / sum(got.values()) - share[s]) for s in share) / 2)
    return far, 1 - total / (capacity * len(windows))


@pytest.mark.parametrize(("spread", "most", "mean", "tail"), [(0.5, 400, 0.04, 0.06), (0.9, 4000, 0.13, 0.3)])
def test_windows_keep_the_proportions_to_the_end(spread, most, mean, tail):
    """Of small items all windows have the target proportions, the last as well; large ones, up to half a window, spoil some."""
    r = random.Random(3)
    sizes = [min(most, max(5, int(r.lognormvariate(5.0, spread)))) for _ in range(9000)]
    sources = [r.choices("abcdef", (30, 25, 20, 15, 7, 3))[0] for _ in sizes]
    far, unused = distances(sizes, sources, 8192)
    tenth = far[-len(far) // 10 :]
    assert sum(far) / len(far) < mean and sum(tenth) / len(tenth) < tail and unused < 0.01


def test_windows_of_few_items_are_full():
    r = random.Random(4)
    sizes = [min(512, max(5, int(r.lognormvariate(5.2, 0.9)))) for _ in range(4000)]
    far, unused = distances(sizes, [r.choice("abc") for _ in sizes], 512)
    assert unused < 0.01


def test_distance_is_reported(spark):
    rows = [("s", 10, "0:0", 0, 1, "a", 0, 0, 5), ("s", 10, "0:0", 1, 2, "b", 0, 0, 5), ("s", 10, "0:1", 0, 3, "a", 0, 0, 10), ("s", 10, "full:4:0", 0, 4, "b", 0, 0, 10)]
    packed = spark.createDataFrame(rows, "spec_name string, capacity bigint, container_id string, position int, doc_id bigint, source string, piece int, token_start bigint, tokens bigint")
    r = container_fill(packed).first()
    assert (r["distance"], r["distance_90"], r["unused"]) == (0.25, 0.5, 0.0)


def test_given_shares(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(400)], SIZES)
    rows = pack_documents(docs, [("x", 100)], shares={"a": 0.8, "b": 0.2}, bucket_tokens=10**9).where("container_id = '0:0'").groupBy("source").sum("tokens").collect()
    assert {r[0]: r[1] for r in rows} == {"a": 80, "b": 20}

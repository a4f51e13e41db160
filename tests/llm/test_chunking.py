import random

import numpy as np
import pytest

from strataq.llm.chunking import TOKEN, ChunkSpec, boundary_ranks, cut_places, landmark_values, split_oversized, split_text

SMALL = ChunkSpec(limit=60, overlap=12, least=16, most=48, window=6, reach=8)


def text(r, n):
    out = []
    for _ in range(n):
        out.append(r.choice(["lot", "yard.", "fence;", "Sec.", "a", "zoning", "x" * r.randrange(1, 30)]) + r.choice([" "] * 12 + ["\n", "\n\n", "  ", " \n"]))
    return "".join(out)


def check(t, spec):
    parts, want, out, prev = split_text(t, spec), TOKEN.findall(t), [], []
    for k, (part, tokens, shared, start, piece) in enumerate(parts):
        words = TOKEN.findall(piece)
        assert len(words) == tokens <= spec.limit and t[start : start + len(piece)] == piece
        assert shared <= spec.overlap and words[:shared] == (prev[len(prev) - shared :] if shared else [])
        assert part == (k + 1 if len(parts) > 1 else 0)
        out += words[shared:]
        prev = words
    assert out == want
    return parts


@pytest.mark.parametrize("spec", [SMALL, ChunkSpec(limit=10, overlap=0, least=1, most=10, window=3, reach=2), ChunkSpec(limit=5, overlap=4, least=1, most=1, window=2, reach=0)])
def test_parts_are_bounded_and_whole(spec):
    r = random.Random(3)
    for n in [0, 1, 5, 59, 60, 61, 200, 900]:
        check(text(r, n), spec)
    check("word joined\ttab\r\n" * 100, spec)
    check("x" * 5000, spec)
    check("one " * 500, spec)


def test_cuts_are_natural_where_they_can_be():
    t = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(20)) + "." for i in range(40))
    parts = check(t, SMALL)
    assert all(p[4].endswith(".") for p in parts[:-1])


def test_an_edit_moves_only_neighbours():
    r = random.Random(9)
    kept = []
    for _ in range(30):
        t = text(r, 1500)
        words = t.split(" ")
        words.insert(len(words) // 2, "an inserted remark")
        a, b = {p[4] for p in split_text(t, SMALL)}, {p[4] for p in split_text(" ".join(words), SMALL)}
        kept.append(len(a & b) / len(a))
    assert np.median(kept) > 0.85


def test_landmarks_depend_on_their_window_only():
    tokens = [f"t{i % 17}" for i in range(200)]
    a, b = landmark_values(tokens, 8), landmark_values([*tokens[50:], "z"], 8)
    assert (a[54:196] == b[4:146]).all()
    assert cut_places(a, boundary_ranks("", np.array([0]), np.array([0])).repeat(200), SMALL)[0] == 0


def test_limits_must_fit():
    with pytest.raises(ValueError, match="limit"):
        ChunkSpec(limit=100, overlap=50, most=80)


def test_leaves_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        t = r.choice([None, "", " \n", text(r, 50), text(r, 300)])
        rows.append((i, 5, t, "x", 1))
        if r.random() < 0.4:
            rows.append((i, r.choice([3, 5, 9, None]), r.choice([t, text(r, 200), None]), "y", 2))
    rows += [(None, 1, text(r, 300), "n", 3), rows[3], rows[3]]
    leaves = spark.createDataFrame(rows, "chunk_id bigint, ingested_at bigint, leaf_text string, part string, tokens int")
    parts = split_oversized(leaves, SMALL).collect()
    got = {}
    for p in parts:
        got.setdefault(p["chunk_id"], []).append(p)
    for i in range(60):
        newest = max((x[1] is not None, x[1] or 0) for x in rows if x[0] == i)
        texts = [x[2] for x in rows if x[0] == i and (x[1] is not None, x[1] or 0) == newest]
        sizes = {len(TOKEN.findall(t or "")) > 60 for t in texts}
        if len(sizes) == 1:
            assert (i in got) == sizes.pop()
    assert None not in got and all([p["part"] for p in sorted(v, key=lambda p: p["part"])] == list(range(1, len(v) + 1)) for v in got.values())
    assert split_oversized(leaves.limit(0)).count() == 0

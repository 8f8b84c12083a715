"""Exact round trips of splitting and packing."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import packing as P
from colloquy.llm import splitting as S


def holds(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert all(0 < b - a <= limit or not text for a, b, _ in pieces)
    assert all(0 <= r <= overlap for _, _, r in pieces)
    assert "".join(text[a + r : b] for a, b, r in pieces) == text
    for (_, end, _), (a, _, r) in zip(pieces, pieces[1:]):
        assert a + r == end  # the repeated part is the end of the piece before
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!\n\té", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    holds(text, limit, overlap)


def test_natural_boundaries():
    text = "\n\n".join(" ".join(f"Word{i} is here." for i in range(30)) for _ in range(6))
    for a, b, r in holds(text, 600, 60)[:-1]:
        assert text[b - 1].isspace()
    assert len(holds("x" * 5000, 1800, 120)) == 3
    assert S.split_text("", 10, 2) == [(0, 0, 0)]
    with pytest.raises(ValueError):
        S.split_text("a", 5, 5)


def test_sides(spark):
    df = spark.createDataFrame([(1, "a " * 1000, None, "x"), (2, "", "short", "x"), (2, "é" * 1801, "é" * 1800, "x"), (1, "a " * 1000, None, "x")], "pair_id long, src string, mt string, side string")
    got = S.split_sides(df, "pair_id").collect()
    assert {(r["pair_id"], r["side"]) for r in got} == {(1, "src"), (2, "src")}
    assert sum(r["piece_no"] == 0 for r in got) == 3 and all(len(r["text"]) <= 1800 for r in got)
    assert S.split_sides(df, "pair_id", only_oversized=False).where("piece_no = 0").count() == 6
    assert S.split_sides(df.limit(0), "pair_id").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_blocks(sizes):
    bins = P.pack_block(np.array(sizes, np.int64), 50)
    loads = np.bincount(bins, weights=sizes) if sizes else np.zeros(1)
    assert loads.max() <= 50
    # no worse than best fit decreasing, the incumbent of every container
    assert len(set(bins[np.array(sizes) > 0].tolist())) <= -(-2 * sum(sizes) // 50) + 1 if sizes else True


def test_completion_is_optimal():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(40):
        items = rng.integers(3, 40, 9).tolist()
        room = int(rng.integers(30, 90))
        best = max(sum(c) for n in range(10) for c in combinations(items, n) if sum(c) <= room)
        sizes = sorted(set(items), reverse=True)
        assert sum(P.complete([items.count(s) for s in sizes], sizes, room, nodes=10**6)) == best


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(loads)
            return
        for k in {loads[k]: k for k in range(len(loads)) if loads[k] + sizes[i] <= capacity}.values():
            place(i + 1, [x + sizes[i] * (j == k) for j, x in enumerate(loads)])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best[0]


def test_branch_and_bound_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.choice([20, 50, 100]))
        sizes = sorted(rng.integers(capacity // 6, capacity // 2 + 8, int(rng.integers(1, 11))).tolist(), reverse=True)
        least = fewest(sizes, capacity)
        assert P.least_containers(sizes, capacity) <= least
        bins = P.pack_block(np.array(sizes), capacity, search=None)
        assert len(set(bins.tolist())) == least and np.bincount(bins, sizes).max() <= capacity
        assert P.fewer(sizes, capacity, least - 1, None) is None
    # best fit first fills 6 + 2 + 2 and is left with four containers
    assert len(set(P.pack_block(np.array([6, 5, 5, 5, 4, 3, 2, 2, 2, 2, 2, 2]), 10, search=None).tolist())) == 4


def test_fillings_are_undominated():
    def found(least):
        return {tuple(f) for f in P.fillings([1, 2, 1, 1], [7, 4, 3, 1], 10, least)}

    assert found(9) == {(7, 3), (4, 4, 1)} and found(10) == {(7, 3)} and found(11) == set()


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5000, 2048, 0, 1000, 1000, 48, 3, None, 2047, 1, 1])] + [(3, 1000), (1, 2048), (None, 2048), (None, 4096)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, n_tokens long, container string")
    got = P.pack(df).collect()
    load, total = {}, {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
    assert max(load.values()) <= 2048
    assert total == {None: 6144, 0: 5000, 1: 4096, 2: 0, 3: 2000, 4: 1000, 5: 48, 6: 3, 7: 0, 8: 2047, 9: 1, 10: 1}
    assert sorted(r["start"] for r in got if r["doc_id"] == 0) == [0, 2048, 4096]
    assert all(r["part_no"] == 0 for r in got if r["doc_id"])
    assert P.pack(df.limit(0)).count() == 0


def test_space_left_over_of_the_table(spark, sf_dir):
    from colloquy.llm import bpe
    from colloquy.sources import table

    got = P.pack(bpe.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text")).toPandas()
    used = got.groupby("container")["size"].sum()
    assert used.max() <= 2048 and len(used) <= -(-used.sum() // 2048) + 1

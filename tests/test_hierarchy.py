"""Spanning trees and single linkage against Prim's method and merging by hand."""

import numpy as np
import pytest

from trendlake.operators import hierarchy, spanning_tree

SCHEMA = "g string, id long, a double, b double"


def prim(x):
    """Merge heights of single linkage, ascending."""
    best = np.hypot(*(x - x[0]).T)
    open_rows = np.arange(1, len(x))
    out = []
    while len(open_rows):
        i = open_rows[np.argmin(best[open_rows])]
        out.append(best[i])
        open_rows = open_rows[open_rows != i]
        best = np.minimum(best, np.hypot(*(x - x[i]).T))
    return np.sort(out)


def labels_at(x, keys, height):
    part = list(range(len(x)))
    for i in range(len(x)):
        near = np.flatnonzero(np.hypot(*(x - x[i]).T) <= height)
        low = {part[j] for j in near}
        part = [min(low) if v in low else v for v in part]
    name = {}
    for p, k in zip(part, keys):
        name[p] = min(name.get(p, k), k)
    return [name[p] for p in part]


def shapes():
    rng = np.random.default_rng(11)
    yield "normal", rng.normal(size=(300, 2))
    yield "line", np.c_[rng.permutation(200) ** 1.1, np.zeros(200)]
    yield "grid", np.array([(i, j) for i in range(12) for j in range(12)], dtype=float)
    yield "copies", np.repeat(rng.normal(size=(30, 2)), 7, axis=0)
    yield "far", np.r_[rng.normal(size=(150, 2)), rng.normal(0, 1e-7, (80, 2)), [[1e12, -1e12]]]
    yield "two", np.array([[0.0, 0.0], [3.0, 4.0]])
    yield "one", np.array([[2.0, 2.0]])
    yield "same", np.zeros((9, 2))


def test_heights_are_those_of_single_linkage(spark):
    """All shapes side by side: every group has the tree it has alone."""
    rows = [(name, i, *map(float, p)) for name, x in shapes() for i, p in enumerate(x)]
    tree = hierarchy.linkage_tree(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], by=["g"], standardize=False)
    names = {r["grp"]: r["g"] for r in tree.rows.select("grp", "g").distinct().collect()}
    got = {}
    for r in tree.heights().collect():
        got.setdefault(names[r["grp"]], []).append(r["height"])
    for name, x in shapes():
        assert np.sort(got.get(name, [])) == pytest.approx(prim(x), rel=1e-9, abs=1e-12), name


def test_the_three_cuts(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (50, 2)), rng.normal((0, 7), 0.2, (20, 2)), [[9.0, -9.0]]]
    x = np.r_[x, x[:3]]
    keys = [int(k) for k in rng.permutation(len(x))]
    tree = hierarchy.linkage_tree(spark.createDataFrame([("g", k, *map(float, p)) for k, p in zip(keys, x)], SCHEMA), "id", ["a", "b"], standardize=False)
    h = prim(x)

    def same(out, height):
        assert {r["id"]: r["cluster"] for r in out.collect()} == dict(zip(keys, labels_at(x, keys, height)))

    for k in (1, 2, 4, 40):
        same(tree.cut_by_count(k), h[len(x) - k - 1])
    same(tree.cut_by_count(len(x)), 0.0)
    same(tree.cut_at_largest_jump(), h[int(np.argmax(np.diff(h))) - 1])
    same(tree.cut_by_deviation(), h.mean() + h.std())
    same(tree.at_height(0.0), 0.0)
    assert [r["step"] for r in tree.ordered_heights().orderBy("step").collect()] == list(range(1, len(x)))
    with pytest.raises(ValueError):
        tree.cut_by_count(0)


def test_keys_that_stand_in_several_groups(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 5.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 1.0, 0.0), (None, 1, 0.5, 0.0), (None, 1, 0.5, 0.0), ("b", 3, float("nan"), 0.0), ("a", 9, None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = hierarchy.single_linkage(df, "id", ["a", "b"], 1.0, by=["g"], standardize=False).collect()
    assert sorted(((r["g"], r["id"], r["cluster"]) for r in out), key=repr) == sorted(
        [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1), (None, 1, 1), (None, 1, 1)], key=repr
    )
    cut = hierarchy.linkage_tree(df, "id", ["a", "b"], by=["g"], standardize=False).cut_by_count(1).collect()
    assert {(r["g"], r["cluster"]) for r in cut} == {("a", 1), ("b", 1), (None, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    tree = hierarchy.linkage_tree(df, "id", ["a", "b"], standardize=False)
    assert tree.heights().collect() == [] and tree.cut_by_count(3).collect() == []
    assert tree.cut_at_largest_jump().collect() == [] and tree.cut_by_deviation().collect() == []


def test_candidates_stay_few(spark):
    x = np.random.default_rng(1).normal(size=(600, 2))
    places = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "grp long, id long, x double, y double")
    assert spanning_tree.candidate_edges(places).count() < 600 * 40


@pytest.mark.parametrize("block", [1, 2, 9, 40])
def test_blocks_of_any_size_leave_the_tree(spark, block):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(150, 2)), np.c_[np.arange(60.0), np.full(60, 9.0)], rng.normal(-7, 1e-5, (60, 2)), [[900.0, 3.0]]]
    places = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(x)], "grp long, id long, x double, y double")
    edges = spanning_tree.lightest_tree(spanning_tree.candidate_edges(places, block)).collect()
    for grp in (0, 1):
        assert np.sort([r["w"] for r in edges if r["a"] % 2 == grp]) ** 0.5 == pytest.approx(prim(x[grp::2]), rel=1e-9)
    assert all(r["a"] % 2 == r["b"] % 2 for r in edges)


def test_rows_of_a_block_meet_no_pairs(spark):
    x = np.random.default_rng(1).normal(size=(3000, 2))
    places = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "grp long, id long, x double, y double")
    assert spanning_tree.candidate_edges(places, 256).count() < 3000 * 5


def test_small_and_large_groups_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(8)
    big = 2**60
    rows = [(g, f"k{i:03d}", i + big, *map(float, p)) for g, n in (("a", 60), ("b", 7), (None, 20)) for i, p in enumerate(rng.integers(0, 12, (n, 2)))]
    rows.append(("a", None, None, 0.0, 0.0))
    df = spark.createDataFrame(rows, "g string, name string, id long, a double, b double")
    for key in ("name", "id"):
        outs = []
        for small in (0, 30, 4096):
            monkeypatch.setattr(hierarchy, "SMALL", small)
            out = hierarchy.single_linkage(df, key, ["a", "b"], 1.0, by=["g"], standardize=False)
            outs.append(sorted((tuple(r) for r in out.collect()), key=repr))
        assert outs[0] == outs[1] == outs[2] and len(outs[0]) == len(rows)


def test_groups_of_few_rows_need_few_jobs(spark):
    df = spark.createDataFrame([(i % 40, i, float(i % 7), float(i % 5)) for i in range(400)], "g long, id long, a double, b double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        hierarchy.single_linkage(df, "id", ["a", "b"], 1.0, by=["g"]).collect()
        assert len(tracker.getJobIdsForGroup("few-jobs")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

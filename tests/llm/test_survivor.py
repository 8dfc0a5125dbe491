import random

from pyspark.sql import functions as F

from bitweave.llm.survivor import Bundle, best_bundles, consistent_bundles, search_effort

SCHEMA = "a string, b string, id long, x long, v long, t long, k0 int, n int, group_id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def bundles():
    return [Bundle("x", ("x",), F.col("x") >= 0, F.col("x")), Bundle("v", ("v",), F.col("v") >= 1, F.col("v")), Bundle("t", ("t",), F.col("t").isNotNull(), F.col("t"))]


def data(seed):
    r = random.Random(seed)
    pick = lambda: r.choice([None, -1, 0, 1, 2, 3])
    rows = [(r.choice("pq"), r.choice("rs"), i, pick(), pick(), r.choice([None, 0, 1, 4])) for i in range(60)]
    return rows + [(None, "r", 90, 1, 1, 1), ("p", None, 91, 1, 1, 1), ("alone", "r", 92, 1, 1, 1)]


def groups(rows):
    out = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            out.setdefault(r[:2], []).append(r)
    return {k: v for k, v in out.items() if len(v) >= 2}


def test_best_of_every_bundle(spark):
    rows = data(1)
    got = {r["group_id"]: (r["x_from"], r["v_from"], r["t_from"]) for r in best_bundles(frame(spark, rows), [F.col("a"), F.col("b")], F.col("id"), bundles()).collect()}
    want = {}
    for g in groups(rows).values():
        best = lambda k, low: min(((-r[k], r[2]) for r in g if r[k] is not None and r[k] >= low), default=(0, -1))[1]  # noqa: B023, E731
        want[min(r[2] for r in g)] = (best(3, 0), best(4, 1), best(5, 0))
    assert got == want


def test_dependency_is_met_at_the_largest_trust(spark):
    for seed in range(3):
        rows = data(seed)
        got = {r["group_id"]: (r["v_from"], r["t_from"]) for r in consistent_bundles(frame(spark, rows), [F.col("a"), F.col("b")], F.col("id"), bundles(), "v", F.col("v"), "t").collect()}
        want = {}
        for g in groups(rows).values():
            branch = []
            for v in {r[4] for r in g if r[4] is not None and r[4] >= 1}:
                own = min(r[2] for r in g if r[4] == v)
                dep = min(((-r[5], r[2]) for r in g if r[4] == v and r[5] is not None), default=(0, -1))
                branch.append((v - dep[0], v, own, dep[1]))
            want[min(r[2] for r in g)] = max(branch)[2:] if branch else (-1, min(((-r[5], r[2]) for r in g if r[5] is not None), default=(0, -1))[1])
        assert got == want


def test_empty_and_repeated(spark):
    assert best_bundles(frame(spark, []), [F.col("a"), F.col("b")], F.col("id"), bundles()).count() == 0
    got = best_bundles(frame(spark, [("p", "r", 5, 1, 1, 1)] * 2), [F.col("a"), F.col("b")], F.col("id"), bundles()).collect()
    assert [(r["group_id"], r["x_from"]) for r in got] == [(5, 5)]


def test_branches_are_cut(spark):
    # p: the root takes version 9 and the text of version 5, which do not agree; 8 and 5 may be better, 1 cannot.
    rows = [("p", "r", 1, 1, 9, 1), ("p", "r", 2, 1, 8, 3), ("p", "r", 3, 1, 5, 6), ("p", "r", 4, 1, 1, 2), ("q", "r", 5, 1, 4, 7), ("q", "r", 6, 1, 3, 2), ("s", "r", 7, 1, None, 2), ("s", "r", 8, 1, None, 1)]
    args = (frame(spark, rows), [F.col("a"), F.col("b")], F.col("id"), bundles(), "v", F.col("v"), "t")
    assert tuple(search_effort(*args).first()) == (3, 2, 6, 4)
    got = {r["group_id"]: (r["v_from"], r["t_from"]) for r in consistent_bundles(*args).collect()}
    assert got == {1: (2, 2), 5: (5, 5), 7: (-1, 7)}

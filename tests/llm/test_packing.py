from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitweave.llm.packing import nnls, pack, plan


def check(histogram, capacity):
    runs, bins = plan(dict(histogram), capacity)
    fill, ranks = Counter(), defaultdict(list)
    for r in runs:
        ranks[r.length].append((r.first, r.first + r.n))
        for i in range(r.n):
            fill[r.container + i // r.each] += r.length
    for length, n in histogram.items():
        if n:
            at = sorted(ranks[length])
            assert at[0][0] == 0 and at[-1][1] == n and all(a[1] == b[0] for a, b in zip(at, at[1:]))
    assert set(fill) == set(range(bins)) and max(fill.values(), default=0) <= capacity
    return runs, bins


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 50), max_size=40))))
def test_every_item_has_one_place(case):
    check(case[1], case[0])


def test_little_room_is_left_and_the_plan_is_small():
    r = np.random.default_rng(1)
    for capacity in (128, 512, 2048):
        lengths = np.clip(r.lognormal(4.5, 1, 20_000).astype(int), 1, capacity)
        runs, bins = check(Counter(lengths.tolist()), capacity)
        assert lengths.sum() / (bins * capacity) > 0.97
        more, _ = check({k: 50 * v for k, v in Counter(lengths.tolist()).items()}, capacity)
        assert len(more) < 3 * len(runs) + 1000


def test_nnls_against_projection():
    r = np.random.default_rng(2)
    a, b = r.random((12, 30)), r.random(12)
    x = nnls(a, b)
    grad = a.T @ (a @ x - b)
    assert (x >= 0).all() and grad.min() > -1e-6 and abs(grad[x > 0]).max() < 1e-6


def test_nothing_to_pack():
    assert plan({}, 10) == ([], 0)


def test_rows(spark):
    rows = [(1, 5), (2, 25), (3, 0), (4, None), (5, 10), (5, 10), (6, -3), (7, 3), (None, 2)]
    sizes = spark.createDataFrame(rows, "id int, size int").withColumnRenamed("id", "bin")
    kinds = spark.createDataFrame([("small", 10), ("none", None), ("zero", 0), ("large", 40)], "kind string, capacity int")
    got = pack(sizes, "bin", "size", kinds, "kind", "capacity").toDF("container", "at", "id", "piece", "start", "tokens").collect()
    for kind, cap in (("small", 10), ("large", 40)):
        own = [r for r in got if r["container"] == kind]
        fill = Counter()
        for r in own:
            fill[r["at"]] += r["tokens"]
        assert max(fill.values()) <= cap and {r["container"] for r in got} == {"small", "large"}
        by = defaultdict(list)
        for r in own:
            by[r["id"]].append((r["start"], r["tokens"]))
        assert sorted(by[2]) == ([(0, 10), (10, 10), (20, 5)] if cap == 10 else [(0, 25)])
        assert sum(t for _, t in by[5]) == 20 and by[3] == by[4] == by[6] == [(0, 0)] and by[None] == [(0, 2)]


def test_empty_table(spark):
    kinds = spark.createDataFrame([("small", 10)], "kind string, capacity int")
    assert pack(spark.createDataFrame([], "id int, size long"), "id", "size", kinds, "kind", "capacity").count() == 0


@pytest.mark.parametrize("n", [1, 300])
def test_one_hot_length(spark, n, monkeypatch):
    import bitweave.llm.packing as p

    monkeypatch.setattr(p, "PER_SALT", 20)
    sizes = spark.range(n).selectExpr("id", "7L size")
    kinds = spark.createDataFrame([("k", 20)], "kind string, capacity int")
    got = pack(sizes, "id", "size", kinds, "kind", "capacity").collect()
    per = Counter(r["bin"] for r in got)
    assert len(got) == n and len({r["id"] for r in got}) == n and max(per.values()) <= 2 and len(per) == -(-n // 2)

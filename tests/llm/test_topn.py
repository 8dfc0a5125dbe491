import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitweave.llm.topn import score_words, top_n_by_bisection

SCHEMA = "grp string, score double, id long, ident string, w0 int, need int, part int, rank int"


def run(spark, rows, n=3, bits=3):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    got = top_n_by_bisection(df, F.col("grp"), score_words(F.col("score")), F.col("id"), n, bits)
    return sorted(tuple(r) for r in got.collect())


def brute(rows, n=3):
    out, groups = [], {}
    for g, s, i in rows:
        if g is not None and s is not None and i is not None:
            groups.setdefault(g, []).append((-s, i))
    for g, items in groups.items():
        out += [(g, i) for _, i in sorted(items)[:n]]
    return sorted(out)


def test_hot_group_ties_and_tiny_scores(spark):
    r = random.Random(4)
    rows = [("hot", r.choice([1.0, 0.5, 0.25, r.random()]), i) for i in range(2000)] + [(f"g{i % 40}", r.random(), 5000 + i) for i in range(150)]
    rows += [("tiny", 1e-9 * k, 9000 + k) for k in range(10)] + [("tiny", 1e-9, 9100), ("zero", 0.0, 1), ("zero", -0.0, 2)]
    assert run(spark, rows) == brute(rows)


def test_all_scores_equal(spark):
    rows = [("a", 0.7, i) for i in range(500)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_nulls_and_empty(spark):
    rows = [(None, 0.5, 1), ("a", None, 2), ("a", 0.5, None), ("a", 0.1, 3)]
    assert run(spark, rows) == [("a", 3)] and run(spark, []) == []


def test_repeated_rows_fill_the_places_left(spark):
    rows = [("a", 0.9, 1)] + [("a", 0.5, 2)] * 6 + [("a", 0.1, 3)]
    assert run(spark, rows) == [("a", 1), ("a", 2), ("a", 2)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.floats(0, 1)), max_size=40))
def test_any_scores(spark, items):
    rows = [(g, s, i) for i, (g, s) in enumerate(items)]
    assert run(spark, rows) == brute(rows)

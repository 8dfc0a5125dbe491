"""Laws of the algebra, and the operators against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitweave.functions import contract as ct
from bitweave.functions import words as w
from bitweave.operators import memory as mm
from bitweave.operators.bundle import bundle

W = 32
D = 32 * W


def np_item(name, words=W):
    digits = "".join(hashlib.md5(f"{name.lower()}#{k}".encode()).hexdigest() for k in range((words + 3) // 4))
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(words)]


def bits(words):
    return np.array([(x >> j) & 1 for x in words for j in range(32)])


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_item_is_the_hash_and_ignores_case(spark):
    a, b, none = one(spark, w.item(F.lit("Ada"), W), w.item(F.lit("ADA"), W), w.item(F.lit(None).cast("string"), W))
    assert a == b == np_item("ada") and none is None


def test_bind_is_an_involution_and_keeps_distances(spark):
    x, y, k = (w.item(F.lit(n), W) for n in "xyk")
    back, d0, d1 = one(spark, w.bind(w.bind(x, k), k), w.hamming(x, y, W), w.hamming(w.bind(x, k), w.bind(y, k), W))
    assert back == np_item("x") and d0 == d1 == int((bits(np_item("x")) != bits(np_item("y"))).sum())


@pytest.mark.parametrize("k", [0, 1, 31, 32, 33, 64, D - 1, D])
def test_rho_rolls_the_bits(spark, k):
    (got,) = one(spark, w.rho(w.item(F.lit("x"), W), k, W))
    assert (bits(got) == np.roll(bits(np_item("x")), k)).all()


def test_rho_distributes_over_bind(spark):
    x, y = w.item(F.lit("x"), W), w.item(F.lit("y"), W)
    a, b = one(spark, w.rho(w.bind(x, y), 1, W), w.bind(w.rho(x, 1, W), w.rho(y, 1, W)))
    assert a == b


def test_pack_unpack_round_trip(spark):
    x = w.item(F.lit("x"), 2)
    a, b = one(spark, x, w.pack(w.unpack(x), 2))
    assert a == b


def test_long_states_use_the_general_form(spark):
    x, y = w.item(F.lit("x"), 40), w.item(F.lit("y"), 40)
    (d,) = one(spark, w.hamming(x, y, 40))
    assert d == int((bits(np_item("x", 40)) != bits(np_item("y", 40))).sum())


@pytest.mark.parametrize("tie", ["item", "plus", "minus"])
def test_bundle_is_the_weighted_majority(spark, tie):
    rows = [("g", np_item(f"n{i}"), n) for i, n in enumerate([1, 2, 1, 3, 1])] + [("h", np_item("a"), 1), ("h", np_item("b"), 1), ("h", None, 5), ("h", np_item("c"), None)]
    df = spark.createDataFrame(rows, "k string, state array<bigint>, n int")
    got = {r["k"]: r for r in bundle(df, ["k"], "state", W, F.col("n"), tie).collect()}
    for k in "gh":
        own = [(bits(s), n) for key, s, n in rows if key == k and s is not None and n is not None]
        total = sum(n * (1 - 2 * b) for b, n in own)
        tied = {"item": bits(np_item("__tie__")), "plus": np.zeros(D, int), "minus": np.ones(D, int)}[tie]
        want = np.where(total < 0, 1, np.where(total == 0, tied, 0))
        assert got[k]["n"] == sum(n for _, n in own) and (bits(got[k]["trace"]) == want).all()


def test_bundle_of_nothing_is_nothing(spark):
    assert bundle(spark.createDataFrame([], "k string, state array<bigint>"), ["k"], "state", W).count() == 0


def memory(spark, rows):
    return spark.createDataFrame([(0, i, s, r, o, 1) for i, (s, r, o) in enumerate(rows)], "mem int, ord long, s string, r string, o string, n long")


def test_accuracy_follows_the_contract(spark):
    n = 60
    facts = memory(spark, [(f"s{i}", f"r{i % 11}", f"o{i}") for i in range(n)])
    answers = mm.query(facts, facts.select("mem", "s", "r").distinct(), W)
    hits = answers.join(facts.select("mem", "s", "r", F.col("o").alias("answer")), ["mem", "s", "r", "answer"]).count()
    (want,) = one(spark, ct.predicted_accuracy(F.lit(float(n)), F.lit(float(D)), F.lit(2.0 * n + 11)))
    assert abs(hits / n - want) < 0.15


def test_membership(spark):
    facts = memory(spark, [(f"s{i}", "is", f"o{i}") for i in range(20)])
    asked = facts.select("mem", "s", "r", "o").union(spark.createDataFrame([(0, f"s{i}", "is", f"o{i + 1}") for i in range(19)], "mem int, s string, r string, o string"))
    got = {(r["s"], r["o"]): r["found"] for r in mm.member(facts, asked, W).collect()}
    assert sum(got[f"s{i}", f"o{i}"] for i in range(20)) >= 19 and sum(got[f"s{i}", f"o{i + 1}"] for i in range(19)) <= 2


def test_compiled_pairs_beat_hops(spark):
    n = 40
    facts = memory(spark, [x for i in range(n) for x in ((f"x{i}", "r1", f"y{i}"), (f"y{i}", "r2", f"z{i}"))])
    starts = spark.createDataFrame([(0, str(i), f"x{i}", ["r1", "r2"]) for i in range(n)], "mem int, id string, start string, rels array<string>")
    hops = sum(r["node"] == f"z{r['id']}" for r in mm.chain(facts, starts, 2, W).collect())
    pairs = mm.compose(facts, W)
    noisy = pairs.join(bundle(pairs, ["mem"], "state", W), "mem").select("mem", "s", "r1", "r2", w.bind(F.col("trace"), mm.composed_key(F.col("s"), F.col("r1"), F.col("r2"), W)).alias("noisy"))
    compiled = sum(r["answer"] == f"z{r['s'][1:]}" for r in mm.nearest(noisy, mm.codebook(facts), ["s", "r1", "r2"], W).collect())
    assert compiled > hops + 0.2 * n


def test_cleanup_prefers_the_first_of_equal_names(spark):
    facts = memory(spark, [("Ada", "knows", "Bob"), ("ada", "likes", "tea")])
    got = mm.nearest(spark.createDataFrame([(0, 1, np_item("ADA"))], "mem int, id int, noisy array<bigint>"), mm.codebook(facts), ["id"], W).first()
    assert (got["answer"], got["dist"]) == ("Ada", 0)


def test_erf_and_recommended_dimension(spark):
    got = one(spark, *[ct.erf(F.lit(x)) for x in (-2.0, -0.3, 0.0, 0.7, 3.0)])
    assert all(abs(a - math.erf(x)) < 2e-7 for a, x in zip(got, (-2.0, -0.3, 0.0, 0.7, 3.0)))
    (dim,) = one(spark, ct.recommended_dim(F.lit(100.0), F.lit(200.0), 1024))
    zg = math.sqrt(2 * math.log(200)) - (math.log(math.log(200)) + math.log(4 * math.pi)) / (2 * math.sqrt(2 * math.log(200)))
    want = 1024
    while 100 > 0.5 * 0.92 * 2 * want / (math.pi * zg**2):
        want *= 2
    assert dim == want

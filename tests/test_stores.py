"""Search, clustering, fusion and edges against brute force."""

import random

from pyspark.sql import functions as F

from bitweave.functions import text as tx
from bitweave.operators import cluster, edges, fuse, store


def states(n, seed=1):
    r = random.Random(seed)
    base = [r.getrandbits(32) for _ in range(n // 4 + 1)]
    return [(i, [base[i // 4] ^ (1 << r.randrange(32)), 7]) for i in range(n)]


def dist(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def test_knn_is_exact_with_ties_by_id(spark):
    rows = states(60)
    e = spark.createDataFrame(rows, "id long, words array<bigint>")
    got = {}
    for r in store.knn(e, e.where("id % 20 = 0"), "id", "words", 5, 2).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["dist"], r["id"]))
    for q in (0, 20, 40):
        want = sorted((dist(rows[q][1], s), i) for i, s in rows if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]


def test_knn_in_blocks_finds_the_same(spark, monkeypatch):
    e = spark.createDataFrame(states(40), "id long, words array<bigint>")
    whole = sorted(map(tuple, store.knn(e, e, "id", "words", 3, 2).collect()))
    monkeypatch.setattr(store, "BLOCK", 7)
    assert sorted(map(tuple, store.knn(e, e, "id", "words", 3, 2).collect())) == whole


def test_knn_of_an_empty_store(spark):
    e = spark.createDataFrame([], "id long, words array<bigint>")
    assert store.knn(e, e, "id", "words", 3, 2).count() == 0


def test_lsh_candidates_are_those_of_the_probed_buckets(spark):
    e = spark.createDataFrame(states(80), "id long, words array<bigint>")
    bucket = {r["id"]: r["b"] for r in e.select("id", store.lsh_bucket(F.col("words"), 6, 2).alias("b")).collect()}
    got = {(r["q"], r["id"]) for r in store.lsh_candidates(e, e.where("id < 10"), "id", "words", 6, 2).collect()}
    assert got == {(q, i) for q in range(10) for i in bucket if i != q and (bucket[q] ^ bucket[i]).bit_count() <= 1}


def test_leaders_match_the_pass_in_order(spark):
    rows = states(50, 3)
    got = {r["id"]: r["leader"] for r in cluster.leaders(spark.createDataFrame(rows, "id long, words array<bigint>"), "id", "words", 8, 2).collect()}
    want, lead = {}, []
    for i, s in rows:
        want[i] = next((j for j in lead if dist(s, rows[j][1]) <= 8), i)
        if want[i] == i:
            lead.append(i)
    assert got == want


def test_routing_without_routes(spark):
    e = spark.createDataFrame(states(3), "id long, words array<bigint>")
    routes = spark.createDataFrame([], "name string, proto array<bigint>")
    assert {(r["route"], r["dist"]) for r in cluster.route(e, routes, "name", "id", "words", 2).collect()} == {("_none_", -1)}


def test_fusion_and_prefix_pruning(spark):
    ranked = spark.createDataFrame([(1, "a", "x", 1, 1.0), (1, "a", "y", 2, 1.0), (1, "b", "y", 1, 1.0)], "q int, encoder string, doc string, rank int, weight double")
    got = {r["doc"]: r["score"] for r in fuse.fuse(ranked, "doc", 5, 256).collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-9 and abs(got["x"] - 1 / 61) < 1e-9
    chunks = spark.createDataFrame([(1, i, float(i), t) for i, t in enumerate([300, 400, 200, 10])], "q int, id int, score double, t int")
    assert [r["id"] for r in fuse.prune(chunks, "id", "t", 5, 768).orderBy("id").collect()] == [0, 1]


def test_merge_is_the_greedy_pass(spark):
    rows = [("s", "big red house", 0), ("s", "red house", 1), ("s", "house boat", 2), ("s", "boat house red", 3), ("t", "red house", 4)]
    e = spark.createDataFrame([(s, t, 2, 1, 1, 0.3 + i / 10, i) for s, t, i in rows], "source string, target string, support long, success long, failure long, confidence double, first long")
    e = e.withColumn("last_seen", F.lit("2026-01-01").cast("timestamp"))
    got = {r["first"]: (r["merged"], r["support"]) for r in edges.merge(e).collect()}
    # 0 takes 1 (2/3) and 3 (2/4), 2 stays (1/4 with 0), 4 has another source; the most confident of a group stays.
    assert got == {3: (3, 6), 2: (1, 2), 4: (1, 2)}


def test_text_functions(spark):
    row = spark.createDataFrame([("Who founded the company that makes the iPhone?", "Apple Inc. was founded by Steve Jobs in 1976. It rests.")], "q string, t string")
    got = row.select(
        tx.plan_question(F.col("q")).alias("p"), tx.query_entity(F.col("q")).alias("e"), tx.extract_triples(tx.sentences(F.col("t"))[0]).alias("x"), F.size(tx.sentences(F.col("t"))).alias("n"),
    ).first()
    assert got["p"]["anchor"] == "iphone" and got["p"]["chain"] == ["made_by", "founded_by"] and got["e"] == "iPhone" and got["n"] == 2
    assert tuple(got["x"][0]) == ("apple inc", "founded_by", "steve jobs")

"""Containers, files, kernels, statistics and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitweave.functions import words as w
from bitweave.operators import kernels, stats
from bitweave.sources import container, files
from bitweave.streaming import observe


def test_container_round_trip(spark, tmp_path):
    sections = [("rows", "u64", [2, 3], b"\x01" * 48), ("name é", "str", [], "text".encode()), ("empty", "raw", [0], b"")]
    (tmp_path / "a.bin").write_bytes(container.build({"vocab": 7, "é": "x"}, sections))
    (tmp_path / "b.bin").write_bytes(b"something else that is long enough to be read")
    (tmp_path / "c.bin").write_bytes(b"short")
    got = container.read(spark, str(tmp_path)).collect()
    ok = {r["name"]: (r["kind"], r["shape"], bytes(r["data"])) for r in got if r["error"] is None}
    assert ok == {n: (k, s, d) for n, k, s, d in sections} and json.loads(got[0]["header"] or "{}") in ({"vocab": 7, "é": "x"}, {})
    assert sorted(r["error"] for r in got if r["error"]) == ["not a container", "too short: 5 bytes"]


def test_validation_sees_one_flipped_bit(spark, tmp_path):
    blob = bytearray(container.build({}, [("a", "u8", [4], b"abcd")]))
    (tmp_path / "good.bin").write_bytes(blob)
    blob[40] ^= 1
    (tmp_path / "bad.bin").write_bytes(blob)
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in container.validate(spark, str(tmp_path)).collect()}
    assert got == {"good.bin": True, "bad.bin": False}


def test_damaged_tables_are_errors():
    blob = bytearray(container.build({}, [("a", "u8", [4], b"abcd")]))
    blob[512 + 4 + 8] = 255
    blob[512 + 4 + 9] = 255
    with pytest.raises(ValueError):
        container.parse(bytes(blob))


def test_triples_are_checked(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([["a", "r", "b"], ["a", "r"], ["a", "r", "x" * 300]]))
    read = files.read_triples(spark, str(tmp_path), 200)
    assert [r["valid"] for r in read.orderBy("pos").collect()] == [True, False, False]
    with pytest.raises(ValueError, match="2 entries.*position 1"):
        files.check_triples(read)
    assert files.check_triples(read.where("valid")).count() == 1


def test_vocabulary_and_stories(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"the": 4, "é": 5}))
    assert {(r["token"], r["id"]) for r in files.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("the", 4), ("é", 5)}
    files.write_stories(spark.createDataFrame([("one\ntwo",), ("three",)], "t string"), "t", str(tmp_path / "s"))
    assert {r["text"].strip("\n") for r in files.read_stories(spark, str(tmp_path / "s")).collect()} >= {"three"}


def test_moments_give_the_participation_ratio(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) @ np.random.default_rng(2).normal(size=(6, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0],)], "v array<double>")
    values = np.linalg.eigvalsh(np.cov(x.T))
    got = stats.participation_ratio(stats.moments(df, "v", 6)).first()["ratio"]
    assert abs(got - values.sum() ** 2 / (values**2).sum()) < 1e-6


def test_gini_forms_differ_by_one_over_n(spark):
    r = random.Random(1)
    v = [float(r.choice([0, 1, 2, 5, 9])) for _ in range(50)]
    got = stats.gini(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()
    s = np.sort(v)
    assert abs(got["metric"] - (1 - 2 * np.cumsum(s).sum() / (50 * s.sum()))) < 1e-9 and abs(got["standard"] - got["metric"] - 1 / 50) < 1e-9


def test_mutual_information(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 8
    n, p = len(rows), lambda f: sum(map(f, rows)) / len(rows)
    want = sum(p(lambda r, x=x, y=y: r == (x, y)) * np.log2(p(lambda r, x=x, y=y: r == (x, y)) / (p(lambda r, x=x: r[0] == x) * p(lambda r, y=y: r[1] == y))) for x in (0, 1) for y in (0, 1))
    mi = stats.mutual_information(F.lit(8.0), F.lit(10.0), F.lit(9.0), F.lit(float(n)))
    assert abs(spark.range(1).select(mi.alias("m")).first()["m"] - want) < 1e-9


def test_tree_walk(spark):
    r = random.Random(5)
    word = lambda: [r.getrandbits(32)]
    nodes, states = [(i, word()) for i in range(7)], [(i, word()) for i in range(20)]
    got = {x["id"]: x["leaf"] for x in kernels.tree_greedy(spark.createDataFrame(states, "id long, words array<bigint>"), spark.createDataFrame(nodes, "node long, words array<bigint>"), "id", 3, 1).collect()}
    for i, s in states:
        at = 0
        for _ in range(3):
            at = 2 * at + (2 if 32 - 2 * (s[0] ^ nodes[at][1][0]).bit_count() > 0 else 1)
        assert got[i] == at - 7


def test_layer_majority(spark):
    # With all-ones weight rows the products are the sign of the ones, so a full input drives the state to full.
    full = [[0xFFFFFFFF] for _ in range(32)]
    df = spark.createDataFrame([(1, [[0xFFFFFFFF]] * 3), (2, None), (3, [])], "id int, xs array<array<bigint>>")
    got = {r["id"]: r["y"] for r in df.select("id", kernels.run_layer(F.col("xs"), full, full, full).alias("y")).collect()}
    assert got == {1: [0xFFFFFFFF], 2: None, 3: None}


def test_horn_chaining_stops_at_the_fixpoint(spark):
    facts = spark.createDataFrame([(0, "anne", "kind"), (0, "bob", "big"), (1, "anne", "kind")], "mem int, entity string, attribute string")
    rules = spark.createDataFrame([(0, 1, "kind", "nice"), (0, 2, "nice", "rich"), (0, 2, "kind", "rich"), (0, 3, "big", "green"), (0, 3, "rich", "green")], "mem int, rule int, premise string, conclusion string")
    got = {tuple(r) for r in kernels.forward_chain(facts, rules).collect()}
    assert got - {tuple(r) for r in facts.collect()} == {(0, "anne", "nice"), (0, "anne", "rich")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i % 2 == 0, f"2026-01-01 00:00:{i:02}") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, ok boolean, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = observe.edge_confidence(stream, ["k"], "ok", "ts")
    made.writeStream.format("memory").queryName("edge_hits").outputMode("complete").option("checkpointLocation", str(tmp_path / "log")).start().processAllAvailable()
    want = observe.edge_confidence(df, ["k"], "ok", "ts")
    assert sorted(map(tuple, spark.table("edge_hits").collect())) == sorted(map(tuple, want.collect()))
    for q in spark.streams.active:
        q.stop()


def test_windows_on_batches(spark):
    df = spark.createDataFrame([(1, True, "2026-01-01 00:00:10"), (1, None, "2026-01-01 00:00:50"), (1, False, "2026-01-01 00:02:00")], "k int, ok boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["span"]["start"].minute, r["support"], r["success"]) for r in observe.windowed_hits(df, ["k"], "ok", "ts", "1 minute", "1 minute").collect())
    assert got == [(0, 2, 1), (2, 1, 0)]


def test_xor_machine_is_the_fold(spark):
    xs = [[1, 2], [3, 4]]
    got = spark.createDataFrame([(xs,)], "xs array<array<bigint>>").select(kernels.xor_machine(F.col("xs"), 2).alias("s")).first()["s"]
    a = spark.range(1).select(w.bind(w.rho(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), 1, 2), F.array(F.lit(3).cast("bigint"), F.lit(4).cast("bigint"))).alias("s")).first()["s"]
    assert got == a


@pytest.mark.parametrize("folder", [False, True])
def test_edge_hits_of_a_file_and_of_a_folder(spark, tmp_path, folder):
    from bitweave import catalog
    from bitweave import queries as _core  # noqa: F401

    df = spark.createDataFrame([(1, "purchase"), (1, "view"), (2, None), (2, "purchase"), (None, "view")], "user_id bigint, event_type string").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "all"))
    (tmp_path / "all").rename(tmp_path / "events.parquet") if folder else next((tmp_path / "all").glob("part-*")).rename(tmp_path / "events.parquet")
    df.limit(1).write.parquet(str(tmp_path / "facts.parquet"))
    got = catalog.queries()["ST1_edge_hits_stream"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, 0.5), (2, 2, 1, 0.5), (None, 1, 0, 0.333333)}

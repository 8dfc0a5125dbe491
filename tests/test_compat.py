import hashlib
import io

import numpy as np
from pyspark.sql import functions as F

from bitweave.functions import compat


def unpacked(words):
    return np.array([(x >> j) & 1 for x in words for j in range(32)])


def test_twister_states_have_the_generators_bits(spark):
    df = spark.createDataFrame([("Ada",), ("ADA",), (None,)], "n string").select(compat.twister_item(F.col("n"), 4).alias("w"))
    a, b, none = [r["w"] for r in df.collect()]
    seed = int.from_bytes(hashlib.md5(b"ada").digest()[:4], "little")
    values = np.where(np.random.RandomState(seed).rand(128) > 0.5, 1, -1)
    assert a == b and none is None and (1 - 2 * unpacked(a) == values).all()


def test_gaussian_states(spark):
    x = np.random.default_rng(1).normal(size=(5, 6)).astype(np.float32)
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0],)], "v array<float>")
    got = [r["w"] for r in df.select(compat.gaussian_state(F.col("v"), 6, 1).alias("w")).collect()]
    want = x @ np.random.RandomState(42).randn(6, 32).astype(np.float32) >= 0
    assert got[5:] == [None, None] and all((unpacked(g) == w).all() for g, w in zip(got, want))


def test_json_objects(spark):
    text = 'x {"anchor": "a", "c": {"anchor": 1}} {broken {"anchor": "b"} {"other": 1} {"anchor": "{"} {"anchor"'
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r["o"] for r in df.select(compat.json_objects(F.col("t"), "anchor").alias("o")).collect()]
    assert got == [['{"anchor": "a", "c": {"anchor": 1}}', '{"anchor": "b"}', '{"anchor": "{"}'], [], []]


def test_npy(spark):
    f = io.BytesIO()
    np.save(f, np.arange(6).reshape(2, 3))
    df = spark.createDataFrame([(bytearray(f.getvalue()),), (bytearray(b"no"),), (None,)], "b binary")
    assert [r["v"] for r in df.select(compat.npy_values(F.col("b")).alias("v")).collect()] == [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None, None]

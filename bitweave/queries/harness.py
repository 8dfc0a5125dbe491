"""Stores and trees to files and back, trees over states, variants of search and the suites that measure them (S, B, I, K, H rows)."""

from __future__ import annotations

import io
import struct
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from bitweave.catalog import oracle_sql, query
from bitweave.functions import compat
from bitweave.functions import words as w
from bitweave.operators import kernels as kn
from bitweave.operators import stats
from bitweave.operators import store as st
from bitweave.operators.bundle import bundle
from bitweave.operators.encoders import Encoders
from bitweave.queries import analysis, models, stores, texts
from bitweave.queries import oracle as q
from bitweave.queries.algebra import facts
from bitweave.session import stored, table
from bitweave.sources import files

W, D = stores.W, stores.D
_E = stores._E


@query("S7_engine_store", f"WITH {_E}, {stores._DIRS} SELECT vec_id, label, bucket FROM bk")
def s7(spark, d):
    """The bucketed memory saved and loaded: buckets are not stored, they follow from the states again."""
    path = models._place(spark, "engine")
    files.save_store(stores.entries(spark, d), path)
    return files.load_store(spark, path).select("vec_id", "label", st.lsh_bucket(F.col("words"), 12, W).alias("bucket"))


def tree_nodes(spark, levels: int = 4):
    return spark.range((1 << levels) - 1).select(F.col("id").alias("node"), w.item(F.concat(F.lit("node"), F.col("id").cast("string")), W).alias("words"))


@F.pandas_udf(BinaryType())
def tree_bytes(words: pd.Series) -> pd.Series:
    """Nodes in heap order (arrays of words) as bytes: their number, the words of a node, then the words."""
    return pd.Series([struct.pack(f"<II{sum(len(x) for x in t)}I", len(t), len(t[0]) if len(t) else 0, *[v for x in t for v in x]) for t in words])


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def tree_from_bytes(blobs: pd.Series) -> pd.Series:
    """The words of every node; null for bytes that are cut off."""
    out = []
    for b in blobs:
        if b is None or len(b) < 8 or len(b) != 8 + 4 * (c := struct.unpack_from("<II", b))[0] * c[1]:
            out.append(None)
        else:
            out.append(np.frombuffer(b, "<u4", offset=8).reshape(c).astype(np.int64).tolist())
    return pd.Series(out)


@query("S13_tree_bytes", f"SELECT n::INT AS node, {q.item(chr(39) + 'node' + chr(39) + ' || n', 2)} AS words FROM range(15) r(n)")
def s13(spark, d):
    """A tree head as bytes and back."""
    tree = tree_nodes(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "words"))), lambda x: x["words"]).alias("t"))  # one tree
    return tree.select(tree_bytes("t").alias("b")).select(F.posexplode(tree_from_bytes("b")).alias("node", "words"))


@query("S12_container_with_tree", f"WITH {_E} SELECT label, count(*) AS entries, 15 AS nodes, TRUE AS valid FROM e WHERE label IS NOT NULL GROUP BY label")
def s12(spark, d):
    """Containers with the states of a label and the bytes of a tree, read back: entries and nodes of the sections."""
    from bitweave.sources import container

    tree = tree_nodes(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "words"))), lambda x: x["words"]).alias("t")).select(tree_bytes("t")).first()[0]
    held = models.containers(spark, d, [("tree", "raw", [len(tree)], bytes(tree))])
    got = container.sections(held).withColumn("label", F.get_json_object("header", "$.label").cast("int"))
    nodes = F.max(F.when(F.col("name") == "tree", F.size(tree_from_bytes("data"))))
    counted = got.groupBy("label").agg(F.sum(F.when(F.col("name") == "ids", F.col("shape")[0])).alias("entries"), nodes.alias("nodes"))
    ok = container.checked(held).select(F.get_json_object("header", "$.label").cast("int").alias("label"), "valid").groupBy("label").agg(F.bool_and("valid").alias("valid"))
    return counted.join(ok, "label")


@query("S14_npy_signs", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1 ELSE 0 END) AS signs FROM embeddings WHERE embedding IS NOT NULL")
def s14(spark, d):
    """Arrays exported in the .npy format and loaded as signs."""
    @F.pandas_udf("binary")
    def npy(arrays: pd.Series) -> pd.Series:
        def one(a) -> bytes:
            out = io.BytesIO()
            np.save(out, np.asarray(a, dtype=np.float32))
            return out.getvalue()

        return arrays.map(one)

    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", npy("embedding").alias("content"))
    return e.select("vec_id", F.transform(compat.npy_values(F.col("content")), lambda x: F.signum(x).cast("int")).alias("signs"))


@query("K11_latency")
def k11(spark, d):
    """Microseconds of single searches (5 nearest) by one process over a block of up to 20,000 entries."""
    held = stores.entries(spark, d)
    if held.count() > st.BLOCK:
        held = held.orderBy("vec_id").limit(st.BLOCK)
    block = np.array([r[0] for r in held.select("words").collect()], dtype=np.uint64)
    sent = spark.sparkContext.broadcast(block)

    @F.pandas_udf("double")
    def micros(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = sent.value
        for batch in batches:
            took = []
            for x in batch:
                began = time.perf_counter()
                dist = np.bitwise_count(keys ^ np.array(x, dtype=np.uint64)).sum(axis=1)
                np.argpartition(dist, min(5, len(dist) - 1))
                took.append((time.perf_counter() - began) * 1e6)
            yield pd.Series(took)

    t = stored(stored(stores.asked(stores.entries(spark, d)), "asked").select(micros("words").alias("us")), "latency")
    pct = lambda p: F.round(F.percentile_approx("us", p), 1)
    return t.agg(F.count("*").alias("queries"), F.round(F.avg("us"), 1).alias("mean"), pct(0.5).alias("median"), pct(0.99).alias("p99"), F.round(F.min("us"), 1).alias("least"), F.round(F.max("us"), 1).alias("most"))


@query("H15_float_index", f"WITH {_E}, nn AS (SELECT q, vec_id FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {q.ham('a.words', 'b.words', 2)}, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank = 1), fl AS (SELECT q, vec_id FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(range(64), lambda i: (a.embedding[i + 1]::DOUBLE - b.embedding[i + 1]::DOUBLE) * (a.embedding[i + 1]::DOUBLE - b.embedding[i + 1]::DOUBLE))), 6), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL) WHERE rank = 1) SELECT count(*) AS queries, round(avg((nn.vec_id = fl.vec_id)::INT), 6) AS recall_at_1 FROM nn JOIN fl USING (q)")
def h15(spark, d):
    """Recall@1 of the binary store against an exact float index over the same vectors."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = []
    for block in st.blocks(e.where("vec_id % 20 = 0"), "vec_id"):
        asked = F.broadcast(block.select(F.col("vec_id").alias("q"), F.col("v").alias("_v")))
        dist = F.round(F.aggregate(F.zip_with("v", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
        found.append(e.join(asked, F.col("q") != F.col("vec_id")).select("q", dist.alias("dist"), "vec_id").groupBy("q").agg(F.min(F.struct("dist", "vec_id"))["vec_id"].alias("v")))
    exact = found[0]
    for f in found[1:]:
        exact = exact.unionByName(f)
    near = stores.k1(spark, d).where("rank = 1").select("q", "vec_id")
    both = near.join(exact, "q")
    return both.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("vec_id") == F.col("v")).cast("int")), 6).alias("recall_at_1"))


@query("H18_flat_memory", f"WITH {_E}, {stores._NN} SELECT q, vec_id, label, dist FROM nn WHERE rank <= 3")
def h18(spark, d):
    """The flat memory: the three nearest entries with their payloads."""
    e = stores.entries(spark, d)
    return st.knn(e, stores.asked(e), "vec_id", "words", 3, W, ["label"]).select("q", "vec_id", "label", "dist")


@query("H17_capped_buckets", f"WITH {_E}, {stores._DIRS} SELECT vec_id, bucket FROM (SELECT vec_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY vec_id DESC) AS n FROM bk) WHERE n <= 2")
def h17(spark, d):
    """The variant of the bucketed memory with a capacity per bucket: the two newest entries stay. The limit is
    the feature; tasks keep two rows per bucket before anything is shuffled."""
    newest = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("vec_id")))
    return stores.l1(spark, d).withColumn("n", newest).where("n <= 2").select("vec_id", "bucket")


@query("L3_recall_rate")
def l3_rate(spark, d):
    """Recall@8 of bucketed search against exact search, and the share of entries it compares, for numbers of
    bits and of flipped bits. Signs of unlike vectors have near neighbours far apart, so the finer the buckets,
    the less they find; the last row is the setting with a recall of 0.9."""
    e = stored(stores.entries(spark, d), "entries")
    exact = stored(st.knn(e, stores.asked(e), "vec_id", "words", 8, W).select("q", "vec_id"), "exact")
    n, asked = e.count(), stores.asked(e).count()
    out = None
    for bits, flips in ((12, 1), (8, 2), (6, 3), (4, 3)):
        got = st.lsh_candidates(e, stores.asked(e), "vec_id", "words", bits, W, flips).select("q", "vec_id", F.lit(1).alias("met"))
        row = exact.join(got, ["q", "vec_id"], "left").agg(F.round(F.count("met") / F.count("*"), 4).alias("recall")).join(got.agg(F.round(F.count("*") / F.lit(n * asked), 4).alias("compared")))
        row = row.select(F.lit(bits).alias("bits"), F.lit(flips).alias("flips"), "recall", "compared")
        out = row if out is None else out.unionByName(row)
    return out


_BANK = "CASE WHEN {k} = 0 THEN bit_count(xor(a.words[1], b.words[1]) & 65535) WHEN {k} = 1 THEN bit_count(xor(a.words[1], b.words[1]) >> 16) WHEN {k} = 2 THEN bit_count(xor(a.words[2], b.words[2]) & 65535) ELSE bit_count(xor(a.words[2], b.words[2]) >> 16) END"


@query("H21_bank_importance", f"WITH {_E}, p AS (SELECT a.vec_id AS q, a.label AS own, b.vec_id, b.label, unnest(range(4)) AS bank, a.words AS aw, b.words AS bw FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT bank, own, label, row_number() OVER (PARTITION BY bank, q ORDER BY {_BANK.format(k='bank').replace('a.words', 'aw').replace('b.words', 'bw')}, vec_id) AS n FROM p) SELECT bank::INT AS bank, count(*) AS queries, round(avg((own = label)::INT), 6) AS agreement FROM r WHERE n = 1 AND own IS NOT NULL AND label IS NOT NULL GROUP BY bank")
def h21(spark, d):
    """How well each bank of 16 bits retrieves alone: agreement of the nearest entry's label."""
    e = stores.entries(spark, d)
    own = e.select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    out = None
    for bank in range(4):
        mask = [0, 0]
        mask[bank // 2] = 0xFFFF << (16 * (bank % 2))
        masked = e.select("vec_id", "label", w.both(F.col("words"), F.array(*[F.lit(m).cast("bigint") for m in mask])).alias("words"))
        near = st.knn(masked, stores.asked(masked), "vec_id", "words", 1, W, ["label"]).join(own, "q").where("own is not null and label is not null")
        row = near.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("own") == F.col("label")).cast("int")), 6).alias("agreement")).select(F.lit(bank).alias("bank"), "queries", "agreement")
        out = row if out is None else out.unionByName(row)
    return out


def _ratio(values: str) -> str:
    return f"(SELECT round(pow(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c), 4) FROM (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM {values} a JOIN {values} b ON a.vec_id = b.vec_id GROUP BY a.i, b.i))"


@query("H23_ratio_variants", f"WITH v AS MATERIALIZED (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings WHERE embedding IS NOT NULL), s AS MATERIALIZED (SELECT i, (x > 0)::INT::DOUBLE AS x, vec_id FROM v), m AS (SELECT i, avg(x) AS a, stddev_samp(x) AS sd FROM v GROUP BY i), z AS MATERIALIZED (SELECT v.i, (x - a) / sd AS x, vec_id FROM v JOIN m ON m.i = v.i) SELECT 'binary' AS kind, {_ratio('s')} AS ratio UNION ALL SELECT 'raw', {_ratio('v')} UNION ALL SELECT 'whitened', {_ratio('z')}")
def h23(spark, d):
    """Participation ratio of signs, of raw values and of values brought to mean 0 and deviation 1."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    each = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("a"), F.stddev_samp("x").alias("s")).orderBy("i").collect()  # one row per dimension
    mean, dev = (F.array(*[F.lit(float(r[c])) for r in each]) for c in ("a", "s"))
    kinds = {"binary": F.transform("v", lambda x: (x > 0).cast("double")), "raw": F.col("v"), "whitened": F.zip_with(F.zip_with("v", mean, lambda x, m: x - m), dev, lambda x, s: x / s)}
    out = None
    for name, values in kinds.items():
        row = stats.participation_ratio(stats.moments(e.select(values.alias("v")), "v", 64)).select(F.lit(name).alias("kind"), F.round("ratio", 4).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


_K5 = f"c AS (SELECT q, label, count(*) AS votes, min(rank) AS first FROM nn GROUP BY q, label), pr AS (SELECT q, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY votes DESC, first) AS n FROM c) WHERE n = 1)"


@query("H30_bit_decoder", f"WITH {_E}, {stores._NN}, {_K5} SELECT count(*) AS n, round(avg(bit_count(xor(predicted, e.label) & 15) / 4.0), 6) AS bit_error, round(avg((predicted = e.label)::INT), 6) AS accuracy FROM pr JOIN e ON e.vec_id = pr.q WHERE predicted IS NOT NULL AND e.label IS NOT NULL")
def h30(spark, d):
    """Predicted labels as four bits against the true ones: error per bit and accuracy of the whole code."""
    own = stores.entries(spark, d).select(F.col("vec_id").alias("q"), "label")
    both = stores.k5(spark, d).join(own, "q").where("predicted is not null and label is not null")
    wrong = F.bit_count(F.col("predicted").bitwiseXOR(F.col("label")).bitwiseAND(15))
    return both.agg(F.count("*").alias("n"), F.round(F.avg(wrong / 4.0), 6).alias("bit_error"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query("H33_tree_accuracy", f"WITH lf AS ({oracle_sql()['B11_tree']}), {_E}, j AS (SELECT leaf, label, count(*) AS n FROM lf JOIN e USING (vec_id) WHERE label IS NOT NULL GROUP BY leaf, label) SELECT count(DISTINCT leaf) AS leaves, round(sum(top) / sum(al), 6) AS accuracy FROM (SELECT leaf, max(n) AS top, sum(n) AS al FROM j GROUP BY leaf)")
def h33(spark, d):
    """How well a tree's leaves tell labels: share of entries that have the most frequent label of their leaf."""
    leaf = models.b11(spark, d).join(stores.entries(spark, d).where("label is not null").select("vec_id", "label"), "vec_id")
    n = leaf.groupBy("leaf", "label").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.max("n").alias("top"), F.sum("n").alias("al"))
    return n.agg(F.count("*").alias("leaves"), F.round(F.sum("top") / F.sum("al"), 6).alias("accuracy"))


_RANGES = [(n, lo, (lo + hi) // 2, hi) for n, lo, hi in [(0, 0, 8), (1, 0, 4), (2, 4, 8), (3, 0, 2), (4, 2, 4), (5, 4, 6), (6, 6, 8)]]


@query("H32_range_tree", "WITH v AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL AND label < 8), t AS (SELECT label, i, avg(x) AS x FROM v GROUP BY label, i), nd(node, lo, mid, hi) AS (VALUES " + ", ".join(map(str, _RANGES)) + ") SELECT node, list(CASE WHEN round(r - l, 9) > 0 THEN 1 ELSE -1 END ORDER BY i) AS weights FROM (SELECT node, i, avg(x) FILTER (WHERE label < mid) AS l, avg(x) FILTER (WHERE label >= mid) AS r FROM nd JOIN t ON label >= lo AND label < hi GROUP BY node, i) GROUP BY node")
def h32(spark, d):
    """A tree over ranges of tokens from the weights of a head (mean vectors of eight labels): a node is the sign
    of its right range's mean less its left range's."""
    e = table(spark, d, "embeddings").where("embedding is not null and label < 8").select("label", F.posexplode("embedding").alias("i", "x"))
    head = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    nodes = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(lo).alias("lo"), F.lit(mid).alias("mid"), F.lit(hi).alias("hi")) for n, lo, mid, hi in _RANGES]))
    held = head.withColumn("nd", nodes).select("label", "i", "x", "nd.*").where("label >= lo and label < hi")
    sides = held.groupBy("node", "i").agg(F.avg(F.when(F.col("label") < F.col("mid"), F.col("x"))).alias("l"), F.avg(F.when(F.col("label") >= F.col("mid"), F.col("x"))).alias("r"))
    sign = F.when(F.round(F.col("r") - F.col("l"), 9) > 0, 1).otherwise(-1)
    return sides.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", sign.alias("s")))), lambda x: x["s"]).alias("weights"))  # 64 rows a node


@query("B15_balanced_tree", f"WITH {_E}, h AS (SELECT vec_id, bit_count(words[1])::INT AS a, bit_count(words[2])::INT AS b FROM e), m0 AS (SELECT quantile_disc(a, 0.5) AS m FROM h), l1 AS (SELECT vec_id, a, b, (a > m)::INT AS n1 FROM h, m0), m1 AS (SELECT n1, quantile_disc(b, 0.5) AS m FROM l1 GROUP BY n1), l2 AS (SELECT vec_id, l1.n1, (b > m)::INT AS n2 FROM l1 JOIN m1 ON m1.n1 = l1.n1) SELECT n1 * 2 + n2 AS leaf, count(*) AS n FROM l2 GROUP BY ALL")
def b15(spark, d):
    """A balanced tree of two levels: entries of a node go right where their count of bits in the level's word is
    above the node's median. Medians come from histograms of at most 33 rows a node."""
    at = stores.entries(spark, d).select("vec_id", "words", F.lit(0).alias("node"))
    for level in range(2):
        split = at.withColumn("c", F.bit_count(F.col("words")[level]))
        counts = split.groupBy("node", "c").agg(F.count("*").alias("n"))
        run = counts.withColumn("cum", F.sum("n").over(Window.partitionBy("node").orderBy("c"))).withColumn("all", F.sum("n").over(Window.partitionBy("node")))
        median = run.where("cum * 2 >= all").groupBy("node").agg(F.min("c").alias("m"))
        at = split.join(F.broadcast(median), "node").select("vec_id", "words", (F.col("node") * 2 + (F.col("c") > F.col("m")).cast("int")).alias("node"))
    return at.groupBy(F.col("node").alias("leaf")).agg(F.count("*").alias("n"))


_NODE = "nd AS (SELECT n AS node, " + q.item("'node' || n", 2) + " AS v FROM range(15) r(n)), lv AS (SELECT n AS leaf, " + q.item("'leaf' || n", 2) + " AS v FROM range(16) r(n))"


@query("B13_generate")
def b13(spark, d):
    """Four tokens generated from every asked state: the tree's greedy leaf is the token, and the XOR machine takes
    its state in for the next one."""
    nodes = stored(tree_nodes(spark), "tree")
    at = stores.asked(stores.entries(spark, d)).select("vec_id", "words")
    out = None
    for step in range(4):
        leaf = stored(kn.tree_greedy(at, nodes, "vec_id", 4, W).join(at, "vec_id"), "step")
        row = leaf.select("vec_id", F.lit(step).alias("step"), F.col("leaf").alias("token"))
        out = row if out is None else out.unionByName(row)
        at = leaf.select("vec_id", w.bind(w.rho(F.col("words"), 1, W), w.item(F.concat(F.lit("leaf"), F.col("leaf").cast("string")), W)).alias("words"))
    return out


@query("B18_profile")
def b18(spark, d):
    """Rows and seconds of single kernels over all states."""
    e = stored(stores.entries(spark, d), "entries")
    steps = {"popcount": w.ones(F.col("words")), "bind": w.bind(F.col("words"), F.reverse("words")), "shift": w.rho(F.col("words"), 1, W), "unpack": w.unpack(F.col("words"))}
    rows = []
    for name, step in steps.items():
        began = time.perf_counter()
        n = e.select(step.alias("x")).agg(F.count("x")).first()[0]
        rows.append((name, n, round(time.perf_counter() - began, 4)))
    return spark.createDataFrame(rows, "kernel string, states bigint, seconds double")


@query("I15_suite", f"WITH {_E}, {stores._NN}, {_K5}, hit AS (SELECT (predicted = e.label)::INT AS ok FROM pr JOIN e ON e.vec_id = pr.q WHERE e.label IS NOT NULL), a AS (SELECT avg(coalesce(ok, 0)) AS acc FROM hit), s AS (SELECT count(DISTINCT label) AS classes, count(*) * 16.0 AS bytes FROM e) SELECT round(acc, 6) AS accuracy, classes, round((log2(classes) - log2(greatest(1 / greatest(acc, 0.01), 2))) / (bytes / 1e6), 4) AS density FROM a, s")
def i15(spark, d):
    """The benchmark suite's storage phase: accuracy of votes, classes, and bits gained per megabyte."""
    e = stores.entries(spark, d)
    own = e.where("label is not null").select(F.col("vec_id").alias("q"), "label")
    acc = stores.k5(spark, d).join(own, "q").agg(F.avg(F.coalesce((F.col("predicted") == F.col("label")).cast("int"), F.lit(0))).alias("acc"))
    size = e.agg(F.countDistinct("label").alias("classes"), (F.count("*") * 16.0).alias("bytes"))
    gained = F.log2("classes") - F.log2(F.greatest(1 / F.greatest(F.col("acc"), F.lit(0.01)), F.lit(2.0)))
    return acc.join(F.broadcast(size)).select(F.round("acc", 6).alias("accuracy"), "classes", F.round(gained / (F.col("bytes") / 1e6), 4).alias("density"))


@query("H13_forgetting")
def h13(spark, d):
    """The suite's lifecycle phases: accuracy of the asked entries after each of five batches of unlike patterns is
    added (forgetting), and after the worthless half of all is removed (consolidation)."""
    e = stored(stores.entries(spark, d), "entries")
    own = e.where("label is not null").select(F.col("vec_id").alias("q"), "label")
    n = e.count()
    accuracy = lambda held: st.vote(st.knn(held, stores.asked(e), "vec_id", "words", 4, W, ["label"]), "label").join(own, "q").agg(F.round(F.avg(F.coalesce((F.col("predicted") == F.col("label")).cast("int"), F.lit(0))), 6)).first()[0]
    held, rows = e, [("base", 0, accuracy(e))]
    for batch in range(5):
        noise = spark.range(max(1, n // 10)).select((F.lit(10_000_000 + batch * n) + F.col("id")).alias("vec_id"), w.item(F.concat(F.lit(f"noise{batch}#"), F.col("id").cast("string")), W).alias("words"), (10 + F.col("id") % 10).cast(dict(e.dtypes)["label"]).alias("label"))
        held = held.unionByName(noise)
        rows.append(("forgetting", batch + 1, accuracy(held)))
    rows.append(("consolidation", 6, accuracy(held.where("vec_id < 10000000 or vec_id % 2 = 0"))))
    return spark.createDataFrame(rows, "phase string, step int, accuracy double")


@query("H1_facade_metrics", f"WITH {_E}, {stores._PROTO} SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM pt) AS routes, (SELECT count(*) FROM edges WHERE source IS NOT NULL AND target IS NOT NULL) AS edges, 64 AS dim")
def h1(spark, d):
    """What the whole engine holds: entries, routes and edges."""
    e = stores.entries(spark, d)
    edges = table(spark, d, "edges").where("source is not null and target is not null")
    counted = e.agg(F.count("*").alias("entries")).join(stores.r4(spark, d).agg(F.count("*").alias("routes"))).join(edges.agg(F.count("*").alias("edges")))
    return counted.withColumn("dim", F.lit(D))


@query("H3_item_memory", f"WITH {q.FACTS}, {q.BOOK} SELECT mem, count(*) AS names, (SELECT count(*) FROM f WHERE f.mem = book.mem) AS n_facts FROM book GROUP BY mem")
def h3(spark, d):
    """Names and facts of every memory."""
    from bitweave.operators import memory as mm

    f = facts(spark, d)
    return mm.codebook(f).groupBy("mem").agg(F.count("*").alias("names")).join(f.groupBy("mem").agg(F.count("*").alias("n_facts")), "mem")


@query("H4_working_memory", f"WITH {q.MEMORY}, t2 AS (SELECT mem, n * 2 AS n, trace FROM tr) SELECT mem, n::BIGINT AS n, trace FROM t2")
def h4(spark, d):
    """Facts stored a second time: the trace stays, its weight doubles."""
    from bitweave.operators import memory as mm

    f = facts(spark, d)
    return mm.traces(f.unionByName(f), q.W)


@query("H7_retrieval_switch", f"WITH {_E}, {stores._NN}, fu AS ({oracle_sql()['F2_fusion']}), one AS (SELECT q, vec_id FROM nn WHERE rank = 1) SELECT 'single' AS mode, count(*) AS answered FROM one UNION ALL SELECT 'ensemble', count(DISTINCT q) FROM fu")
def h7(spark, d):
    """Retrieval by one space or by the ensemble: queries that each mode answers."""
    single = stores.k1(spark, d).where("rank = 1").agg(F.count("*").alias("answered")).select(F.lit("single").alias("mode"), "answered")
    return single.unionByName(stores.f2(spark, d).agg(F.countDistinct("q").alias("answered")).select(F.lit("ensemble").alias("mode"), "answered"))


@query("H12_remember", oracle_sql()["L4_evict"])
def h12(spark, d):
    """Another name of observing with eviction (L4)."""
    return stores.l4(spark, d)


@query("H39_compiler_row", f"WITH v AS ({oracle_sql()['V4_symbolic_audit']}), f AS (SELECT count(*) AS n, count(DISTINCT s) + count(DISTINCT o) AS m FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL) SELECT count(*) AS asked, round(avg(grounded::INT), 6) AS grounded, max(n) AS load, max(m) AS codebook FROM v, f")
def h39(spark, d):
    """One row on the compiler: share of questions whose plan the triples ground, and the load of the store."""
    f = table(spark, d, "facts").where("s is not null and r is not null and o is not null")
    load = f.agg(F.count("*").alias("load"), (F.countDistinct("s") + F.countDistinct("o")).alias("codebook"))
    return analysis.v4(spark, d).agg(F.count("*").alias("asked"), F.round(F.avg(F.col("grounded").cast("int")), 6).alias("grounded")).join(F.broadcast(load))


@query("E8_encoders", "SELECT 'entity' AS encoder, count(*) AS texts FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'length', count(*) FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'ngram', count(*) FROM documents WHERE text IS NOT NULL AND length(text) > 1")
def e8(spark, d):
    """Registered encoders by name, one of them the caller's own."""
    known = Encoders()
    known.register("length", lambda df, ident, text: df.select(ident, F.array(F.length(text).cast("bigint"), F.lit(0).cast("bigint")).alias("state")))
    held = texts.docs(spark, d)
    out = None
    for name in ("entity", "length", "ngram"):
        row = known.encode(name, held.where("length(text) > 1") if name == "ngram" else held, "doc_id", "text").agg(F.count("*").alias("texts")).select(F.lit(name).alias("encoder"), "texts")
        out = row if out is None else out.unionByName(row)
    return out


@query("A13_fitted_projection")
def a13(spark, d):
    """Role projection fitted to the data: signs of the coordinates along the first 16 principal directions, turned
    by a fixed rotation seeded by the role."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    made = PCA(k=16, inputCol="x", outputCol="y").fit(rows).transform(rows).select("vec_id", vector_to_array("y").alias("y"))
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((16, 16)))[0]
    turned = F.array(*[sum((F.col("y")[j] * float(turn[i, j]) for j in range(1, 16)), F.col("y")[0] * float(turn[i, 0])) for i in range(16)])
    bits = w.let(turned, lambda t: F.transform(F.concat(t, F.array_repeat(F.lit(0.0), 16)), lambda v: (v > 0).cast("int")))
    return made.select("vec_id", w.let(bits, lambda b: w.pack(b, 1)).alias("state"))


@query("H38_alias_margin")
def h38(spark, d):
    """How far spellings of one name lie from each other and from others, in three conditions: nearest spelling of
    the same group (own), nearest of another (other), and the margin between them, over sketches of the names."""
    from bitweave.functions import text as tx

    ref = table(spark, d, "ref_entities").select("canon_id", F.lower("canon_name").alias("name"))
    typed = ref.unionByName(ref.select("canon_id", F.concat(F.lit("the "), F.col("name")).alias("name"))).unionByName(ref.select("canon_id", F.regexp_replace("name", "[aeiou]$", "").alias("name")))
    sk = stored(typed.select(F.monotonically_increasing_id().alias("vec_id"), F.col("canon_id").alias("label"), tx.minhash(tx.token_set(F.col("name")), W).alias("words")).where("words is not null"), "aliases")
    near = st.knn(sk, sk, "vec_id", "words", 5, W, ["label"]).join(sk.select(F.col("vec_id").alias("q"), F.col("label").alias("own_label")), "q")
    same = F.col("label") == F.col("own_label")
    each = near.groupBy("q").agg(F.min(F.when(same, F.col("dist"))).alias("own"), F.min(F.when(~same, F.col("dist"))).alias("other"))
    return each.agg(F.count("*").alias("names"), F.round(F.avg("own"), 4).alias("own"), F.round(F.avg("other"), 4).alias("other"), F.round(F.avg((F.col("own") < F.col("other")).cast("int")), 4).alias("told_apart"))

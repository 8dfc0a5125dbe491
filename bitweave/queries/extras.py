"""Other generators, projections, redundancy laws and tolerant parsers (rows of A, B, I, K, L, S, V and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import compat
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import memory as mm
from bitweave.operators import store as st
from bitweave.queries import oracle as q
from bitweave.queries import stores, texts
from bitweave.session import table


@query("A1_twister")
def a1t(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "part").select("p_name")).distinct()
    return names.select("name", compat.twister_item(F.col("name"), q.W).alias("words"))


@query("A12_role_projection", f"WITH {stores._E}, p AS MATERIALIZED (SELECT i, {q.item(chr(39) + 'role' + chr(39) + ' || i', 2)} AS v FROM range(64) r(i)) SELECT vec_id, [sum(CASE WHEN i < 32 AND 64 - 2 * {q.ham('words', 'v', 2)} > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT, sum(CASE WHEN i >= 32 AND 64 - 2 * {q.ham('words', 'v', 2)} > 0 THEN 1::BIGINT << (i - 32) ELSE 0 END)::BIGINT] AS projected FROM e, p GROUP BY vec_id")
def a12(spark, d):
    """Sign of a +1/-1 matrix that a role's name seeds, times the state. The matrix has as many rows as the state bits."""
    rows = spark.range(64).select(F.col("id").alias("i"), w.item(F.concat(F.lit("role"), F.col("id").cast("string")), 2).alias("v"))
    on = stores.entries(spark, d).join(F.broadcast(rows), how="cross").select("vec_id", "i", (w.dot(F.col("words"), F.col("v"), 2) > 0).alias("on"))
    word = lambda k: F.sum(F.when(F.col("on") & (F.expr("i div 32") == k), F.expr("shiftleft(1L, cast(i % 32 as int))")).otherwise(0))
    return on.groupBy("vec_id").agg(F.array(word(0), word(1)).alias("projected"))


@query("K4_gaussian")
def k4(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", compat.gaussian_state(F.col("embedding"), 64, 8).alias("words"))


@query("B8_from_bytes", f"WITH {stores._E} SELECT vec_id, words FROM e")
def b8(spark, d):
    """States packed to little-endian bytes and read back, in the JVM."""
    byte = lambda x, k: F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    packed = stores.entries(spark, d).select("vec_id", F.unhex(F.array_join(F.transform("words", lambda x: F.concat(*[byte(x, k) for k in range(4)])), "")).alias("raw"))
    digits = F.hex("raw")
    word = lambda h, i: F.conv(F.concat(*[F.substring(h, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("bigint")
    words = w.let(digits, lambda h: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: word(h, i)))
    return packed.where(F.length("raw") == 8).select("vec_id", words.alias("words"))


_DUP = f"g AS (SELECT i, CASE WHEN i < 10 THEN 5 ELSE 1 END AS n FROM range(60) t(i)), f AS (SELECT 0 AS mem, i AS ord, 's' || i AS s, 'r' || (i % 7) AS r, 'o' || i AS o, n::BIGINT AS n FROM g)"


@query("I16_redundancy", f"WITH {_DUP}, {q.BOOK}, {q.HV}, {q.STATE}, {q.TRACE}, ask AS (SELECT st.mem, s, r, {q.bind('trace', 'k')} AS noisy FROM st JOIN tr USING (mem)), a AS (SELECT * FROM {q.cleanup('ask', 's, r')}) SELECT f.n = 5 AS repeated, count(*) AS queries, sum((f.o = a.answer)::INT)::BIGINT AS hits FROM a JOIN f ON f.s = a.s AND f.r = a.r GROUP BY repeated")
def i16(spark, d):
    """Facts stored five times drown the others: hits of both kinds."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i = F.col("id")
    f = spark.range(60).select(F.lit(0).alias("mem"), i.alias("ord"), name("s", i).alias("s"), name("r", i % 7).alias("r"), name("o", i).alias("o"), F.when(i < 10, 5).otherwise(1).cast("bigint").alias("n"))
    got = mm.query(f, f.select("mem", "s", "r"), q.W).join(f.select("mem", "s", "r", "o", "n"), ["mem", "s", "r"])
    return got.groupBy((F.col("n") == 5).alias("repeated")).agg(F.count("*").alias("queries"), F.count_if(F.col("o") == F.col("answer")).alias("hits"))


@query("I17_no_cleanup", f"WITH {q.MEMORY} SELECT st.mem, count(*) AS facts, sum(({q.bind('trace', 'k')} = ov)::INT)::BIGINT AS exact FROM st JOIN tr USING (mem) GROUP BY st.mem")
def i17(spark, d):
    """Without cleanup an unbound answer is right only where it equals the stored state bit for bit."""
    from bitweave.queries.algebra import facts

    f = facts(spark, d)
    raw = f.join(mm.traces(f, q.W), "mem").select("mem", (w.bind(F.col("trace"), mm.key(F.col("s"), F.col("r"), q.W)) == w.item(F.col("o"), q.W)).alias("same"))
    return raw.groupBy("mem").agg(F.count("*").alias("facts"), F.count_if("same").alias("exact"))


@query("L9_dream", f"WITH {stores._E}, s AS (SELECT vec_id AS start, list_transform(range(2), lambda i: xor(words[i + 1], ('0x' || substr(md5('dream#' || vec_id || '#' || i), 1, 8))::BIGINT & ('0x' || substr(md5('deep#' || vec_id || '#' || i), 1, 8))::BIGINT)) AS noisy FROM e WHERE vec_id % 20 = 0), r AS (SELECT start, vec_id, {q.ham('noisy', 'words', 2)} AS dist, row_number() OVER (PARTITION BY start ORDER BY {q.ham('noisy', 'words', 2)}, vec_id) AS n FROM s JOIN e ON vec_id <> start) SELECT start, vec_id AS recalled, dist, 0.3 AS value FROM r WHERE n = 1")
def l9(spark, d):
    """One dreamt step: an entry with a quarter of its bits flipped recalls its nearest other entry; what comes out is stored with a low value."""
    e = stores.entries(spark, d)
    word = lambda tag, i: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(tag), F.col("vec_id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    noisy = stores.asked(e).select("vec_id", F.transform("words", lambda x, i: x.bitwiseXOR(word("dream", i).bitwiseAND(word("deep", i)))).alias("words"))
    near = st.knn(e, noisy, "vec_id", "words", 1, stores.W)
    return near.select(F.col("q").alias("start"), F.col("vec_id").alias("recalled"), "dist", F.lit(0.3).alias("value"))


@query("V6_json_objects")
def v6(spark, d):
    """Plans written as JSON objects inside of texts."""
    found = texts.docs(spark, d).select("doc_id", F.explode(compat.json_objects(F.col("text"), "anchor")).alias("j"))
    plan = F.from_json("j", "anchor string, chain array<string>")
    return found.select("doc_id", plan.alias("p")).select("doc_id", "p.anchor", "p.chain")


@query("H9_context_tokens", f"WITH t AS (SELECT source, greatest(1, floor(len({texts._words('text')}) * 1.3::DOUBLE))::INT AS n FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS chunks, sum(n)::BIGINT AS tokens FROM t GROUP BY source")
def h9(spark, d):
    return texts.docs(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@query("H19_density_accounting", "SELECT compiler, dim, round(avg(acc), 6) AS accuracy, round(avg(acc) * log2(10) / (dim / 8.0), 9) AS bits_per_byte FROM (SELECT run_id, avg(hit::INT) AS acc FROM results WHERE hit IS NOT NULL GROUP BY run_id) JOIN runs USING (run_id) GROUP BY compiler, dim")
def h19(spark, d):
    acc = table(spark, d, "results").where("hit is not null").groupBy("run_id").agg(F.avg(F.col("hit").cast("int")).alias("acc"))
    runs = table(spark, d, "runs").select("run_id", "compiler", "dim")
    g = acc.join(F.broadcast(runs), "run_id").groupBy("compiler", "dim").agg(F.avg("acc").alias("a"))
    return g.select("compiler", "dim", F.round("a", 6).alias("accuracy"), F.round(F.col("a") * F.log2(F.lit(10.0)) / (F.col("dim") / 8.0), 9).alias("bits_per_byte"))


@query("H20_bank_ablation", f"WITH {stores._E}, r AS (SELECT k, a.vec_id AS q, b.label = a.label AS ok, row_number() OVER (PARTITION BY k, a.vec_id ORDER BY CASE WHEN k = 0 THEN bit_count(xor(a.words[2], b.words[2])) ELSE bit_count(xor(a.words[1], b.words[1])) END, b.vec_id) AS n FROM e a, e b, (SELECT unnest([0, 1]) AS k) WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT k AS bank_off, count(*) AS n, round(avg(ok::INT), 6) AS accuracy FROM r WHERE n = 1 GROUP BY k")
def h20(spark, d):
    """Accuracy of the nearest neighbour's label with one bank of bits (a word) switched off."""
    e = stores.entries(spark, d)
    own = e.select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    parts = []
    for off in (0, 1):
        half = e.select("vec_id", "label", F.slice("words", 2 - off, 1).alias("words"))
        near = st.knn(half, stores.asked(half), "vec_id", "words", 1, 1, ["label"]).join(own, "q")
        parts.append(near.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("own")).cast("int")), 6).alias("accuracy")).select(F.lit(off).alias("bank_off"), "n", "accuracy"))
    return parts[0].unionByName(parts[1])

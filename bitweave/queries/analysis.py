"""Statistics, evaluation and audits (I and V rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import overlap, stats
from bitweave.operators import store as st
from bitweave.queries import oracle as q
from bitweave.queries import stores, texts
from bitweave.session import stored, table

_E = stores._E


@query("I1_accuracy", "SELECT run_id, round(avg((gold = ans)::INT), 6) AS accuracy, count(*) AS n FROM results WHERE gold IS NOT NULL AND ans IS NOT NULL GROUP BY run_id")
def i1(spark, d):
    r = table(spark, d, "results").where("gold is not null and ans is not null")
    return r.groupBy("run_id").agg(F.round(F.avg((F.col("gold") == F.col("ans")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("I1_recall_at_k", f"WITH {_E}, {stores._NN}, h AS (SELECT q, list(label ORDER BY rank) AS found FROM nn GROUP BY q) SELECT q, list_contains(found[1:1], label) AS at_1, list_contains(found[1:3], label) AS at_3, list_contains(found, label) AS at_5 FROM h JOIN e ON e.vec_id = q")
def i1r(spark, d):
    e = stores.entries(spark, d)
    near = st.knn(e, stores.asked(e), "vec_id", "words", 5, stores.W, ["label"])
    true = e.select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    hit = near.join(true, "q").groupBy("q").agg(*[F.bool_or((F.col("rank") <= k) & (F.col("label") == F.col("own"))).alias(f"at_{k}") for k in (1, 3, 5)])
    return hit


_I2 = "CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END + {q} * log2({q} / greatest(c - 1, 1))"


@query("I2_knowledge_density", "WITH r AS (SELECT run_id, avg(hit::INT) AS a, greatest(1 - avg(hit::INT), 1e-10) AS b, count(DISTINCT gold) AS c, count(*) * 8.0 AS bytes FROM results WHERE hit IS NOT NULL GROUP BY run_id) SELECT run_id, round((CASE WHEN c > 1 THEN log2(c) ELSE 1 END + " + _I2.format(p="a", q="b") + ") / bytes, 6) AS bits_per_byte FROM r")
def i2(spark, d):
    """(log2 of the classes - entropy left) / bytes: the entropy left follows from the accuracy p, p log2 p +
    (1 - p) log2((1 - p) / (classes - 1)), negated. Classes are a run's different gold answers, a state has 8 bytes."""
    r = table(spark, d, "results").where("hit is not null")
    g = r.groupBy("run_id").agg(F.avg(F.col("hit").cast("int")).alias("a"), F.countDistinct("gold").alias("c"), (F.count("*") * 8.0).alias("bytes"))
    wrong = F.greatest(1 - F.col("a"), F.lit(1e-10))
    left = -(F.when(F.col("a") > 0, F.col("a") * F.log2("a")).otherwise(0.0) + wrong * F.log2(wrong / F.greatest(F.col("c") - 1, F.lit(1))))
    prior = F.when(F.col("c") > 1, F.log2("c")).otherwise(1.0)
    return g.select("run_id", F.round((prior - left) / F.col("bytes"), 6).alias("bits_per_byte"))


_COV = "v AS (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)"


@query("I3_participation_ratio", f"WITH {_COV} SELECT round(pow(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c), 4) AS ratio FROM c")
def i3(spark, d):
    return stats.participation_ratio(stats.moments(table(spark, d, "embeddings"), "embedding", 64)).select(F.round("ratio", 4).alias("ratio"))


@query("I4_gini", "WITH s AS (SELECT sum(support) OVER (ORDER BY support, edge_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum, count(*) OVER () AS n, sum(support) OVER ()::DOUBLE AS total FROM edges WHERE support >= 0) SELECT max(n) AS n, round(1 - 2 * sum(cum) / (max(n) * max(total)), 6) AS metric, round((max(n) + 1 - 2 * sum(cum) / max(total)) / max(n), 6) AS standard FROM s")
def i4(spark, d):
    g = stats.gini(table(spark, d, "edges").where("support >= 0").select(F.col("support").cast("double").alias("support")), "support")
    return g.select("n", F.round("metric", 6).alias("metric"), F.round("standard", 6).alias("standard"))


def _mi(n11: str, n1: str, m1: str, n: str) -> str:
    part = lambda c, a, b: f"CASE WHEN {c} > 0 AND {a} > 0 AND {b} > 0 THEN {c} / {n} * log2({c} * {n} / ({a} * {b})) ELSE 0 END"
    return f"greatest(0, {part(n11, n1, m1)} + {part(f'({n1} - {n11})', n1, f'({n} - {m1})')} + {part(f'({m1} - {n11})', f'({n} - {n1})', m1)} + {part(f'({n} - {n1} - {m1} + {n11})', f'({n} - {n1})', f'({n} - {m1})')})"


_BITS = "b AS (SELECT vec_id, label, unnest(range(64)) AS j, unnest(list_transform(range(64), lambda i: (words[i // 32 + 1] >> (i % 32)) & 1))::DOUBLE AS s FROM e WHERE label IS NOT NULL)"
_PER_BIT = f"{_BITS}, k AS (SELECT j, k, sum(s * ((label >> k) & 1))::DOUBLE AS n11, sum(s)::DOUBLE AS n1, sum((label >> k) & 1)::DOUBLE AS m1, count(*)::DOUBLE AS n FROM b, range(4) r(k) GROUP BY j, k), mi AS (SELECT j, sum({_mi('n11', 'n1', 'm1', 'n')}) AS mi FROM k GROUP BY j)"


def _per_bit(spark, d):
    e = stores.entries(spark, d).where("label is not null")
    bits = e.select("label", F.posexplode(w.unpack(F.col("words"))).alias("j", "s"))
    sums = [F.sum(F.col("s") * F.getbit(F.col("label").cast("bigint"), F.lit(k)).cast("int")).cast("double").alias(f"b{k}") for k in range(4)]
    marks = [F.sum(F.getbit(F.col("label").cast("bigint"), F.lit(k)).cast("int")).cast("double").alias(f"m{k}") for k in range(4)]
    counted = bits.groupBy("j").agg(F.sum("s").cast("double").alias("n1"), F.count("*").cast("double").alias("n"), *sums, *marks)
    total = sum((stats.mutual_information(F.col(f"b{k}"), F.col("n1"), F.col(f"m{k}"), F.col("n")) for k in range(1, 4)), stats.mutual_information(F.col("b0"), F.col("n1"), F.col("m0"), F.col("n")))
    return counted.select(F.col("j").cast("bigint").alias("j"), total.alias("mi"))


@query("I5_bit_information", f"WITH {_E}, {_PER_BIT} SELECT j, round(mi, 6) AS mi FROM mi")
def i5(spark, d):
    return _per_bit(spark, d).select("j", F.round("mi", 6).alias("mi"))


@query("I6_cumulative_information", f"WITH {_E}, {_PER_BIT}, r AS (SELECT row_number() OVER (ORDER BY round(mi, 9) DESC, j) AS place, round(mi, 9) AS mi FROM mi), c AS (SELECT place, sum(mi) OVER (ORDER BY place) / sum(mi) OVER () AS share FROM r) SELECT place, round(share, 6) AS share FROM c WHERE place IN (1, 6, 16, 32, 64)")
def i6(spark, d):
    mi = _per_bit(spark, d).withColumn("mi", F.round("mi", 9))
    order = Window.orderBy(F.desc("mi"), "j")  # one row per bit of a state, 64 in all
    ranked = mi.withColumn("place", F.row_number().over(order)).withColumn("run", F.sum("mi").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = mi.agg(F.sum("mi").alias("total"))
    return ranked.join(F.broadcast(total)).where("place in (1, 6, 16, 32, 64)").select("place", F.round(F.col("run") / F.col("total"), 6).alias("share"))


@query("I7_pairwise_information", f"WITH {_E}, {_BITS}, p AS (SELECT x.j AS i, y.j AS j, sum(x.s * y.s) AS n11, sum(x.s) AS n1, sum(y.s) AS m1, count(*)::DOUBLE AS n FROM b x JOIN b y ON x.vec_id = y.vec_id AND x.j < y.j GROUP BY x.j, y.j) SELECT i // 16 AS bank, j // 16 AS other, count(*) AS pairs, round(avg({_mi('n11', 'n1', 'm1', 'n')}), 6) AS mi FROM p GROUP BY bank, other")
def i7(spark, d):
    e = stores.entries(spark, d).where("label is not null").select(w.unpack(F.col("words")).cast("array<double>").alias("bits"))
    m = stats.moments(e, "bits", 64).where("i < j")
    mi = stats.mutual_information(F.round("sij"), F.round("si"), F.round("sj"), F.col("n").cast("double"))
    return m.groupBy(F.expr("cast(i div 16 as bigint)").alias("bank"), F.expr("cast(j div 16 as bigint)").alias("other")).agg(F.count("*").alias("pairs"), F.round(F.avg(mi), 6).alias("mi"))


_NN2 = f"n2 AS (SELECT * FROM (SELECT a.vec_id AS q, {q.ham('a.words', 'b.words', 2)} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {q.ham('a.words', 'b.words', 2)}, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 2)"


@query("I8_two_nn", f"WITH {_E}, {_NN2}, mu AS (SELECT q, max(dist) / min(dist)::DOUBLE AS mu FROM n2 GROUP BY q HAVING min(dist) > 0 AND max(dist) > min(dist)), f AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu, q) / (count(*) OVER ())::DOUBLE AS f FROM mu) SELECT count(*) AS used, round(-sum(x * ln(1 - f + 1e-15)) / sum(x * x), 4) AS dimension FROM f")
def i8(spark, d):
    e = stores.entries(spark, d)
    near = st.knn(e, stores.asked(e), "vec_id", "words", 2, stores.W)
    mu = near.groupBy("q").agg(F.min("dist").alias("r1"), F.max("dist").alias("r2")).where("r1 > 0 and r2 > r1").select("q", (F.col("r2") / F.col("r1")).alias("mu"))
    f = mu.withColumn("f", F.row_number().over(Window.orderBy("mu", "q")) / F.count("*").over(Window.partitionBy())).withColumn("x", F.log("mu"))
    return f.agg(F.count("*").alias("used"), F.round(-F.sum(F.col("x") * F.log(1 - F.col("f") + 1e-15)) / F.sum(F.col("x") * F.col("x")), 4).alias("dimension"))


@query("I9_frozen_bits", f"WITH {_E}, {_BITS} SELECT j, round(var_pop(s), 6) AS variance, var_pop(s) < 0.01 AS frozen FROM b GROUP BY j")
def i9(spark, d):
    bits = stores.entries(spark, d).where("label is not null").select(F.posexplode(w.unpack(F.col("words"))).alias("j", "s"))
    return bits.groupBy(F.col("j").cast("bigint").alias("j")).agg(F.round(F.var_pop("s"), 6).alias("variance"), (F.var_pop("s") < 0.01).alias("frozen"))


@query("I10_geometry_curve", f"WITH {_E} SELECT dist, count(*) AS pairs, round(avg(same::INT), 6) AS same FROM (SELECT {q.ham('a.words', 'b.words', 2)} AS dist, a.label = b.label AS same FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) GROUP BY dist")
def i10(spark, d):
    e = stores.entries(spark, d)
    out = None
    for block in st.blocks(stores.asked(e), "vec_id"):
        asked = F.broadcast(block.select(F.col("vec_id").alias("i"), F.col("words").alias("x"), F.col("label").alias("own")))
        pairs = e.join(asked, F.col("i") != F.col("vec_id"))
        same = (F.col("own") == F.col("label")).cast("int")
        part = pairs.groupBy(w.hamming(F.col("x"), F.col("words"), stores.W).alias("dist")).agg(F.count("*").alias("pairs"), F.sum(same).alias("s"), F.count(same).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("dist").agg(F.sum("pairs").alias("pairs"), F.round(F.sum("s") / F.sum("n"), 6).alias("same"))


@query("I11_verdict", "WITH r AS (SELECT run_id, avg(hit::INT) AS a FROM results WHERE hit IS NOT NULL GROUP BY run_id), c AS (SELECT compiler, avg(a) AS mean, stddev_pop(a) / avg(a) AS cv FROM r JOIN runs USING (run_id) GROUP BY compiler) SELECT compiler, round(mean, 6) AS mean, round(cv, 6) AS cv, CASE WHEN cv < 0.1 THEN 'STABLE' WHEN cv < 0.3 THEN 'TRENDING' ELSE 'SCALING' END AS verdict FROM c")
def i11(spark, d):
    r = table(spark, d, "results").where("hit is not null").groupBy("run_id").agg(F.avg(F.col("hit").cast("int")).alias("a"))
    c = r.join(F.broadcast(table(spark, d, "runs").select("run_id", "compiler")), "run_id").groupBy("compiler").agg(F.avg("a").alias("mean"), (F.stddev_pop("a") / F.avg("a")).alias("cv"))
    return c.select("compiler", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"), F.when(F.col("cv") < 0.1, "STABLE").when(F.col("cv") < 0.3, "TRENDING").otherwise("SCALING").alias("verdict"))


@query("I12_trajectory", f"WITH {_E}, t AS (SELECT label, vec_id, words, lag(words) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM e) SELECT label, round(avg({q.ham('words', 'prev', 2)}) / 64, 6) AS plasticity, count(DISTINCT words) AS capacity FROM t GROUP BY label")
def i12(spark, d):
    e = stores.entries(spark, d).withColumn("prev", F.lag("words").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.groupBy("label").agg(F.round(F.avg(w.hamming(F.col("words"), F.col("prev"), stores.W)) / 64, 6).alias("plasticity"), F.countDistinct("words").alias("capacity"))


@query("I14_clusters", f"SELECT i AS id, i % 5 AS cluster, list_transform(range(8), lambda k: xor(c[k + 1], n1[k + 1] & n2[k + 1])) AS words FROM (SELECT i, {q.item(chr(39) + 'centre' + chr(39) + ' || (i % 5)', 8)} AS c, {q.item(chr(39) + 'a' + chr(39) + ' || i', 8)} AS n1, {q.item(chr(39) + 'b' + chr(39) + ' || i', 8)} AS n2 FROM range(1000) r(i))")
def i14(spark, d):
    name = lambda p, c: w.item(F.concat(F.lit(p), c.cast("string")), 8)
    i = F.col("id")
    return spark.range(1000).select("id", (i % 5).alias("cluster"), w.bind(name("centre", i % 5), w.both(name("a", i), name("b", i))).alias("words"))


@query("I18_token_weights", f"WITH t AS (SELECT unnest({texts._words('lower(text)')}) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT t, count(*) AS n FROM t GROUP BY t), x AS (SELECT t, n, 1 / sqrt(n) AS a, ln(sum(n) OVER () / n) AS b FROM c) SELECT t AS token, n, round(a / avg(a) OVER (), 6) AS inverse_root, round(b / avg(b) OVER (), 6) AS idf FROM x")
def i18(spark, d):
    c = texts.docs(spark, d).select(F.explode(tx.low_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    x = c.join(F.broadcast(total)).select("token", "n", (1 / F.sqrt("n")).alias("a"), F.log(F.col("all") / F.col("n")).alias("b"))
    mean = x.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    return x.join(F.broadcast(mean)).select("token", "n", F.round(F.col("a") / F.col("ma"), 6).alias("inverse_root"), F.round(F.col("b") / F.col("mb"), 6).alias("idf"))


# Error injection and audits. A fact's fate is decided by its hash, so another engine decides alike.
_FATE = "('0x' || substr(md5('fate#' || fact_id), 1, 6))::INT % 100"


def _fate():
    return F.conv(F.substring(F.md5(F.concat(F.lit("fate#"), F.col("fact_id").cast("string"))), 1, 6), 16, 10).cast("int") % 100


@query("V1_error_injection", f"WITH f AS (SELECT fact_id, s, r, o, {_FATE} < 10 AS hit FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL) SELECT 'missing' AS kind, fact_id, s, r, o FROM f WHERE NOT hit UNION ALL SELECT 'wrong_relation', fact_id, s, CASE WHEN hit THEN 'r_bogus' ELSE r END, o FROM f UNION ALL SELECT 'wrong_entity', fact_id, s, r, CASE WHEN hit THEN 'noise_' || fact_id ELSE o END FROM f")
def v1(spark, d):
    f = table(spark, d, "facts").where("s is not null and r is not null and o is not null").withColumn("hit", _fate() < 10)
    kinds = F.array(*map(F.lit, ["missing", "wrong_relation", "wrong_entity"]))
    rows = f.select("fact_id", "s", "r", "o", "hit", F.explode(kinds).alias("kind")).where("kind <> 'missing' or not hit")
    return rows.select("kind", "fact_id", "s", F.when(F.col("hit") & (F.col("kind") == "wrong_relation"), "r_bogus").otherwise(F.col("r")).alias("r"), F.when(F.col("hit") & (F.col("kind") == "wrong_entity"), F.concat(F.lit("noise_"), F.col("fact_id").cast("string"))).otherwise(F.col("o")).alias("o"))


@query("V2_compilers", f"WITH f AS (SELECT doc_id, fact_id, {_FATE} AS x, ('0x' || substr(md5('doc#' || doc_id), 1, 6))::INT % 100 AS y FROM facts WHERE doc_id IS NOT NULL) SELECT doc_id, count(*) AS facts, count(*) FILTER (WHERE x >= 20) AS uniform, count(*) FILTER (WHERE y >= 20) AS clustered, count(*) FILTER (WHERE x >= 5) AS recall_tuned FROM f GROUP BY doc_id")
def v2(spark, d):
    y = F.conv(F.substring(F.md5(F.concat(F.lit("doc#"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("int") % 100
    f = table(spark, d, "facts").where("doc_id is not null").select("doc_id", _fate().alias("x"), y.alias("y"))
    return f.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("x") >= 20).alias("uniform"), F.count_if(F.col("y") >= 20).alias("clustered"), F.count_if(F.col("x") >= 5).alias("recall_tuned"))


@query("V3_topologies", "SELECT 'api' AS kind, 'svc' || i AS s, 'calls' || (i % 6) AS r, 'svc' || i || '_next' AS o FROM range(50) t(i) UNION ALL SELECT 'manuals', 'm' || i || '_' || k, 'next', 'm' || i || '_' || (k + 1) FROM range(40) t(i), range(3) u(k) UNION ALL SELECT 'legal', 'case' || i, 'cites', 'hub' || (i % 5) FROM range(45) t(i) UNION ALL SELECT 'medical', 'patient' || i, 'treated_by', 'hub' || (i % 10) FROM range(50) t(i)")
def v3(spark, d):
    i = F.col("id").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    api = spark.range(50).select(F.lit("api").alias("kind"), cat("svc", i).alias("s"), cat("calls", F.col("id") % 6).alias("r"), cat("svc", i, "_next").alias("o"))
    steps = spark.range(40).select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    manuals = steps.select(F.lit("manuals").alias("kind"), cat("m", i, "_", F.col("k")).alias("s"), F.lit("next").alias("r"), cat("m", i, "_", F.col("k") + 1).alias("o"))
    legal = spark.range(45).select(F.lit("legal").alias("kind"), cat("case", i).alias("s"), F.lit("cites").alias("r"), cat("hub", F.col("id") % 5).alias("o"))
    medical = spark.range(50).select(F.lit("medical").alias("kind"), cat("patient", i).alias("s"), F.lit("treated_by").alias("r"), cat("hub", F.col("id") % 10).alias("o"))
    return api.unionByName(manuals).unionByName(legal).unionByName(medical)


# A question with its graph: triples and their inverses, the anchor and the two relations of its chain.
_QS = f"""qs AS (SELECT id, any_value(gold) AS gold, lower(any_value(plan.anchor)) AS anchor, any_value(plan.chain) AS chain, any_value(triples) AS triples FROM pilot_extraction WHERE gold IS NOT NULL AND plan.anchor IS NOT NULL GROUP BY id),
 tr AS (SELECT id, lower(t[1]) AS s, t[2] AS r, lower(t[3]) AS o FROM (SELECT id, unnest(triples) AS t FROM qs) WHERE t[1] IS NOT NULL AND t[2] IS NOT NULL AND t[3] IS NOT NULL),
 ed AS (SELECT DISTINCT id, s, r, o FROM tr UNION SELECT id, o, r, s FROM tr),
 gt AS (SELECT id, {texts._answer('gold')} AS g FROM qs)"""
_MATCH = "len(g) > 0 AND len({a}) > 0 AND (list_has_all({a}, g) OR list_has_all(g, {a}))"


def _questions(spark, d):
    p = table(spark, d, "pilot_extraction").where("gold is not null and plan.anchor is not null")
    qs = p.groupBy("id").agg(F.any_value("gold").alias("gold"), F.lower(F.any_value(F.col("plan.anchor"))).alias("anchor"), F.any_value(F.col("plan.chain")).alias("chain"), F.any_value("triples").alias("triples"))
    t = qs.select("id", F.explode("triples").alias("t")).select("id", F.lower(F.get("t", F.lit(0))).alias("s"), F.get("t", F.lit(1)).alias("r"), F.lower(F.get("t", F.lit(2))).alias("o")).where("s is not null and r is not null and o is not null")
    edges = t.unionByName(t.select("id", F.col("o").alias("s"), "r", F.col("s").alias("o"))).distinct()
    return qs, edges


@query("V4_symbolic_audit", f"WITH {_QS}, h1 AS (SELECT DISTINCT qs.id, ed.o AS node FROM qs JOIN ed ON ed.id = qs.id AND ed.s = qs.anchor AND ed.r = qs.chain[1]), h2 AS (SELECT DISTINCT h1.id, ed.o AS node FROM h1 JOIN qs ON qs.id = h1.id JOIN ed ON ed.id = h1.id AND ed.s = h1.node AND ed.r = qs.chain[2]), m AS (SELECT h2.id, bool_or({_MATCH.format(a=texts._answer('node'))}) AS ok FROM h2 JOIN gt ON gt.id = h2.id GROUP BY h2.id) SELECT qs.id, coalesce(ok, FALSE) AS grounded FROM qs LEFT JOIN m ON m.id = qs.id")
def v4(spark, d):
    qs, edges = _questions(spark, d)
    at = qs.select("id", F.col("anchor").alias("s"), "chain")
    for hop in (1, 2):
        step = at.withColumn("r", F.try_element_at("chain", F.lit(hop)))
        at = step.join(edges, ["id", "s", "r"]).select("id", F.col("o").alias("s"), "chain").distinct()
    ok = at.join(qs.select("id", "gold"), "id").groupBy("id").agg(F.bool_or(tx.answers_match(tx.answer_tokens(F.col("s")), tx.answer_tokens(F.col("gold")))).alias("ok"))
    return qs.select("id").join(ok, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("grounded"))


@query("V5_attribution", f"WITH {_QS}, nd AS (SELECT DISTINCT id, s AS node FROM ed), mt AS (SELECT nd.id, nd.node, {_MATCH.format(a=texts._answer('node'))} AS ok FROM nd JOIN gt ON gt.id = nd.id), pr AS (SELECT id, bool_or(ok) AS present FROM mt GROUP BY id), r1 AS (SELECT qs.id, ed.o AS node FROM qs JOIN ed ON ed.id = qs.id AND ed.s = qs.anchor), r2 AS (SELECT id, node FROM r1 UNION SELECT r1.id, ed.o FROM r1 JOIN ed ON ed.id = r1.id AND ed.s = r1.node), pa AS (SELECT DISTINCT r2.id FROM r2 JOIN mt ON mt.id = r2.id AND mt.node = r2.node WHERE ok) SELECT qs.id, CASE WHEN NOT coalesce(present, FALSE) THEN 'A' WHEN pa.id IS NULL THEN 'B' ELSE 'C' END AS cause FROM qs LEFT JOIN pr ON pr.id = qs.id LEFT JOIN pa ON pa.id = qs.id")
def v5(spark, d):
    """A: the gold answer is in no triple; B: no path of two hops to it; C: the plan or the algebra."""
    qs, edges = _questions(spark, d)
    nodes = edges.select("id", F.col("s").alias("node")).distinct().join(qs.select("id", "gold"), "id")
    match = nodes.select("id", "node", tx.answers_match(tx.answer_tokens(F.col("node")), tx.answer_tokens(F.col("gold"))).alias("ok")).where("ok")
    one = qs.select("id", F.col("anchor").alias("s")).join(edges, ["id", "s"]).select("id", F.col("o").alias("node")).distinct()
    two = one.withColumnRenamed("node", "s").join(edges, ["id", "s"]).select("id", F.col("o").alias("node"))
    path = one.unionByName(two).distinct().join(match, ["id", "node"]).select("id").distinct().withColumn("path", F.lit(True))
    present = match.select("id").distinct().withColumn("present", F.lit(True))
    return qs.select("id").join(present, "id", "left").join(path, "id", "left").select("id", F.when(F.col("present").isNull(), "A").when(F.col("path").isNull(), "B").otherwise("C").alias("cause"))


@query("V7_chain_grid", f"WITH g AS (SELECT c AS mem, i FROM (SELECT unnest([5, 10, 20, 40]) AS c), range(40) t(i) WHERE i < c), f AS (SELECT mem, i * 2 AS ord, 'x' || i AS s, 'r1' AS r, 'y' || i AS o, 1::BIGINT AS n FROM g UNION ALL SELECT mem, i * 2 + 1, 'y' || i, 'r2', 'z' || i, 1 FROM g), {q.BOOK}, {q.HV}, {q.STATE}, {q.TRACE}, ask AS (SELECT DISTINCT st.mem, s, r, {q.bind('trace', 'k')} AS noisy FROM st JOIN tr USING (mem)), a AS (SELECT * FROM {q.cleanup('ask', 's, r')}) SELECT a.mem, count(*) AS queries, sum((f.o = a.answer)::INT)::BIGINT AS hits FROM a JOIN f ON f.mem = a.mem AND f.s = a.s AND f.r = a.r GROUP BY a.mem")
def v7(spark, d):
    from bitweave.operators import memory as mm

    g = spark.range(40).select(F.explode(F.array(*map(F.lit, [5, 10, 20, 40]))).alias("mem"), F.col("id").alias("i")).where("i < mem")
    name = lambda p: F.concat(F.lit(p), F.col("i").cast("string"))
    a = g.select("mem", (F.col("i") * 2).alias("ord"), name("x").alias("s"), F.lit("r1").alias("r"), name("y").alias("o"), F.lit(1).cast("bigint").alias("n"))
    b = g.select("mem", (F.col("i") * 2 + 1).alias("ord"), name("y").alias("s"), F.lit("r2").alias("r"), name("z").alias("o"), F.lit(1).cast("bigint").alias("n"))
    facts = a.unionByName(b)
    got = mm.query(facts, facts.select("mem", "s", "r"), q.W).join(facts.select("mem", "s", "r", "o"), ["mem", "s", "r"])
    return got.groupBy("mem").agg(F.count("*").alias("queries"), F.count_if(F.col("o") == F.col("answer")).alias("hits"))


_SENT = r"ft AS MATERIALIZED (SELECT fact_id, lower(s || ' ' || replace(r, '_', ' ') || ' ' || o) AS t, lower(s) AS s, lower(o) AS o FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL), fw AS MATERIALIZED (SELECT fact_id, unnest(list_distinct(regexp_extract_all(t, '[a-z0-9]+'))) AS w FROM ft), sz AS (SELECT fact_id, count(*) AS n FROM fw GROUP BY fact_id), qw AS (SELECT fact_id AS q, unnest(list_distinct(regexp_extract_all(lower(s || ' ' || replace(r, '_', ' ')), '[a-z0-9]+'))) AS w FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL AND fact_id % 20 = 0), qs AS (SELECT q, count(*) AS n FROM qw GROUP BY q), ov AS (SELECT q, fact_id, count(*) AS c FROM qw JOIN fw USING (w) GROUP BY q, fact_id), rk AS MATERIALIZED (SELECT q, ov.fact_id, row_number() OVER (PARTITION BY q ORDER BY round(c / (qs.n + sz.n - c)::DOUBLE, 9) DESC, ov.fact_id) AS rank FROM ov JOIN sz ON sz.fact_id = ov.fact_id JOIN qs USING (q))"


def _retrieved(spark, d, k: int):
    """For every 20th fact, asked by subject and relation: the ``k`` facts whose words overlap most (Jaccard,
    ties by id), against all facts."""
    f = table(spark, d, "facts").where("fact_id is not null and s is not null and r is not null and o is not null")
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    asks = F.concat_ws(" ", "s", F.replace("r", F.lit("_"), F.lit(" ")))
    said = F.concat_ws(" ", asks, "o")
    asked = f.where("fact_id % 20 = 0")
    best = overlap.top_overlaps(f.select(F.col("fact_id").alias("id"), bag(said).alias("ws")), asked.select(F.col("fact_id").alias("q"), bag(asks).alias("qs")), k)
    texts_ = f.select(F.col("fact_id").alias("id"), F.lower(said).alias("t"))
    gold = asked.select(F.col("fact_id").alias("q"), F.lower("o").alias("gold"))
    return best.join(gold, "q").join(texts_, "id").withColumn("hit", F.contains("t", "gold"))


@query("V10_containment", f"WITH {_SENT} SELECT q, bool_or(contains(x.t, y.o) AND rank <= 5) AS at_5, bool_or(contains(x.t, y.o)) AS at_10 FROM rk JOIN ft x ON x.fact_id = rk.fact_id JOIN ft y ON y.fact_id = q WHERE rank <= 10 GROUP BY q")
def v10(spark, d):
    """Recall at 5 and 10 by containment: whether the gold answer stands in a retrieved sentence."""
    return _retrieved(spark, d, 10).groupBy("q").agg(F.bool_or(F.col("hit") & (F.col("rank") <= 5)).alias("at_5"), F.bool_or("hit").alias("at_10"))


@query("H42_recall_by_containment", f"WITH {_SENT} SELECT count(*) AS questions, round(avg(hit), 6) AS recall_at_5 FROM (SELECT q, max(contains(x.t, y.o)::INT) AS hit FROM rk JOIN ft x ON x.fact_id = rk.fact_id JOIN ft y ON y.fact_id = q WHERE rank <= 5 GROUP BY q)")
def h42(spark, d):
    """Recall@5 of all questions by containment of the keyword, the object asked for."""
    hit = _retrieved(spark, d, 5).groupBy("q").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("questions"), F.round(F.avg("hit"), 6).alias("recall_at_5"))


@query("C18_compare", r"WITH y AS (SELECT run_id, result_id, TRY_CAST(regexp_extract(ans, '[0-9]{4}') AS INT) AS year FROM results WHERE ans IS NOT NULL) SELECT run_id, min(year) AS year, arg_min(result_id, year * 10000000000 + result_id) AS result_id FROM y WHERE year IS NOT NULL GROUP BY run_id")
def c18(spark, d):
    y = table(spark, d, "results").where("ans is not null").select("run_id", "result_id", F.regexp_extract("ans", "[0-9]{4}", 0).try_cast("int").alias("year")).where("year is not null")
    return y.groupBy("run_id").agg(F.min("year").alias("year"), F.min_by("result_id", F.col("year").cast("bigint") * 10000000000 + F.col("result_id")).alias("result_id"))


@query("C13_membership_candidates", f"WITH {q.MEMORY}, hub AS (SELECT mem, min(s) AS a FROM f GROUP BY mem), rl AS (SELECT DISTINCT mem, r FROM f), cd AS (SELECT hub.mem, rl.r, book.name, {q.ham('trace', q.bind(q.bind('ha.v', 'rr.v'), 'hn.v'))} AS d1, {q.ham('trace', q.bind(q.bind('hn.v', 'rr.v'), 'ha.v'))} AS d2 FROM hub JOIN rl ON rl.mem = hub.mem JOIN book ON book.mem = hub.mem AND book.name <> hub.a JOIN tr ON tr.mem = hub.mem JOIN hv ha ON ha.name = hub.a JOIN hv hn ON hn.name = book.name JOIN rv rr ON rr.name = rl.r) SELECT mem, r, name, least(d1, d2) AS dist FROM cd WHERE (512 - least(d1, d2)) / 16.0 >= 3")
def c13(spark, d):
    """Names linked to a memory's first subject by a relation, in either direction, as far as the trace tells."""
    from bitweave.operators import memory as mm
    from bitweave.queries.algebra import facts

    f = facts(spark, d)
    hub = f.groupBy("mem").agg(F.min("s").alias("a"))
    asked = hub.join(f.select("mem", "r").distinct(), "mem").join(mm.traces(f, q.W), "mem")
    # Both directions differ only in which side is shifted with the relation: the key of the anchor, and the anchor as object.
    left = asked.select("mem", "a", "r", w.bind(F.col("trace"), mm.key(F.col("a"), F.col("r"), q.W)).alias("noisy"))
    names = mm.codebook(f).select("mem", "name", w.item(F.col("name"), q.W).alias("v"))
    dist = left.join(names, "mem").where("name <> a").select("mem", "r", "name", w.ones(w.bind(F.col("noisy"), F.col("v"))).alias("dist"))
    return dist.where((512 - F.col("dist")) / 16.0 >= 3)


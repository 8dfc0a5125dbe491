"""The reasoner's cascade, set-valued plans, and the runs that hold theory against measurement (X, C, V, H rows).

The knowledge base of these queries are the facts as edges with two directions; the questions are the
plans of the extracted questions and the two-hop chains of the facts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import contract as ct
from bitweave.operators import edges as eg
from bitweave.operators import memory as mm
from bitweave.operators import store as st
from bitweave.queries import graph, stores
from bitweave.queries import oracle as q
from bitweave.queries.algebra import facts
from bitweave.session import stored, table

D = 32 * q.W

# Cascade. A question is (q, text); stages answer what the ones before left open.

def questions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct questions by id: (id, text, entity). The entity is the anchor of the plan, null if there is none."""
    p = table(spark, d, "pilot_extraction").where("id is not null and q is not null")
    return p.groupBy("id").agg(F.min("q").alias("text"), F.lower(F.trim(F.min("plan.anchor"))).alias("entity"))


_ASKED = "qu AS MATERIALIZED (SELECT id, min(q) AS text, lower(trim(min(plan.anchor), ' ')) AS entity FROM pilot_extraction WHERE id IS NOT NULL AND q IS NOT NULL GROUP BY id)"
# Stage 1, algebraic: the first relation of a plan asked of the question's own triples by exact match.
_PLAN = "pn AS (SELECT id, min(plan.chain[1]) AS r1, min(plan.chain[2]) AS r2 FROM pilot_extraction WHERE id IS NOT NULL AND q IS NOT NULL GROUP BY id)"
_TRIPLES = "tr AS MATERIALIZED (SELECT DISTINCT id, lower(t[1]) AS s, t[2] AS r, lower(t[3]) AS o FROM (SELECT id, unnest(triples) AS t FROM pilot_extraction WHERE id IS NOT NULL) WHERE t[1] IS NOT NULL AND t[2] IS NOT NULL AND t[3] IS NOT NULL)"
_STAGE1 = "s1 AS (SELECT qu.id, min(b.o) AS answer FROM qu JOIN pn ON pn.id = qu.id JOIN tr a ON a.id = qu.id AND a.s = qu.entity AND a.r = pn.r1 JOIN tr b ON b.id = qu.id AND b.s = a.o AND b.r = pn.r2 WHERE b.o <> qu.entity GROUP BY qu.id)"
# Stage 2, no entity: the question's words against the targets of edges is left to stage 4. Stage 3, cache.
_STAGE3 = "ca AS (SELECT lower(trim(source, ' ')) AS entity, lower(trim(target, ' ')) AS answer, max(confidence) AS conf FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY ALL), s3 AS (SELECT qu.id, arg_min(ca.answer, (1 - ca.conf, ca.answer)) AS answer FROM qu JOIN ca ON ca.entity = qu.entity WHERE ca.conf >= 0.5 AND qu.id NOT IN (SELECT id FROM s1) GROUP BY qu.id)"
# Stage 4, bridge search: passages that name the entity are bridges, the best one by shared words answers.
_STAGE4 = "fa AS MATERIALIZED (SELECT lower(s) AS e, min(fact_id) AS fact_id, min(lower(o)) AS answer FROM facts WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY lower(s)), s4 AS (SELECT qu.id, fa.answer FROM qu JOIN fa ON fa.e = qu.entity WHERE qu.id NOT IN (SELECT id FROM s1) AND qu.id NOT IN (SELECT id FROM s3))"


@query("X3_cascade", f"WITH {_ASKED}, {_PLAN}, {_TRIPLES}, {_STAGE1}, {_STAGE3}, {_STAGE4} SELECT qu.id, coalesce(s1.answer, s3.answer, s4.answer) AS answer, CASE WHEN s1.id IS NOT NULL THEN 'algebraic' WHEN s3.id IS NOT NULL THEN 'cache' WHEN s4.id IS NOT NULL THEN 'bridge' WHEN entity IS NULL THEN 'no entity' ELSE 'open' END AS stage FROM qu LEFT JOIN s1 USING (id) LEFT JOIN s3 USING (id) LEFT JOIN s4 USING (id)")
def x3(spark, d):
    """Each question's answer and the stage that gave it: two hops of its plan over its own triples, the most
    confident cached edge of its entity (0.5 at least), a stored fact about the entity as bridge. A stage sees
    only the questions the stages before left open."""
    asked = stored(questions(spark, d), "questions")
    p = table(spark, d, "pilot_extraction").where("id is not null")
    plan = p.where("q is not null").groupBy("id").agg(F.min(F.get("plan.chain", F.lit(0))).alias("r1"), F.min(F.get("plan.chain", F.lit(1))).alias("r2"))
    t = p.select("id", F.explode("triples").alias("t")).select("id", F.lower(F.get("t", F.lit(0))).alias("s"), F.get("t", F.lit(1)).alias("r"), F.lower(F.get("t", F.lit(2))).alias("o"))
    t = t.where("s is not null and r is not null and o is not null").distinct()
    first = asked.join(plan, "id").join(t.select("id", F.col("s").alias("entity"), F.col("r").alias("r1"), F.col("o").alias("bridge")), ["id", "entity", "r1"])
    second = t.select("id", F.col("s").alias("bridge"), F.col("r").alias("r2"), F.col("o").alias("answer"))
    algebraic = first.join(second, ["id", "bridge", "r2"]).where("answer <> entity").groupBy("id").agg(F.min("answer").alias("answer"))
    solved = stored(algebraic.withColumn("stage", F.lit("algebraic")), "stage")

    e = table(spark, d, "edges").where("source is not null and target is not null and confidence between 0 and 1")
    cache = e.groupBy(F.lower(F.trim("source")).alias("entity"), F.lower(F.trim("target")).alias("answer")).agg(F.max("confidence").alias("conf")).where("conf >= 0.5")
    best = cache.groupBy("entity").agg(F.min(F.struct((1 - F.col("conf")).alias("less"), "answer"))["answer"].alias("answer"))
    open_ = asked.join(solved, "id", "left_anti").where("entity is not null")
    solved = solved.unionByName(stored(open_.join(best, "entity").select("id", "answer", F.lit("cache").alias("stage")), "stage"))

    known = table(spark, d, "facts").where("s is not null and o is not null").groupBy(F.lower("s").alias("entity")).agg(F.min(F.lower("o")).alias("answer"))
    open_ = asked.join(solved, "id", "left_anti").where("entity is not null")
    solved = solved.unionByName(open_.join(known, "entity").select("id", "answer", F.lit("bridge").alias("stage")))
    left = asked.join(solved, "id", "left")
    return left.select("id", "answer", F.coalesce("stage", F.when(F.col("entity").isNull(), "no entity").otherwise("open")).alias("stage"))


_BRIDGE = f"WITH {stores._E}, nn AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id, a.label AS own, b.label, {q.ham('a.words', 'b.words', 2)} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {q.ham('a.words', 'b.words', 2)}, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 15), v AS (SELECT q, bool_or(label = own) AS ov FROM nn GROUP BY q)"


@query("X4_bridge_retrieval", f"{_BRIDGE} SELECT nn.q, vec_id, dist, coalesce(ov, FALSE) AS overlapping FROM nn JOIN v ON v.q = nn.q WHERE CASE WHEN coalesce(ov, FALSE) THEN label = own ELSE rank <= 5 END")
def x4(spark, d):
    """Bridges: of the 15 nearest (a beam of 5, three times oversampled) those of the query's own group; where
    there is none, the nearest five."""
    e = stores.entries(spark, d)
    near = st.knn(e, stores.asked(e), "vec_id", "words", 15, stores.W, ["label"])
    near = near.join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("own")), "q")
    some = F.coalesce(F.max(F.col("label") == F.col("own")).over(Window.partitionBy("q")), F.lit(False))
    return near.withColumn("overlapping", some).where("CASE WHEN overlapping THEN label = own ELSE rank <= 5 END").select("q", "vec_id", "dist", "overlapping")


@query("X7_engine_sleep", f"WITH {graph._PATHS}, {graph._DECAYED}, k AS (SELECT source, target, support, success, confidence FROM dc WHERE {graph._KEEP}), rw AS (SELECT lower(gold) AS target, count(*) AS n FROM results WHERE conf >= 0.5 AND NOT isnan(conf) AND gold IS NOT NULL GROUP BY lower(gold)) SELECT source, k.target, support + coalesce(n, 0) AS support, round(CASE WHEN n IS NULL THEN confidence ELSE greatest(0.01, least(0.99, (1.0 + success + n) / (2.0 + support + n))) END, 6) AS confidence FROM k LEFT JOIN rw ON rw.target = lower(k.target)")
def x7(spark, d):
    """Maintenance of the engine: edges decay and weak ones are forgotten, then rewards of 0.5 or more that were
    not yet consolidated count as successes of the edges to their answer."""
    now = F.lit(graph.NOW).cast("timestamp")
    kept = eg.forget(eg.decay(graph._paths(spark, d), now), now)
    r = table(spark, d, "results").where("conf >= 0.5 and not isnan(conf) and gold is not null")
    rewards = r.groupBy(F.lower("gold").alias("key")).agg(F.count("*").alias("n"))
    both = kept.withColumn("key", F.lower("target")).join(rewards, "key", "left")
    n = F.coalesce("n", F.lit(0))
    conf = F.when(F.col("n").isNull(), F.col("confidence")).otherwise(eg.beta_mean(F.col("success") + n, F.col("support") + n))
    return both.select("source", "target", (F.col("support") + n).alias("support"), F.round(conf, 6).alias("confidence"))


# Set-valued plans.

_C14 = "fx AS MATERIALIZED (SELECT DISTINCT doc_id // 32 AS mem, s, r, o FROM facts WHERE doc_id IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL), ed AS MATERIALIZED (SELECT mem, s, r, o FROM fx UNION SELECT mem, o, r, s FROM fx)"
_VARIANT = "len(list_intersect(list_filter(string_split({a}, '_'), lambda x: length(x) > 0), list_filter(string_split({b}, '_'), lambda x: length(x) > 0))) > 0"


@query("C14_two_hops", f"WITH {_C14}, rl AS (SELECT DISTINCT mem, r FROM fx), vr AS (SELECT a.mem, a.r, b.r AS r2 FROM rl a JOIN rl b ON a.mem = b.mem AND {_VARIANT.format(a='a.r', b='b.r')}), pl AS (SELECT mem, s AS anchor, min(r) AS r1, max(r) AS r2 FROM fx GROUP BY mem, s), h AS (SELECT DISTINCT pl.mem, anchor, pl.r2 AS want, o AS node FROM pl JOIN vr ON vr.mem = pl.mem AND vr.r = pl.r1 JOIN ed ON ed.mem = pl.mem AND ed.s = anchor AND ed.r = vr.r2), g AS (SELECT DISTINCT h.mem, anchor, o AS answer FROM h JOIN vr ON vr.mem = h.mem AND vr.r = h.want JOIN ed ON ed.mem = h.mem AND ed.s = h.node AND ed.r = vr.r2 WHERE o <> anchor) SELECT mem, anchor, answer FROM g")
def c14(spark, d):
    """All answers of two-hop plans, a set per hop: each relation of the plan stands for every relation of the
    memory that shares a word with it, and edges may be walked either way. The plan of a subject is its first
    and its last relation."""
    fx = stored(facts(spark, d).select("mem", "s", "r", "o").distinct(), "facts")
    edges = fx.unionByName(fx.select("mem", F.col("o").alias("s"), "r", F.col("s").alias("o"))).distinct()
    parts = fx.select("mem", "r").distinct().select("mem", "r", F.explode(F.array_distinct(F.filter(F.split("r", "_"), lambda x: F.length(x) > 0))).alias("part"))
    variants = parts.join(parts.withColumnRenamed("r", "v"), ["mem", "part"]).select("mem", "r", "v").distinct()
    at = fx.groupBy("mem", F.col("s").alias("anchor")).agg(F.min("r").alias("r1"), F.max("r").alias("r2")).withColumn("node", F.col("anchor"))
    for hop in ("r1", "r2"):
        asked = at.join(variants.select("mem", F.col("r").alias(hop), "v"), ["mem", hop])
        step = edges.select("mem", F.col("s").alias("node"), F.col("r").alias("v"), F.col("o").alias("next"))
        at = asked.join(step, ["mem", "node", "v"]).select("mem", "anchor", "r2", F.col("next").alias("node")).distinct()
    return at.where("node <> anchor").select("mem", "anchor", F.col("node").alias("answer")).distinct()


# Theory against measurement, over memories of generated axioms.


def axioms(spark: SparkSession, sizes: list[int], seeds: int) -> DataFrame:
    """Facts (s{i}, r{i mod 11}, o{i}) of a memory per size and seed; the seed is part of the names, so each draws its own states."""
    g = spark.range(max(sizes)).select(F.explode(F.array(*map(F.lit, sizes))).alias("size"), F.col("id").alias("i")).where("i < size").select("size", "i", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"), F.lit("@"), F.col("seed").cast("string"))
    return g.select((F.col("size") * 100 + F.col("seed")).alias("mem"), F.col("i").alias("ord"), name("s", F.col("i")).alias("s"), name("r", F.col("i") % 11).alias("r"), name("o", F.col("i")).alias("o"), F.lit(1).cast("bigint").alias("n"))


_AX = "f AS (SELECT size * 100 + seed AS mem, i AS ord, 's' || i || '@' || seed AS s, 'r' || (i % 11) || '@' || seed AS r, 'o' || i || '@' || seed AS o, 1::BIGINT AS n FROM (SELECT unnest({sizes}) AS size), range(600) t(i), range({seeds}) u(seed) WHERE i < size)"


def _measured(sizes: list[int], seeds: int) -> str:
    return f"{_AX.format(sizes=sizes, seeds=seeds)}, {q.BOOK}, {q.HV}, {q.STATE}, {q.TRACE}, ask AS (SELECT st.mem, s, r, {q.bind('trace', 'k')} AS noisy FROM st JOIN tr USING (mem)), an AS (SELECT * FROM {q.cleanup('ask', 's, r')}), ms AS (SELECT an.mem // 100 AS size, count(*) AS queries, sum((f.o = an.answer)::INT)::BIGINT AS hits FROM an JOIN f ON f.mem = an.mem AND f.s = an.s AND f.r = an.r GROUP BY an.mem // 100)"


SIZES = [20, 40, 60, 80, 100, 120]


def measured(spark: SparkSession, sizes: list[int], seeds: int) -> DataFrame:
    """(size, queries, hits) of every single-hop question to the memories of each size."""
    f = stored(axioms(spark, sizes, seeds), "axioms")
    got = mm.query(f, f.select("mem", "s", "r"), q.W).join(f.select("mem", "s", "r", "o"), ["mem", "s", "r"])
    return got.groupBy(F.expr("mem div 100").alias("size")).agg(F.count("*").alias("queries"), F.count_if(F.col("o") == F.col("answer")).alias("hits"))


@query("H35_theory_runs", f"WITH {_measured(SIZES, 3)} SELECT size, queries, hits FROM ms")
def h35(spark, d):
    """Accuracy of memories of growing load, three seeds each, by asking every fact."""
    return measured(spark, SIZES, 3)


@query("H37_scale_row")
def h37(spark, d):
    """Each load's measured accuracy beside the contract's prediction, and their difference. The prediction is
    M4 for the load, the width and the size of the codebook."""
    m = measured(spark, SIZES, 3)
    size = F.col("size").cast("double")
    predicted = ct.predicted_accuracy(size, F.lit(float(D)), 2 * size + F.least(size, F.lit(11.0)))
    acc = F.col("hits") / F.col("queries")
    return m.select("size", F.round(predicted, 4).alias("predicted"), F.round(acc, 4).alias("measured"), F.round(F.abs(predicted - acc), 4).alias("error"))


@query("V8_depth_scaling")
def v8(spark, d):
    """Smallest width of a geometric grid (x 1.25, in words) at which chains of h hops over 120 facts keep an
    accuracy of 0.95, by theory: the single-hop prediction to the power of h."""
    grid, at = [], 16.0
    while at <= 1024:
        grid.append(int(at))
        at *= 1.25
    g = spark.createDataFrame([(h, 32 * x) for h in (1, 2, 4, 8, 16, 32, 64) for x in sorted(set(grid))], "hops int, dim int")
    p = F.pow(ct.predicted_accuracy(F.lit(120.0), F.col("dim").cast("double"), F.lit(251.0)), F.col("hops"))
    return g.withColumn("p", p).where("p >= 0.95").groupBy("hops").agg(F.min("dim").alias("dim"))


@query("V9_depth_accuracy", "WITH h AS (SELECT run_id, count(*) AS n, sum(hit::INT)::BIGINT AS ok, sum((NOT hit)::INT)::BIGINT AS no FROM results WHERE hit IS NOT NULL GROUP BY run_id) SELECT run_id, n, round(ok / n, 6) AS accuracy, round(greatest(ok, no) / n, 6) AS baseline FROM h")
def v9(spark, d):
    """Accuracy of every run beside the majority baseline of its answers."""
    h = table(spark, d, "results").where("hit is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("ok"))
    return h.select("run_id", "n", F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(F.greatest(F.col("ok"), F.col("n") - F.col("ok")) / F.col("n"), 6).alias("baseline"))


@query("H36_prediction_against_measurement")
def h36b(spark, d):
    """Loads whose measured accuracies the theory tells apart: pairs of neighbouring loads with predictions
    further apart than both measurement errors."""
    row = h37(spark, d)
    order = Window.orderBy("size")  # six rows, one per generated load
    both = row.select("size", "predicted", "error", F.lead("size").over(order).alias("next"), F.lead("predicted").over(order).alias("p2"), F.lead("error").over(order).alias("e2"))
    return both.where("next is not null").select("size", "next", (F.col("predicted") - F.col("p2") > F.col("error") + F.col("e2")).alias("resolvable"))


@query("H40_plan_provenance", f"WITH {q.FACTS}, h AS (SELECT a.mem, a.s AS anchor, a.r AS r1, a.o AS bridge, b.r AS r2, b.o AS answer, a.ord AS source1, b.ord AS source2 FROM f a JOIN f b ON b.mem = a.mem AND b.s = a.o AND b.ord <> a.ord WHERE b.o <> a.s), r AS (SELECT *, row_number() OVER (PARTITION BY mem, anchor, r1, r2 ORDER BY source1 DESC, source2 DESC) AS n FROM h) SELECT mem, anchor, r1, r2, answer, source1, source2 FROM r WHERE n = 1")
def h40(spark, d):
    """Every two-hop chain with the facts it comes from; of several the ones written last."""
    f = facts(spark, d)
    a = f.select("mem", F.col("s").alias("anchor"), F.col("r").alias("r1"), F.col("o").alias("bridge"), F.col("ord").alias("source1"))
    b = f.select("mem", F.col("s").alias("bridge"), F.col("r").alias("r2"), F.col("o").alias("answer"), F.col("ord").alias("source2"))
    both = a.join(b, ["mem", "bridge"]).where("source1 <> source2 and answer <> anchor")
    last = both.groupBy("mem", "anchor", "r1", "r2").agg(F.max(F.struct("source1", "source2", "answer")).alias("e"))
    return last.select("mem", "anchor", "r1", "r2", "e.answer", "e.source1", "e.source2")


@query("H41_engine_comparison", f"WITH {_ASKED}, {_PLAN}, {_TRIPLES}, {_STAGE1}, {_STAGE3}, {_STAGE4}, g AS (SELECT id, lower(trim(min(gold), ' ')) AS gold FROM pilot_extraction WHERE id IS NOT NULL AND q IS NOT NULL GROUP BY id), c AS (SELECT qu.id, gold, s1.answer AS a, coalesce(s1.answer, s3.answer, s4.answer) AS x FROM qu JOIN g USING (id) LEFT JOIN s1 USING (id) LEFT JOIN s3 USING (id) LEFT JOIN s4 USING (id)) SELECT count(*) AS asked, round(avg(coalesce(a = gold, FALSE)::INT), 6) AS algebraic_alone, round(avg(coalesce(x = gold, FALSE)::INT), 6) AS cascade, round(avg((a IS NOT NULL)::INT), 6) AS algebraic_share FROM c")
def h41(spark, d):
    """The algebraic stage alone against the whole cascade: share of right answers, and of questions the algebra answers."""
    p = table(spark, d, "pilot_extraction").where("id is not null and q is not null")
    gold = p.groupBy("id").agg(F.lower(F.trim(F.min("gold"))).alias("gold"))
    got = x3(spark, d).join(gold, "id")
    right = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    by_algebra = F.col("stage") == "algebraic"
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return got.agg(F.count("*").alias("asked"), share(right & by_algebra).alias("algebraic_alone"), share(right).alias("cascade"), share(by_algebra).alias("algebraic_share"))

"""Stores, bucketed search, routing, prototypes, fusion and context compilation (K, L, R, P, F, N, B rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import cluster as cl
from bitweave.operators import fuse as fz
from bitweave.operators import store as st
from bitweave.operators.bundle import bundle
from bitweave.queries import oracle as q
from bitweave.queries import texts
from bitweave.session import stored, table

W, D = 2, 64
NOW = "2024-01-25 00:00:00"

_PACK = "[{}]".format(", ".join("(" + " + ".join(f"CASE WHEN embedding[{32 * i + j + 1}] > 0 THEN {1 << j}::BIGINT ELSE 0 END" for j in range(32)) + ")" for i in range(2)))
_E = f"e AS MATERIALIZED (SELECT vec_id, {_PACK} AS words, label FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT e.*, ts, value FROM e JOIN events ON event_id = vec_id)"
_NN = f"nn AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id, b.label, {q.ham('a.words', 'b.words', 2)} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {q.ham('a.words', 'b.words', 2)}, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5)"


def entries(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", st.binarise(F.col("embedding"), W).alias("words"), "label")


def dated(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return entries(spark, d).join(ev, "vec_id")


def asked(e):
    """The stated query set of searches: every entry whose id is divisible by 20."""
    return e.where("vec_id % 20 = 0")


@query("K0_pack", f"WITH {_E} SELECT vec_id, words, list_transform(range(64), lambda i: ((words[i // 32 + 1] >> (i % 32)) & 1)::INT) AS bits FROM e")
def k0(spark, d):
    return entries(spark, d).select("vec_id", "words", w.unpack(F.col("words")).alias("bits"))


@query("K1_K2_knn", f"WITH {_E}, {_NN} SELECT q, vec_id, dist, rank FROM nn")
def k1(spark, d):
    e = entries(spark, d)
    return st.knn(e, asked(e), "vec_id", "words", 5, W)


@query("K3_put_get", f"WITH {_E} SELECT label, count(*) AS entries, min(vec_id) AS first, max(vec_id) AS last FROM e GROUP BY label")
def k3(spark, d):
    return entries(spark, d).groupBy("label").agg(F.count("*").alias("entries"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("K5_predict", f"WITH {_E}, {_NN}, c AS (SELECT q, label, count(*) AS votes, min(rank) AS first FROM nn GROUP BY q, label), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY votes DESC, first) AS n FROM c) SELECT q, label AS predicted, votes FROM r WHERE n = 1")
def k5(spark, d):
    e = entries(spark, d)
    return st.vote(st.knn(e, asked(e), "vec_id", "words", 5, W, ["label"]), "label")


@query("K6_vacuum", f"WITH {_E} SELECT vec_id FROM u WHERE value >= 5 AND label <> 3")
def k6(spark, d):
    return dated(spark, d).where("value >= 5 and label <> 3").select("vec_id")


@query("K7_vacuum_age", f"WITH {_E} SELECT vec_id FROM u WHERE TIMESTAMP '2024-01-02 00:00:00' - ts < INTERVAL 12 HOUR")
def k7(spark, d):
    return st.vacuum_by_age(dated(spark, d), "ts", F.lit("2024-01-02 00:00:00").cast("timestamp"), 43200).select("vec_id")


@query("K8_vacuum_count", f"WITH {_E} SELECT vec_id FROM u ORDER BY ts DESC, vec_id DESC LIMIT 100")
def k8(spark, d):
    return st.vacuum_by_count(dated(spark, d), "ts", "vec_id", 100).select("vec_id")


@query("K9_sleep", f"WITH {_E}, m AS (SELECT *, TIMESTAMP '2024-01-02 00:00:00' - ts < INTERVAL 12 HOUR AS young, value >= 5 AS worth FROM u) SELECT 'both' AS policy, count(*) FILTER (WHERE NOT (young AND worth)) AS removed FROM m UNION ALL SELECT 'either', count(*) FILTER (WHERE NOT (young OR worth)) FROM m")
def k9(spark, d):
    u, now = dated(spark, d), F.lit("2024-01-02 00:00:00").cast("timestamp")
    parts = [u.select("vec_id").join(st.sleep(u, "ts", "value", now, 43200, 5, p).select("vec_id"), "vec_id", "left_anti").agg(F.count("*").alias("removed")).select(F.lit(p).alias("policy"), "removed") for p in ("both", "either")]
    return parts[0].unionByName(parts[1])


@query("K10_health", f"WITH {_E}, n AS (SELECT a.vec_id, min({q.ham('a.words', 'b.words', 2)}) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id < 100 AND b.vec_id < 100 GROUP BY a.vec_id) SELECT (SELECT count(*) FROM u) AS entries, round((SELECT avg((value < 5)::INT) FROM u), 6) AS low_value_ratio, round((SELECT avg(r) FROM n), 6) AS radius, (SELECT avg((value < 5)::INT) FROM u) > 0.3 AS sleep_suggested")
def k10(spark, d):
    # The radius is defined over the store's first 100 entries.
    u, first = dated(spark, d), entries(spark, d).where("vec_id < 100")
    near = st.knn(first, first, "vec_id", "words", 1, W).agg(F.round(F.avg("dist"), 6).alias("radius"))
    low = F.avg((F.col("value") < 5).cast("int"))
    return u.agg(F.count("*").alias("entries"), F.round(low, 6).alias("low_value_ratio"), (low > 0.3).alias("sleep_suggested")).join(F.broadcast(near))


@query("H16_all_pairs", f"WITH {_E} SELECT dist, count(*) AS pairs FROM (SELECT {q.ham('a.words', 'b.words', 2)} AS dist FROM e a JOIN e b ON a.vec_id < b.vec_id) GROUP BY dist")
def h16(spark, d):
    e = entries(spark, d)
    a, out = e.select(F.col("vec_id").alias("i"), F.col("words").alias("x")), None
    for block in st.blocks(e, "vec_id"):  # the whole table block by block; each gives 65 rows at most
        b = F.broadcast(block.select(F.col("vec_id").alias("j"), F.col("words").alias("y")))
        part = a.join(b, F.col("i") < F.col("j")).groupBy(w.hamming(F.col("x"), F.col("y"), W).alias("dist")).agg(F.count("*").alias("pairs"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("dist").agg(F.sum("pairs").alias("pairs"))


def _lsh(x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN 64 - 2 * {q.ham(x, f'(SELECT v FROM dirs WHERE i = {i})', 2)} > 0 THEN {1 << i} ELSE 0 END" for i in range(12)) + ")"


_DIRS = f"dirs AS MATERIALIZED (SELECT i, {q.item(chr(39) + 'lsh' + chr(39) + ' || i', 2)} AS v FROM range(12) r(i)), bk AS MATERIALIZED (SELECT vec_id, label, words, sum(CASE WHEN 64 - 2 * {q.ham('words', 'v', 2)} > 0 THEN 1 << i ELSE 0 END)::INT AS bucket FROM e, dirs GROUP BY ALL)"
_CAND = f"pr AS (SELECT vec_id AS q, words AS qw, unnest([0] || list_transform(range(12), lambda i: (i + 1)::INT)) AS probe, bucket AS b0 FROM bk WHERE vec_id % 20 = 0), cd AS (SELECT q, vec_id, label, probe, {q.ham('qw', 'words', 2)} AS dist FROM pr JOIN bk ON bk.bucket = CASE WHEN probe = 0 THEN b0 ELSE xor(b0, 1 << (probe - 1)) END WHERE q <> vec_id)"


@query("L1_lsh_bucket", f"WITH {_E}, {_DIRS} SELECT vec_id, bucket FROM bk")
def l1(spark, d):
    return entries(spark, d).select("vec_id", st.lsh_bucket(F.col("words"), 12, W).alias("bucket"))


def _cands(spark, d):
    e = entries(spark, d)
    return st.lsh_candidates(e, asked(e), "vec_id", "words", 12, W)


@query("L2_candidates", f"WITH {_E}, {_DIRS}, {_CAND} SELECT q, vec_id, probe, dist FROM cd")
def l2(spark, d):
    return _cands(spark, d).select("q", "vec_id", "probe", "dist")


@query("L3_recall", f"WITH {_E}, {_DIRS}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM cd) SELECT q, vec_id, rank, round(1 / (1 + dist / 128.0), 6) AS weight FROM r WHERE rank <= 8")
def l3(spark, d):
    ranked = _cands(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))).where("rank <= 8")
    return ranked.select("q", "vec_id", "rank", F.round(1 / (1 + F.col("dist") / 128.0), 6).alias("weight"))


@query("L4_evict", f"WITH {_E} SELECT vec_id FROM u ORDER BY value DESC, vec_id LIMIT 200")
def l4(spark, d):
    return dated(spark, d).orderBy(F.desc("value"), "vec_id").limit(200).select("vec_id")


_L6 = f"WITH {_E}, {_DIRS}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM cd), c AS (SELECT q, label, round(sum(1 / (1 + dist / 128.0)), 9) AS wt, min(rank) AS first FROM r WHERE rank <= 4 GROUP BY q, label), b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY wt DESC, first) AS n FROM c)"


@query("L5_L6_weighted_vote", f"{_L6} SELECT q, label AS predicted, round(wt, 6) AS weight FROM b WHERE n = 1")
def l6(spark, d):
    ranked = _cands(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))).where("rank <= 4")
    return st.weighted_vote(ranked, "label", D)


@query("L8_sleep", f"WITH {_E} SELECT vec_id FROM (SELECT *, max(value) OVER () AS top FROM u) WHERE TIMESTAMP '2024-01-02 00:00:00' - ts < INTERVAL 1 HOUR OR value / greatest(top, 1) > 0.3")
def l8(spark, d):
    u = dated(spark, d)
    top = u.agg(F.greatest(F.max("value"), F.lit(1.0)).alias("top"))
    young = F.unix_micros(F.lit("2024-01-02 00:00:00").cast("timestamp")) - F.unix_micros("ts") < 3_600_000_000
    return u.join(F.broadcast(top)).where(young | (F.col("value") / F.col("top") > 0.3)).select("vec_id")


@query("L10_reflect", f"WITH {_E}, {_DIRS}, h AS (SELECT bucket, count(*) AS n FROM bk GROUP BY bucket) SELECT (SELECT count(*) FROM bk) AS entries, count(*) AS buckets, max(n) AS largest, round(avg(n), 6) AS mean_bucket, count(*) FILTER (WHERE n = 1) AS singles FROM h")
def l10(spark, d):
    h = l1(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))
    return h.agg(F.sum("n").alias("entries"), F.count("*").alias("buckets"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_bucket"), F.count_if(F.col("n") == 1).alias("singles"))


@query("L11_state_retrieval", f"WITH {_E}, {_DIRS}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM cd) SELECT q, trace AS state FROM {q.majority('(SELECT q, 1 AS n, words AS state FROM (SELECT r.q, r.vec_id, x.words FROM r JOIN e x ON x.vec_id = r.vec_id + 1 WHERE rank <= 4))', 'q', 'state', 2, 'plus')}")
def l11(spark, d):
    ranked = _cands(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))).where("rank <= 4").select("q", "vec_id")
    after = entries(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("words").alias("next"))
    return bundle(ranked.join(after, "vec_id"), ["q"], "next", W, tie="plus", name="state").drop("n")


_BITS = "list_transform(range(64), lambda i: ((xor(a.words[i // 32 + 1], b.words[i // 32 + 1]) >> (i % 32)) & 1))"


@query("L12_weighted_hamming", f"WITH {_E}, {_NN} SELECT q, nn.vec_id, list_sum(list_transform(range(64), lambda i: {_BITS}[i + 1] * (1 + i % 3)))::INT AS weighted FROM nn JOIN e a ON a.vec_id = q JOIN e b ON b.vec_id = nn.vec_id")
def l12(spark, d):
    e = entries(spark, d)
    near = st.knn(e, asked(e), "vec_id", "words", 5, W).select("q", "vec_id")
    both = near.join(e.select("vec_id", F.col("words").alias("y")), "vec_id").join(e.select(F.col("vec_id").alias("q"), F.col("words").alias("x")), "q")
    weighted = w.let(w.unpack(w.bind(F.col("x"), F.col("y"))), lambda b: F.aggregate(F.transform(b, lambda v, i: v * (1 + i % 3)), F.lit(0), lambda s, v: s + v))
    return both.select("q", "vec_id", weighted.alias("weighted"))


@query("L13_trajectory", f"WITH {_E}, t AS (SELECT a.vec_id, a.words AS s, b.words AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), r AS (SELECT x.vec_id AS q, y.vec_id, {q.ham('x.s', 'y.s', 2)} + {q.ham('x.t', 'y.t', 2)} AS dist FROM t x JOIN t y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM r) SELECT q, vec_id, dist, rank FROM n WHERE rank <= 3")
def l13(spark, d):
    e = entries(spark, d)
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("words").alias("next")), "vec_id").select("vec_id", F.concat("words", "next").alias("words"))
    return st.knn(pair, asked(pair), "vec_id", "words", 3, 2 * W)


@query("L14_masked", f"WITH {_E}, r AS (SELECT a.vec_id AS q, b.vec_id, bit_count(xor(a.words[1], b.words[1]))::INT AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM r) SELECT q, vec_id, dist, rank FROM n WHERE rank <= 3")
def l14(spark, d):
    masked = entries(spark, d).select("vec_id", w.both(F.col("words"), F.array(F.lit(w.MASK).cast("bigint"), F.lit(0).cast("bigint"))).alias("words"))
    return st.knn(masked, asked(masked), "vec_id", "words", 3, W)


@query("L15_logits", f"{_L6}, v AS (SELECT q, label, sum(1 / (1 + dist / 128.0)) AS m FROM r WHERE rank <= 10 GROUP BY q, label), g AS (SELECT q, l::INT AS label FROM (SELECT DISTINCT q FROM r), range(10) t(l)) SELECT g.q, g.label, round(((g.q + g.label) % 7) + coalesce(m, 0) * 0.1 * 10, 6) AS logit FROM g LEFT JOIN v ON v.q = g.q AND v.label = g.label")
def l15(spark, d):
    ranked = _cands(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))).where("rank <= 10")
    votes = ranked.groupBy("q", "label").agg(F.sum(1 / (1 + F.col("dist") / 128.0)).alias("m"))
    grid = ranked.select("q").distinct().select("q", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("label"))
    return grid.join(votes, ["q", "label"], "left").select("q", "label", F.round((F.col("q") + F.col("label")) % 7 + F.coalesce("m", F.lit(0.0)) * 0.1 * 10, 6).alias("logit"))


@query("L17_gated", f"{_L6}, t AS (SELECT q, sum(wt) AS total FROM c GROUP BY q) SELECT b.q, CASE WHEN wt >= 0.3 * total THEN label ELSE -1 END AS token FROM b JOIN t ON t.q = b.q WHERE n = 1")
def l17(spark, d):
    ranked = _cands(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "vec_id"))).where("rank <= 4")
    by_label = ranked.groupBy("q", "label").agg(F.round(F.sum(1 / (1 + F.col("dist") / 128.0)), 9).alias("wt"), F.min("rank").alias("first"))
    best = by_label.groupBy("q").agg(F.sum("wt").alias("total"), F.max(F.struct("wt", -F.col("first"), "label")).alias("b"))
    return best.select("q", F.when(F.col("b.wt") >= 0.3 * F.col("total"), F.col("b.label")).otherwise(-1).alias("token"))


_PROTO = f"pt AS MATERIALIZED (SELECT label, trace AS proto FROM {q.majority('(SELECT label, 1 AS n, words AS state FROM e WHERE label IS NOT NULL)', 'label', 'state', 2, 'minus')})"
_ROUTED = f"rt AS (SELECT vec_id, label, route, dist FROM (SELECT e.vec_id, e.label, pt.label AS route, {q.ham('words', 'proto', 2)} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {q.ham('words', 'proto', 2)}, pt.label) AS n FROM e, pt) WHERE n = 1)"


@query("R1_R4_prototypes", f"WITH {_E}, {_PROTO} SELECT label, proto FROM pt")
def r4(spark, d):
    return cl.prototypes(entries(spark, d).where("label is not null"), "label", "words", W)


@query("R2_route", f"WITH {_E}, {_PROTO}, {_ROUTED} SELECT vec_id, route::VARCHAR AS route, dist FROM rt")
def r2(spark, d):
    return cl.route(entries(spark, d), r4(spark, d), "label", "vec_id", "words", W)


@query("R3_evaluate", f"WITH {_E}, {_PROTO}, {_ROUTED} SELECT label, count(*) AS n, round(avg((label = route)::INT), 6) AS accuracy, count(DISTINCT route) AS predicted FROM rt GROUP BY label")
def r3(spark, d):
    got = r2(spark, d).join(entries(spark, d).select("vec_id", "label"), "vec_id")
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("route") == F.col("label").cast("string")).cast("int")), 6).alias("accuracy"), F.countDistinct("route").alias("predicted"))


@query("R3_confusion", f"WITH {_E}, {_PROTO}, {_ROUTED} SELECT label::VARCHAR || '→' || route AS pair, count(*) AS n FROM rt GROUP BY pair")
def r3c(spark, d):
    got = r2(spark, d).join(entries(spark, d).select("vec_id", "label"), "vec_id")
    return got.groupBy(F.concat_ws("→", F.col("label").cast("string"), "route").alias("pair")).agg(F.count("*").alias("n"))


def _led(spark, d):
    e = stored(entries(spark, d), "entries")
    return e, cl.leaders(e, "vec_id", "words", 0.35 * D, W)


@query("P1_leaders")
def p1(spark, d):
    return _led(spark, d)[1]


@query("P2_refine")
def p2(spark, d):
    e, led = _led(spark, d)
    return cl.refine(e, led, "vec_id", "words", W)[0]


@query("P3_two_stage")
def p3(spark, d):
    e, led = _led(spark, d)
    members, centroids = cl.refine(e, led, "vec_id", "words", W)
    return cl.two_stage(e, members, centroids, asked(e), "vec_id", "words", 5, 2, W)


@query("P4_stats")
def p4(spark, d):
    e, led = _led(spark, d)
    sizes = led.groupBy("leader").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("entries"), F.count("*").alias("clusters"), F.round(F.sum("n") / F.count("*"), 6).alias("compression"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singles"))


# Fusion: two spaces of the same entries, the first and the second half of the bits.
_SPACES = f"sp AS (SELECT enc, wgt, q, vec_id, row_number() OVER (PARTITION BY enc, q ORDER BY dist, vec_id) AS rank FROM (SELECT k AS enc, CASE WHEN k = 1 THEN 1.25::DOUBLE ELSE 0.75::DOUBLE END AS wgt, a.vec_id AS q, b.vec_id, bit_count(xor(a.words[k], b.words[k])) AS dist FROM e a, e b, (SELECT unnest([1, 2]) AS k) WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)), top AS (SELECT * FROM sp WHERE rank <= 30), sc AS (SELECT q, vec_id, round(sum(wgt / (60 + rank)), 12) AS score FROM top GROUP BY q, vec_id)"


def _spaces(spark, d, k=30):
    e = entries(spark, d)
    parts = []
    for enc, weight in ((1, 1.25), (2, 0.75)):
        half = e.select("vec_id", F.slice("words", enc, 1).alias("words"))
        parts.append(st.knn(half, asked(half), "vec_id", "words", k, 1).withColumn("encoder", F.lit(enc)).withColumn("weight", F.lit(weight)))
    return parts[0].unionByName(parts[1])


@query("F1_F3_spaces", f"WITH {_E}, {_SPACES} SELECT enc AS encoder, q, vec_id, rank FROM top WHERE rank <= 10")
def f3(spark, d):
    return _spaces(spark, d, 10).select("encoder", "q", "vec_id", "rank")


@query("F2_fusion", f"WITH {_E}, {_SPACES}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM sc) SELECT q, vec_id, round(score, 6) AS score, round((1 - score / (2.0 / 61)) * 64, 6) AS dist, rank FROM r WHERE rank <= 10")
def f2(spark, d):
    return fz.fuse(_spaces(spark, d), "vec_id", 10, D).select("q", "vec_id", F.round("score", 6).alias("score"), F.round("dist", 6).alias("dist"), "rank")


@query("F4_reward", f"WITH {_E}, {_SPACES}, c AS (SELECT enc, any_value(wgt) AS wgt, coalesce(sum(CASE WHEN vec_id = q + 1 THEN (CASE WHEN q % 40 = 0 THEN 1.0 ELSE -1.0 END) / rank END), 0) AS credit FROM top GROUP BY enc), m AS (SELECT enc, greatest(0.1, wgt + 0.15 * credit) AS w FROM c) SELECT enc AS encoder, round(w / avg(w) OVER (), 6) AS weight FROM m")
def f4(spark, d):
    feedback = asked(entries(spark, d)).select(F.col("vec_id").alias("q"), (F.col("vec_id") + 1).alias("vec_id"), (F.col("vec_id") % 40 == 0).alias("correct"))
    return fz.reward(_spaces(spark, d), feedback, "vec_id").select("encoder", F.round("weight", 6).alias("weight"))


# Context compilation: the candidates of a question are the evidence sentences extracted for it.
_WL = f"list_distinct({texts._words('lower(evidence)')})"
_WQ = f"list_distinct({texts._words('lower(q)')})"
_CH = f"""ev AS (SELECT DISTINCT id, q, t[4] AS evidence FROM (SELECT id, q, unnest(triples) AS t FROM pilot_extraction) WHERE q IS NOT NULL AND len(t) > 3 AND t[4] IS NOT NULL),
 ch AS MATERIALIZED (SELECT id, evidence, {_WL} AS ws, round(length(evidence) % 64 - 40 * ({texts._jaccard(_WL, _WQ)}), 9) AS score FROM ev)"""
_CL = f"""ln AS MATERIALIZED (SELECT a.id, a.evidence AS i, b.evidence AS j FROM ch a JOIN ch b ON a.id = b.id AND a.evidence <> b.evidence WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) >= 0.35),
 rc AS (SELECT id, evidence AS i, evidence AS c FROM ch UNION SELECT rc.id, ln.j, rc.c FROM rc JOIN ln ON ln.id = rc.id AND ln.i = rc.i), lb AS (SELECT id, i AS evidence, min(c) AS cluster FROM rc GROUP BY id, i)"""


def _chunks(spark, d):
    p = table(spark, d, "pilot_extraction").where("q is not null").select(F.col("id").alias("q"), F.col("q").alias("question"), F.explode("triples").alias("t"))
    ev = p.select("q", "question", F.get("t", F.lit(3)).alias("evidence")).where("evidence is not null").distinct()
    return fz.rerank(ev.withColumn("dist", F.length("evidence") % 64), "evidence", "question", "dist")


@query("N1_rerank", f"WITH {_CH} SELECT id AS q, evidence, round(score, 6) AS score FROM ch")
def n1(spark, d):
    return _chunks(spark, d).select("q", "evidence", F.round("score", 6).alias("score"))


@query("N2_clusters", f"WITH RECURSIVE {_CH}, {_CL} SELECT id AS q, evidence, cluster FROM lb")
def n2(spark, d):
    return fz.clusters(_chunks(spark, d), "evidence", "evidence")


_MG = "mg AS (SELECT * FROM (SELECT lb.id, lb.evidence, cluster, score, row_number() OVER (PARTITION BY lb.id, cluster ORDER BY score, length(lb.evidence), lb.evidence) AS n FROM lb JOIN ch ON ch.id = lb.id AND ch.evidence = lb.evidence) WHERE n = 1)"
_PN = f"pn AS (SELECT id, evidence, score, row_number() OVER w AS place, sum(tk) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, greatest(1, floor(len({texts._words('evidence')}) * 1.3::DOUBLE))::INT AS tk FROM mg) WINDOW w AS (PARTITION BY id ORDER BY score, evidence)), fx AS (SELECT *, max((place > 5 OR used > 48)::INT) OVER (PARTITION BY id ORDER BY place ROWS UNBOUNDED PRECEDING) AS broken FROM pn)"


def _merged(spark, d):
    chunks = stored(_chunks(spark, d), "chunks")
    return fz.merge(chunks.join(fz.clusters(chunks, "evidence", "evidence"), ["q", "evidence"]), "evidence", "evidence")


@query("N3_merge", f"WITH RECURSIVE {_CH}, {_CL}, {_MG} SELECT id AS q, evidence, cluster, round(score, 6) AS score FROM mg")
def n3(spark, d):
    return _merged(spark, d).select("q", "evidence", "cluster", F.round("score", 6).alias("score"))


@query("N4_prune", f"WITH RECURSIVE {_CH}, {_CL}, {_MG}, {_PN} SELECT id AS q, evidence, place, used::BIGINT AS used FROM fx WHERE broken = 0")
def n4(spark, d):
    sized = _merged(spark, d).withColumn("tk", tx.token_estimate(F.col("evidence")))
    return fz.prune(sized, "evidence", "tk", 5, 48).select("q", "evidence", "place", "used")


@query("N5_prompt", f"WITH RECURSIVE {_CH}, {_CL}, {_MG}, {_PN} SELECT id AS q, string_agg(evidence, chr(10) ORDER BY place) AS context FROM fx WHERE broken = 0 GROUP BY id")
def n5(spark, d):
    kept = n4(spark, d)
    return kept.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "evidence"))).alias("c")).select("q", F.array_join(F.transform("c", lambda x: x["evidence"]), "\n").alias("context"))


_AB = f"ab AS (SELECT a.vec_id, a.words AS a, b.words AS b, c.words AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)"


def _triples_of(e):
    return e.select("vec_id", F.col("words").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("words").alias("b")), "vec_id").join(e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("words").alias("c")), "vec_id")


@query("B1_B3_kernels", f"WITH {_E}, {_AB} SELECT vec_id, list_transform(range(2), lambda i: xor(a[i + 1], b[i + 1])) AS x, list_transform(range(2), lambda i: 4294967295 - xor(a[i + 1], b[i + 1])) AS xn, list_transform(range(2), lambda i: a[i + 1] & b[i + 1]) AS n, list_transform(range(2), lambda i: a[i + 1] | b[i + 1]) AS o, list_transform(range(2), lambda i: 4294967295 - a[i + 1]) AS inv, list_transform(range(2), lambda i: (a[i + 1] & b[i + 1]) | (b[i + 1] & c[i + 1]) | (a[i + 1] & c[i + 1])) AS maj FROM ab")
def b1(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _triples_of(entries(spark, d)).select("vec_id", w.bind(a, b).alias("x"), w.alike(a, b).alias("xn"), w.both(a, b).alias("n"), w.either(a, b).alias("o"), w.inverted(a).alias("inv"), w.majority3(a, b, c).alias("maj"))


@query("B2_B4_popcount_dot", f"WITH {_E}, {_AB} SELECT vec_id, (bit_count(a[1]) + bit_count(a[2]))::INT AS ones, 64 - 2 * {q.ham('a', 'b', 2)} AS dot, a = b AS same FROM ab")
def b4(spark, d):
    a, b = F.col("a"), F.col("b")
    return _triples_of(entries(spark, d)).select("vec_id", w.ones(a).alias("ones"), w.dot(a, b, W).alias("dot"), (a == b).alias("same"))


@query("B5_threshold", f"SELECT vec_id, {_PACK.replace('> 0', '> 0.5')} AS words FROM embeddings WHERE embedding IS NOT NULL")
def b5(spark, d):
    over = F.transform("embedding", lambda x: (x > 0.5).cast("int"))
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", w.let(over, lambda b: w.pack(b, W)).alias("words"))


@query("B6_linear", f"WITH {_E}, wt AS (SELECT i, {q.item(chr(39) + 'row' + chr(39) + ' || i', 2)} AS v FROM range(32) r(i)) SELECT vec_id, sum(CASE WHEN 64 - 2 * {q.ham('words', 'v', 2)} > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS out, max(64 - 2 * {q.ham('words', 'v', 2)})::INT AS top FROM e, wt GROUP BY vec_id")
def b6(spark, d):
    weights = spark.range(32).select(F.col("id").alias("i"), w.item(F.concat(F.lit("row"), F.col("id").cast("string")), W).alias("v"))
    dots = entries(spark, d).join(F.broadcast(weights), how="cross").select("vec_id", "i", w.dot(F.col("words"), F.col("v"), W).alias("dot"))
    return dots.groupBy("vec_id").agg(F.sum(F.when(F.col("dot") > 0, F.expr("shiftleft(1L, cast(i as int))")).otherwise(0)).alias("out"), F.max("dot").alias("top"))

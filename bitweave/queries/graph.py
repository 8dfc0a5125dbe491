"""Learned edges, episodes and engine metrics (G, X and H rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import edges as eg
from bitweave.operators import store as st
from bitweave.queries import texts
from bitweave.session import stored, table

NOW = "2026-06-30 00:00:00+00:00"
_NOW = "TIMESTAMPTZ '2026-06-30 00:00:00+00'"
_U = "u AS (SELECT edge_id, lower(trim(source)) AS source, lower(trim(target)) AS target, confidence, support, success, failure, last_seen, answer_payload FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND confidence BETWEEN 0 AND 1 AND support >= 0 AND support = success + failure AND last_seen IS NOT NULL AND last_seen <= " + _NOW + ")"


def usable(spark, d):
    e = table(spark, d, "edges").where("source is not null and target is not null and confidence between 0 and 1 and support >= 0 and support = success + failure and last_seen is not null")
    e = e.where(F.col("last_seen") <= F.lit(NOW).cast("timestamp"))
    return e.select("edge_id", F.lower(F.trim("source")).alias("source"), F.lower(F.trim("target")).alias("target"), "confidence", "support", "success", "failure", "last_seen", "answer_payload")


_BETA = "CASE WHEN {n} = 0 THEN 0.5 ELSE greatest(0.01, least(0.99, (1.0 + {s}) / (2.0 + {n}))) END"
_DAYS = f"(epoch_us({_NOW}) - epoch_us(last_seen)) / 86400000000.0"


@query("G1_beta_mean", f"WITH {_U} SELECT edge_id, round({_BETA.format(n='support', s='success')}, 6) AS confidence FROM u")
def g1(spark, d):
    return usable(spark, d).select("edge_id", F.round(eg.beta_mean(F.col("success"), F.col("support")), 6).alias("confidence"))


@query("G2_record_hits", f"WITH {_U}, h AS (SELECT question_id, count(*) AS n, sum(hit::INT) AS s FROM results WHERE hit IS NOT NULL AND question_id IS NOT NULL GROUP BY question_id) SELECT question_id, n AS support, s::BIGINT AS success, round({_BETA.format(n='n', s='s')}, 6) AS confidence FROM h")
def g2(spark, d):
    hits = table(spark, d, "results").where("hit is not null and question_id is not null").groupBy("question_id").agg(F.count("*").alias("support"), F.sum(F.col("hit").cast("bigint")).alias("success"))
    return hits.withColumn("confidence", F.round(eg.beta_mean(F.col("success"), F.col("support")), 6))


@query("G3_G8_hot_stale", f"WITH {_U} SELECT edge_id, support > 10 AND confidence > 0.9 AS hot, {_DAYS} > 30 AS stale FROM u")
def g3(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return usable(spark, d).select("edge_id", eg.is_hot(F.col("support"), F.col("confidence")).alias("hot"), (eg.age_days(F.col("last_seen"), now) > 30).alias("stale"))


_ANCH = "an AS (SELECT DISTINCT lower(trim(plan.anchor)) AS entity FROM pilot_extraction WHERE plan.anchor IS NOT NULL UNION SELECT DISTINCT lower(trim(t[1])) FROM (SELECT unnest(triples) AS t FROM pilot_extraction) WHERE t[1] IS NOT NULL)"


def _anchors(spark, d):
    p = table(spark, d, "pilot_extraction")
    names = p.select(F.col("plan.anchor").alias("x")).union(p.select(F.explode("triples").alias("t")).select(F.get("t", F.lit(0))))
    return names.where("x is not null").select(F.lower(F.trim("x")).alias("entity")).distinct()


@query("G4_lookup", f"WITH {_U}, {_ANCH}, r AS (SELECT entity, edge_id, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, support DESC, edge_id) AS rank FROM an JOIN u ON u.source = an.entity) SELECT entity, edge_id, rank FROM r WHERE rank <= 10")
def g4(spark, d):
    found = usable(spark, d).join(_anchors(spark, d).withColumnRenamed("entity", "source"), "source")
    order = Window.partitionBy("source").orderBy(F.desc("confidence"), F.desc("support"), "edge_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select(F.col("source").alias("entity"), "edge_id", "rank")


@query("G5_geometric_lookup")
def g5(spark, d):
    """Anchors without an edge of their own, and the nearest source of the cache within 0.30 D."""
    sketch = lambda c: tx.minhash(tx.token_set(F.col(c)), 2)
    sources = usable(spark, d).where("not startswith(source, '_')").select("source").distinct()
    asked = _anchors(spark, d).join(sources.withColumnRenamed("source", "entity"), "entity", "left_anti").where(F.size(tx.token_set(F.col("entity"))) > 0)
    held = stored(sources.where(F.size(tx.token_set(F.col("source"))) > 0).select("source", sketch("source").alias("y")), "sources")
    blocks = stored(asked.select("entity", sketch("entity").alias("x")), "anchors")
    out = None
    for block in st.blocks(blocks, "entity"):
        off = F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])) + F.bit_count(F.col("x")[1].bitwiseXOR(F.col("y")[1]))
        near = held.join(F.broadcast(block), off <= int(0.30 * 64))
        best = near.groupBy("entity").agg(F.min(F.struct(w.hamming(F.col("x"), F.col("y"), 2).alias("dist"), "source")).alias("b"))
        out = best if out is None else out.unionByName(best)
    return out.select("entity", F.col("b.source").alias("source"), F.col("b.dist").alias("dist"))


@query("G6_reverse_lookup", f"WITH {_U} SELECT target, min(edge_id) AS edge_id, arg_min(answer_payload, edge_id) AS answer FROM u WHERE answer_payload IS NOT NULL GROUP BY target")
def g6(spark, d):
    return usable(spark, d).where("answer_payload is not null").groupBy("target").agg(F.min("edge_id").alias("edge_id"), F.min_by("answer_payload", "edge_id").alias("answer"))


_PATHS = f"""{_U}, g AS (SELECT source, target, count(*) AS support, arg_min(confidence, edge_id) AS score, max(last_seen) AS last_seen, min(edge_id) AS first FROM u GROUP BY source, target),
 p AS MATERIALIZED (SELECT source, target, support, support - 1 + (score > 0.5)::INT AS success, support - (support - 1 + (score > 0.5)::INT) AS failure, last_seen, first, CASE WHEN support = 1 THEN least(score, 0.99) ELSE {_BETA.format(n='support', s='(support - 1 + (score > 0.5)::INT)')} END AS confidence FROM g)"""


def _paths(spark, d):
    return eg.from_paths(usable(spark, d), "source", "target", "edge_id", "confidence", "answer_payload", "last_seen")


@query("G7_store_paths", f"WITH {_PATHS} SELECT source, target, support, success, failure, round(confidence, 6) AS confidence, first FROM p")
def g7(spark, d):
    return _paths(spark, d).select("source", "target", "support", "success", "failure", F.round("confidence", 6).alias("confidence"), "first")


_DECAYED = f"dc AS (SELECT * REPLACE (CASE WHEN {_DAYS} > 0 THEN greatest(0.01, confidence * exp(-0.01 * {_DAYS})) ELSE confidence END AS confidence) FROM p)"


@query("G10_decay", f"WITH {_PATHS}, {_DECAYED} SELECT source, target, round(confidence, 6) AS confidence FROM dc")
def g10(spark, d):
    return eg.decay(_paths(spark, d), F.lit(NOW).cast("timestamp")).select("source", "target", F.round("confidence", 6).alias("confidence"))


@query("G11_merge")
def g11(spark, d):
    edges = stored(_paths(spark, d).where("not startswith(source, '_')"), "edges")
    return eg.merge(edges).select("source", "target", "merged", "support", "success", F.round("confidence", 6).alias("confidence"))


_KEEP = f"confidence >= 0.15 AND NOT (support < 3 AND {_DAYS} > 30)"


@query("G12_forget", f"WITH {_PATHS}, {_DECAYED} SELECT source, target FROM dc WHERE {_KEEP}")
def g12(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return eg.forget(eg.decay(_paths(spark, d), now), now).select("source", "target")


@query("G9_sleep")
def g9(spark, d):
    """Decay, merge and forget in turn: what is left of every source, and how much of it is hot."""
    now = F.lit(NOW).cast("timestamp")
    edges = stored(eg.decay(_paths(spark, d).where("not startswith(source, '_')"), now), "edges")
    left = eg.forget(eg.merge(edges), now)
    return left.groupBy("source").agg(F.count("*").alias("edges"), F.count_if(eg.is_hot(F.col("support"), F.col("confidence"))).alias("hot"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("G13_metrics", f"WITH {_PATHS} SELECT count(*) AS edges, count(DISTINCT source) AS sources, sum(support)::BIGINT AS support, round(avg(confidence), 6) AS confidence, count(*) FILTER (WHERE support > 10 AND confidence > 0.9) AS hot FROM p")
def g13(spark, d):
    return _paths(spark, d).agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.sum("support").alias("support"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(eg.is_hot(F.col("support"), F.col("confidence"))).alias("hot"))


@query("H5_edge_key", "SELECT edge_id, lower(source) || '→' || lower(target) AS key FROM edges WHERE source IS NOT NULL AND target IS NOT NULL")
def h5(spark, d):
    return table(spark, d, "edges").where("source is not null and target is not null").select("edge_id", F.concat(F.lower("source"), F.lit("→"), F.lower("target")).alias("key"))


@query("H6_payload_text", "SELECT edge_id, CASE WHEN starts_with(answer_payload, '{') AND json_valid(answer_payload) THEN coalesce(json_extract_string(answer_payload, '$.text'), answer_payload) ELSE answer_payload END AS text FROM edges WHERE answer_payload IS NOT NULL")
def h6(spark, d):
    p = F.col("answer_payload")
    text = F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), p)).otherwise(p)
    return table(spark, d, "edges").where(p.isNotNull()).select("edge_id", text.alias("text"))


@query("H8_rewarded", "SELECT result_id, conf IS NOT NULL AND NOT isnan(conf) AS rewarded, conf IS NOT NULL AND NOT isnan(conf) AND conf > 0.5 AS positive FROM results")
def h8(spark, d):
    has = F.col("conf").isNotNull() & ~F.isnan("conf")
    return table(spark, d, "results").select("result_id", has.alias("rewarded"), (has & (F.col("conf") > 0.5)).alias("positive"))


_BYTES = " || ".join(f"substr(hx, {k}, 2)" for k in range(15, 0, -2))
_SKETCHED = f"""an AS (SELECT DISTINCT plan.anchor AS x, 0 AS k FROM pilot_extraction WHERE plan.anchor IS NOT NULL UNION ALL SELECT DISTINCT canon_name, 1 FROM ref_entities),
 tk AS (SELECT x, k, unnest(CASE WHEN len(t) = 0 THEN ['_'] ELSE t END) AS t FROM (SELECT x, k, {texts._tokens('x')} AS t FROM an)),
 m AS (SELECT x, k, j, min({_BYTES}) AS low FROM (SELECT x, k, j, md5(encode(j || '|') || unhex(md5(t))) AS hx FROM tk, range(64) r(j)) GROUP BY x, k, j),
 bt AS (SELECT x, k, j, ('0x' || substr(low, 16, 1))::BIGINT % 2 AS bit FROM m),
 b AS MATERIALIZED (SELECT x, k, sum(CASE WHEN j < 32 THEN bit << j ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN j >= 32 THEN bit << (j - 32) ELSE 0 END)::BIGINT AS w1 FROM bt GROUP BY x, k),
 ds AS (SELECT a.x AS anchor, c.x AS entity, (bit_count(xor(a.w0, c.w0)) + bit_count(xor(a.w1, c.w1)))::INT AS dist FROM b a JOIN b c ON a.k = 0 AND c.k = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY dist, entity) AS n FROM ds)"""


@query("X2_grounding", f"WITH {_SKETCHED} SELECT anchor, entity, dist FROM r WHERE n = 1 AND 1 - 2 * dist / 64.0 >= 0.15")
def x2(spark, d):
    """The entity of the reference list whose sketch is nearest to an anchor's, if the estimated
    Jaccard similarity is 0.15 or more."""
    sketch = lambda c: tx.minhash(w.let(tx.token_set(F.col(c)), lambda t: F.when(F.size(t) == 0, F.array(F.lit("_"))).otherwise(t)), 2)
    anchors = table(spark, d, "pilot_extraction").select(F.col("plan.anchor").alias("anchor")).where("anchor is not null").distinct().select("anchor", sketch("anchor").alias("x"))
    refs = table(spark, d, "ref_entities").select(F.col("canon_name").alias("entity")).distinct().select("entity", sketch("entity").alias("y"))
    near = stored(anchors, "anchors").join(F.broadcast(stored(refs, "refs")), how="cross").groupBy("anchor").agg(F.min(F.struct(w.hamming(F.col("x"), F.col("y"), 2).alias("dist"), "entity")).alias("b"))
    return near.select("anchor", F.col("b.entity").alias("entity"), F.col("b.dist").alias("dist")).where(1 - 2 * F.col("dist") / 64.0 >= 0.15)


@query("X8_metrics", "SELECT run_id, count(*) AS asked, count(*) FILTER (WHERE hit) AS hits, round(avg(conf) FILTER (WHERE conf IS NOT NULL AND NOT isnan(conf)), 6) AS mean_conf, round(avg(length(ans)), 6) AS mean_length FROM results GROUP BY run_id")
def x8(spark, d):
    r = table(spark, d, "results")
    good = F.when(F.col("conf").isNotNull() & ~F.isnan("conf"), F.col("conf"))
    return r.groupBy("run_id").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.round(F.avg(good), 6).alias("mean_conf"), F.round(F.avg(F.length("ans")), 6).alias("mean_length"))


@query("X9_episodes", "SELECT run_id, result_id, n FROM (SELECT run_id, result_id, row_number() OVER (PARTITION BY run_id ORDER BY answered_at DESC NULLS LAST, result_id DESC) AS n FROM results WHERE run_id IS NOT NULL) WHERE n <= 20")
def x9(spark, d):
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("answered_at"), F.desc("result_id"))
    return table(spark, d, "results").where("run_id is not null").withColumn("n", F.row_number().over(order)).where("n <= 20").select("run_id", "result_id", "n")


@query("X9_unlabelled", "SELECT question_id, count(*) AS episodes, count(*) FILTER (WHERE conf IS NULL OR isnan(conf)) AS unlabelled FROM results WHERE question_id IS NOT NULL GROUP BY question_id")
def x9u(spark, d):
    return table(spark, d, "results").where("question_id is not null").groupBy("question_id").agg(F.count("*").alias("episodes"), F.count_if(F.col("conf").isNull() | F.isnan("conf")).alias("unlabelled"))

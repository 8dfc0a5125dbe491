"""Sources and sinks, binary network kernels, tokenizer pieces and streams (S, B, H rows and the stream façade)."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import kernels as kn
from bitweave.queries import graph, stores, texts
from bitweave.queries import oracle as q
from bitweave.session import shared_dir, stored, table
from bitweave.sources import container, files
from bitweave.streaming import observe

W = stores.W


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_triples", "SELECT id, k::INT AS pos, t[1] AS s, t[2] AS r, t[3] AS o, len(t) = 3 AS valid FROM (SELECT id, unnest(triples) AS t, unnest(range(len(triples))) AS k FROM (SELECT id, any_value(triples) AS triples FROM pilot_extraction WHERE triples IS NOT NULL GROUP BY id))")
def s1(spark, d):
    """Triples written as JSON arrays, one file line each, and read back with their arity checked."""
    p = table(spark, d, "pilot_extraction").where("triples is not null").groupBy("id").agg(F.any_value("triples").alias("triples"))
    path = _place(spark, "triples")
    p.select(F.to_json(F.struct("id", "triples"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    t = spark.read.text(path).select(F.from_json("value", "id string, triples array<array<string>>").alias("j")).select("j.id", F.posexplode("j.triples").alias("pos", "t"))
    return t.select("id", "pos", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")], (F.size("t") == 3).alias("valid"))


@query("S2_append", "SELECT s, r, o, count(*) AS n FROM (SELECT s, r, o FROM facts UNION ALL SELECT lower(t[1]), t[2], lower(t[3]) FROM (SELECT unnest(triples) AS t FROM pilot_extraction) WHERE len(t) >= 3) GROUP BY ALL")
def s2(spark, d):
    more = table(spark, d, "pilot_extraction").select(F.explode("triples").alias("t")).where("size(t) >= 3").select(F.lower(F.col("t")[0]).alias("s"), F.col("t")[1].alias("r"), F.lower(F.col("t")[2]).alias("o"))
    return files.append_facts(table(spark, d, "facts").select("s", "r", "o"), more).groupBy("s", "r", "o").agg(F.count("*").alias("n"))


@query("S3_S4_store", f"WITH {stores._E} SELECT vec_id, words, label FROM e")
def s3(spark, d):
    path = _place(spark, "store")
    files.save_store(stores.entries(spark, d), path)
    return files.load_store(spark, path)


@query("S5_routes", f"WITH {stores._E}, {stores._PROTO} SELECT label, proto FROM pt")
def s5(spark, d):
    path = _place(spark, "routes")
    files.save_store(stores.r4(spark, d), path)
    return files.load_store(spark, path)


@query("S6_edges", f"WITH {graph._PATHS} SELECT source, target, support, round(confidence, 6) AS confidence, support > 10 AND confidence > 0.9 AS hot FROM p")
def s6(spark, d):
    path = _place(spark, "edges")
    files.save_edges(graph._paths(spark, d).select("source", "target", "support", "confidence"), path)
    return files.load_edges(spark, path, "source string, target string, support bigint, confidence double").withColumn("confidence", F.round("confidence", 6))


#: Entries of a container.
SHARD = 4096


def containers(spark, d, more: list | None = None):
    """Containers of a label's states, of up to ``SHARD`` entries each, written and read again as rows
    (path, content). ``more``: sections that every container has besides."""
    rows = stores.entries(spark, d).where("label is not null").withColumn("shard", F.expr(f"vec_id div {SHARD}"))

    def pack(key, pdf):
        pdf = pdf.sort_values("vec_id")
        ids, words = pdf["vec_id"].tolist(), [x for e in pdf["words"] for x in e]
        sections = [("ids", "u64", [len(ids)], struct.pack(f"<{len(ids)}Q", *ids)), ("states", "i32", [len(ids), 2], struct.pack(f"<{len(words)}I", *words)), *(more or [])]
        return pd.DataFrame({"path": [f"{key[0]}-{key[1]}.bin"], "content": [container.build({"label": int(key[0])}, sections)]})

    path = _place(spark, "containers")
    container.write(rows.groupBy("label", "shard").applyInPandas(pack, "path string, content binary"), path)
    return spark.read.parquet(path)


@query("S8_S10_sections", f"WITH {stores._E} SELECT label, 'ids' AS name, 'u64' AS kind, [count(*)::INT] AS shape, (count(*) * 8)::INT AS bytes FROM e WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT label, 'states', 'i32', [count(*)::INT, 2], (count(*) * 8)::INT FROM e WHERE label IS NOT NULL GROUP BY label")
def s8(spark, d):
    got = container.sections(containers(spark, d)).withColumn("label", F.get_json_object("header", "$.label").cast("int"))
    n = F.sum(F.col("shape")[0]).cast("int")
    shape = F.when(F.col("name") == "ids", F.array(n)).otherwise(F.array(n, F.lit(2)))
    return got.groupBy("label", "name", "kind").agg(shape.alias("shape"), F.sum(F.length("data")).cast("int").alias("bytes"))


@query("S9_validate", f"WITH {stores._E}, s AS (SELECT DISTINCT label, vec_id // 4096 FROM e WHERE label IS NOT NULL) SELECT count(*) AS files, count(*) AS valid, 0 AS spoilt FROM s")
def s9(spark, d):
    """Checksums of all containers, and of copies of them with one byte changed."""
    held = containers(spark, d)
    spoilt = held.select("path", F.expr("overlay(content placing X'FF' from 600 for 1)").alias("content"))
    counted = lambda x, name: container.checked(x).agg(F.count("*").alias("files"), F.count_if("valid").alias(name))
    return counted(held, "valid").join(counted(spoilt, "spoilt").select(F.col("spoilt").cast("int").alias("spoilt")))


@query("S11_model", f"WITH {stores._E} SELECT vec_id, words FROM e WHERE label IS NOT NULL")
def s11(spark, d):
    """States rebuilt from the sections of a container."""
    def rebuild(batches):
        for batch in batches:
            for path, data in zip(batch["ids"], batch["states"]):
                ids, words = np.frombuffer(path, "<u8"), np.frombuffer(data, "<u4").reshape(-1, 2)
                yield pd.DataFrame({"vec_id": ids.astype(np.int64), "words": list(words.astype(np.int64))})

    got = container.sections(containers(spark, d))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("data"))).alias(name)
    return got.groupBy("path").agg(part("ids"), part("states")).select("ids", "states").mapInPandas(rebuild, "vec_id bigint, words array<bigint>")


@query("S15_vocabulary", f"WITH t AS (SELECT DISTINCT unnest({texts._words('lower(text)')}) AS t FROM documents WHERE text IS NOT NULL) SELECT t AS token, ('0x' || substr(md5(t), 1, 6))::INT AS id FROM t")
def s15(spark, d):
    tokens = texts.docs(spark, d).select(F.explode(tx.low_words(F.col("text"))).alias("token")).distinct()
    made = tokens.select("token", F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("int").alias("id"))
    path = _place(spark, "vocabulary")
    # A vocabulary is one JSON object per file; each task writes its own.
    made.groupBy(F.pmod(F.hash("token"), F.lit(8)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "id")))).alias("value")).select("value").repartition(8).write.text(path)
    return files.read_vocabulary(spark, path)


@query("S17_stories", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text, chr(10)) <> ''")
def s17(spark, d):
    """Texts written with a line of --- after each, and found again; line ends around a text are not kept."""
    bare = lambda c: F.regexp_replace(c, "^\n+|\n+$", "")
    kept = texts.docs(spark, d).select("doc_id", bare("text").alias("story")).where("story <> ''")
    path = _place(spark, "stories")
    files.write_stories(kept, "story", path)
    back = files.read_stories(spark, path).select(bare("text").alias("story")).distinct()
    return kept.join(back, "story", "left_semi").select("doc_id")


@query("S22_json", "SELECT run_id, count(*) AS n FROM results GROUP BY run_id")
def s22(spark, d):
    path = _place(spark, "json")
    table(spark, d, "results").groupBy("run_id").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("run_id int, n bigint").json(path)


@query("S23_triple_filter", "SELECT id, t[1] AS s, t[2] AS r, t[3] AS o FROM (SELECT id, unnest(triples) AS t FROM pilot_extraction) WHERE len(t) = 3 AND len(list_filter(t, lambda x: x IS NOT NULL AND length(x) < 200)) = 3")
def s23(spark, d):
    t = table(spark, d, "pilot_extraction").select("id", F.explode("triples").alias("t"))
    ok = (F.size("t") == 3) & (F.size(F.filter("t", lambda x: x.isNotNull() & (F.length(x) < 200))) == 3)
    return t.where(ok).select("id", *[F.col("t")[i].alias(c) for i, c in enumerate("sro")])


# Kernels. Embeddings of 256 tokens, sequences of a document's first-to-last word buckets.
def _emb(spark):
    return spark.range(256).select(F.col("id").cast("int").alias("token"), w.item(F.concat(F.lit("emb"), F.col("id").cast("string")), W).alias("words"))


@query("B7_embedding", f"WITH em AS (SELECT t AS token, {q.item(chr(39) + 'emb' + chr(39) + ' || t', 2)} AS words FROM range(256) r(t)), ev AS (SELECT event_id, (user_id * 3)::INT AS token FROM events) SELECT event_id, words FROM ev LEFT JOIN em USING (token)")
def b7(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("user_id") * 3).cast("int").alias("token"))
    return kn.lookup(ev, _emb(spark), "token").select("event_id", "words")


@query("B7_stats", f"SELECT round(avg(bit_count(v[1]) + bit_count(v[2])) / 64, 6) AS density FROM (SELECT {q.item(chr(39) + 'emb' + chr(39) + ' || t', 2)} AS v FROM range(256) r(t))")
def b7s(spark, d):
    return _emb(spark).agg(F.round(F.avg(w.ones(F.col("words"))) / 64, 6).alias("density"))


def _inputs(spark, d):
    """States of each document's words, in order."""
    return texts.docs(spark, d).select("doc_id", F.transform(tx.low_words(F.col("text")), lambda t: w.item(t, W)).alias("xs")).where("size(xs) > 0")


@query("B9_B10_layer")
def b9(spark, d):
    rows = [[[int(x, 16) for x in (h[:8], h[8:16])] for h in (hashlib.md5(f"{name}{i}".encode()).hexdigest() for i in range(64))] for name in ("f", "i", "m")]
    return stored(_inputs(spark, d), "inputs").select("doc_id", kn.run_layer(F.col("xs"), *rows).alias("state"))


@query("B14_xor_machine")
def b14(spark, d):
    return _inputs(spark, d).select("doc_id", kn.xor_machine(F.col("xs"), W).alias("state"))


_NODES = f"nd AS (SELECT n AS node, {q.item(chr(39) + 'node' + chr(39) + ' || n', 2)} AS v FROM range(15) r(n))"
_STEP = "n{i} AS (SELECT vec_id, words, n{j}.node * 2 + CASE WHEN 64 - 2 * " + q.ham("words", "nd.v", 2) + " > 0 THEN 2 ELSE 1 END AS node FROM n{j} JOIN nd ON nd.node = n{j}.node)"


@query("B11_tree", f"WITH {stores._E}, {_NODES}, n0 AS (SELECT vec_id, words, 0 AS node FROM e), {', '.join(_STEP.format(i=i, j=i - 1) for i in range(1, 5))} SELECT vec_id, node - 15 AS leaf FROM n4")
def b11(spark, d):
    nodes = spark.range(15).select(F.col("id").alias("node"), w.item(F.concat(F.lit("node"), F.col("id").cast("string")), W).alias("words"))
    return kn.tree_greedy(stores.entries(spark, d), nodes, "vec_id", 4, W)


@query("B12_sampling", f"WITH {stores._E}, {stores._NN}, l AS (SELECT q, vec_id, -dist / 4.0 AS logit FROM nn), x AS (SELECT q, vec_id, logit, row_number() OVER (PARTITION BY q ORDER BY logit DESC, vec_id) AS r FROM l), y AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY q)) AS e FROM x WHERE r <= 3), z AS (SELECT *, e / sum(e) OVER (PARTITION BY q) AS p FROM y) SELECT q, vec_id, round(p, 6) AS p, round(sum(p) OVER (PARTITION BY q ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS cum FROM z")
def b12(spark, d):
    logits = stores.k1(spark, d).select("q", "vec_id", (-F.col("dist") / 4.0).alias("logit"))
    return kn.softmax_top_k(logits, "q", "vec_id", "logit", 3).select("q", "vec_id", F.round("p", 6).alias("p"), F.round("cum", 6).alias("cum"))


@query("B17_agreement", f"WITH {stores._E}, {stores._NN}, a AS (SELECT q, list(vec_id ORDER BY rank) AS n FROM nn GROUP BY q), m AS (SELECT q, vec_id FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.words[1], b.words[1])), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r = 1) SELECT count(*) AS n, round(avg((a.n[1] = m.vec_id)::INT), 6) AS top_1, round(avg(list_contains(a.n, m.vec_id)::INT), 6) AS top_5 FROM a JOIN m USING (q)")
def b17(spark, d):
    full, half = stores.k1(spark, d), stores.l14(spark, d).where("rank = 1").select("q", F.col("vec_id").alias("v"))
    hit = full.join(half, "q").groupBy("q").agg(F.max(((F.col("rank") == 1) & (F.col("vec_id") == F.col("v"))).cast("int")).alias("one"), F.max((F.col("vec_id") == F.col("v")).cast("int")).alias("five"))
    return hit.agg(F.count("*").alias("n"), F.round(F.avg("one"), 6).alias("top_1"), F.round(F.avg("five"), 6).alias("top_5"))


@query("H25_binarisers", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) AS sign, list_transform(embedding, lambda x: CASE WHEN x > 0.5 THEN 1 ELSE -1 END) AS thresholded, list_transform(embedding, lambda x: CASE WHEN x > 0.5 THEN 1 WHEN x < -0.5 THEN -1 ELSE 0 END) AS ternary FROM embeddings WHERE embedding IS NOT NULL")
def h25(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").where("embedding is not null").select(
        "vec_id", F.transform(e, lambda x: F.when(x >= 0, 1).otherwise(-1)).alias("sign"), F.transform(e, lambda x: F.when(x > 0.5, 1).otherwise(-1)).alias("thresholded"),
        F.transform(e, lambda x: F.when(x > 0.5, 1).when(x < -0.5, -1).otherwise(0)).alias("ternary"))


@query("T16_pretokenise", r"SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+|[0-9]+|[^a-z0-9\s]') AS tokens FROM documents WHERE text IS NOT NULL")
def t16(spark, d):
    return texts.docs(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+|[0-9]+|[^a-z0-9 \t\n\r\f]"), 0).alias("tokens"))


@query("C17_horn_chaining", "WITH RECURSIVE fx AS (SELECT DISTINCT doc_id // 32 AS mem, s AS e, r AS a FROM facts WHERE doc_id IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL), r1 AS (SELECT * FROM fx UNION SELECT x.mem, x.e, 'leader' FROM fx x JOIN fx y ON x.mem = y.mem AND x.e = y.e WHERE x.a = 'founded_by' AND y.a = 'directed_by'), r2 AS (SELECT * FROM r1 UNION SELECT x.mem, x.e, 'known' FROM r1 x JOIN r1 y ON x.mem = y.mem AND x.e = y.e WHERE x.a = 'leader' AND y.a = 'based_in') SELECT mem, e AS entity, a AS attribute FROM r2")
def c17(spark, d):
    f = table(spark, d, "facts").where("doc_id is not null and s is not null and r is not null").select(F.expr("doc_id div 32").alias("mem"), F.col("s").alias("entity"), F.col("r").alias("attribute"))
    rules = spark.createDataFrame([(1, "founded_by", "leader"), (1, "directed_by", "leader"), (2, "leader", "known"), (2, "based_in", "known")], "rule int, premise string, conclusion string")
    return kn.forward_chain(f, f.select("mem").distinct().join(F.broadcast(rules), how="cross"))


# Streams over the files of a table: read once with all available data, held against the batch result.
@query("ST1_edge_hits_stream", f"WITH h AS (SELECT user_id, count(*) AS n, sum((event_type = 'purchase')::INT)::BIGINT AS s FROM events GROUP BY user_id) SELECT user_id, n AS support, s AS success, round({graph._BETA.format(n='n', s='s')}, 6) AS confidence FROM h")
def st1(spark, d):
    path = f"{d}/events.parquet"
    batch = table(spark, d, "events")
    # A single file is read through its folder and a filter on its name; a table that is a folder as it is.
    source = spark.readStream.schema(batch.schema)
    stream = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "events.parquet").parquet(d)
    hits = stream.select("user_id", (F.col("event_type") == "purchase").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))
    name = f"hits_{uuid.uuid4().hex}"
    edges = observe.edge_confidence(hits, ["user_id"], "ok", "ts")
    out = _place(spark, "stream")

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/part")

    edges.writeStream.queryName(name).outputMode("complete").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{out}/part").select("user_id", "support", "success", F.round("confidence", 6).alias("confidence"))


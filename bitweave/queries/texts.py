"""Text functions, encoders and corpus readers (T, E and some S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators.bundle import bundle
from bitweave.queries import oracle as q
from bitweave.session import spread, table

_STOP = ", ".join(f"'{x}'" for x in tx.ENTITY_STOP)
_CONTENT = ", ".join(f"'{x}'" for x in tx.CONTENT_STOP)
_QW = ", ".join(f"'{x}'" for x in tx.QUESTION_WORDS)


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


def _strip(x: str, signs: str) -> str:
    inside = "".join("\\" + c for c in signs).replace("'", "''")
    return f"regexp_replace(regexp_replace({x}, '^[{inside}]+', ''), '[{inside}]+$', '')"


def docs(spark, d):
    return spread(table(spark, d, "documents")).where("text is not null")


@query("T1_hashed_features", f"""WITH d AS (SELECT doc_id, {_words('lower(text)')} AS ws FROM documents WHERE text IS NOT NULL),
 t AS (SELECT doc_id, unnest(ws) AS t, 2 AS n FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])), 1 FROM d)
SELECT doc_id, ('0x' || substr(md5(t), 30, 3))::INT AS bucket, sum(n)::INT AS w2 FROM t GROUP BY doc_id, bucket""")
def t1(spark, d):
    return tx.hashed_features(docs(spark, d), "doc_id", "text")


_FEATURES = f"""d AS (SELECT doc_id, {_words('lower(text)')} AS ws FROM documents WHERE text IS NOT NULL),
 t AS (SELECT doc_id, unnest(ws) AS t, 2 AS n FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])), 1 FROM d),
 ft AS (SELECT doc_id, ('0x' || substr(md5(t), 30, 3))::INT AS bucket, sum(n)::INT AS n FROM t GROUP BY doc_id, bucket),
 pj AS (SELECT b AS bucket, {q.item("'proj' || b", 8)} AS v FROM range(4096) r(b))"""
SIMHASH = f"WITH {_FEATURES} SELECT doc_id, trace AS state FROM {q.majority('(SELECT doc_id, n, v AS state FROM ft JOIN pj USING (bucket))', 'doc_id', 'state', 8, 'plus')}"


def simhash(spark, d):
    """256-bit SimHash of every document with a word: sign of the hashed features times a +1/-1 matrix."""
    matrix = spark.range(tx.FEATURES).select(F.col("id").cast("int").alias("bucket"), w.item(F.concat(F.lit("proj"), F.col("id").cast("string")), 8).alias("row"))
    rows = tx.hashed_features(docs(spark, d), "doc_id", "text").join(F.broadcast(matrix), "bucket")
    return bundle(rows, ["doc_id"], "row", 8, F.col("w2"), "plus", "state").drop("n")


query("E1_simhash", SIMHASH)(simhash)


@query("E4_ngram_state", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
 g AS (SELECT doc_id, ('0x' || substr(md5(unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)))), 31, 2))::INT AS b FROM d, (SELECT unnest([2, 3, 4, 5]) AS n)),
 v AS (SELECT doc_id, b // 32 AS w, bit_or(1::BIGINT << (b % 32)) AS v FROM g GROUP BY doc_id, w)
SELECT doc_id, list_transform(range(8), lambda i: coalesce(map_from_entries(list((w, v)))[i], 0)) AS hit FROM v GROUP BY doc_id""")
def e4(spark, d):
    return tx.ngram_state(docs(spark, d), "doc_id", "text")


_ENT = f"list_filter(list_distinct(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')), lambda t: regexp_full_match(t, '[A-Z][a-zA-Z]*|[a-z]+[A-Z][a-zA-Z]*') AND length(t) > 1 AND lower(t) NOT IN ({_STOP}))"


@query("E6_entities", f"SELECT doc_id, list_sort({_ENT}) AS entities FROM documents WHERE text IS NOT NULL")
def e6(spark, d):
    return docs(spark, d).select("doc_id", F.array_sort(tx.entities(F.col("text"))).alias("entities"))


_ITEMS = f"""CASE WHEN len({_ENT}) > 0 THEN list_distinct(list_transform({_ENT}, lambda t: lower(t)))
 WHEN len(list_filter({_words('lower(text)')}, lambda t: t NOT IN ({_STOP}))) > 0 THEN list_distinct(list_filter({_words('lower(text)')}, lambda t: t NOT IN ({_STOP})))
 WHEN text = '' THEN ['∅'] ELSE [lower(text)] END"""
_SKETCH = f"""d AS (SELECT doc_id, {_ITEMS} AS items FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, unnest(items) AS x FROM d), m AS (SELECT doc_id, j, min(lpad('', 0, '0') || substr(hx, 15, 2) || substr(hx, 13, 2) || substr(hx, 11, 2) || substr(hx, 9, 2) || substr(hx, 7, 2) || substr(hx, 5, 2) || substr(hx, 3, 2) || substr(hx, 1, 2)) AS low
 FROM (SELECT doc_id, j, md5(encode(j || '|') || unhex(md5(x))) AS hx FROM h, range(64) r(j)) GROUP BY doc_id, j),
 b AS (SELECT doc_id, j, ('0x' || substr(low, 16, 1))::INT % 2 AS bit FROM m)"""


@query("E5_E7_entity_sketch", f"WITH {_SKETCH} SELECT doc_id, [sum(CASE WHEN j < 32 THEN bit::BIGINT << j ELSE 0 END)::BIGINT, sum(CASE WHEN j >= 32 THEN bit::BIGINT << (j - 32) ELSE 0 END)::BIGINT] AS sketch FROM b GROUP BY doc_id")
def e5(spark, d):
    return docs(spark, d).select("doc_id", tx.minhash(tx.entity_items(F.col("text")), 2).alias("sketch"))


@query("T2_norm_entity", f"SELECT DISTINCT target, regexp_replace(lower({_strip('trim(target)', '.,;: ')}), '^the ', '') AS norm FROM edges WHERE target IS NOT NULL")
def t2(spark, d):
    return table(spark, d, "edges").where("target is not null").select("target").distinct().select("target", tx.norm_entity(F.col("target")).alias("norm"))


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({_words(f'lower({x})')}, lambda t: {_strip('t', '.,;:()' + chr(39) + chr(34))}), lambda t: t <> ''))"


@query("T3_token_set", f"SELECT DISTINCT target, list_sort({_tokens('target')}) AS tokens FROM edges WHERE target IS NOT NULL")
def t3(spark, d):
    return table(spark, d, "edges").where("target is not null").select("target").distinct().select("target", F.array_sort(tx.token_set(F.col("target"))).alias("tokens"))


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) END"


_WG, _WA = f"list_distinct({_words('lower(gold)')})", f"list_distinct({_words('lower(ans)')})"


@query("T4_word_overlap", f"SELECT result_id, round({_jaccard(_WG, _WA)}, 6) AS overlap FROM results WHERE gold IS NOT NULL AND ans IS NOT NULL")
def t4(spark, d):
    return table(spark, d, "results").where("gold is not null and ans is not null").select("result_id", F.round(tx.word_overlap(F.col("gold"), F.col("ans")), 6).alias("overlap"))


_LOW_Q, _LOW_T = _words("lower(q)"), _words("lower(evidence)")
_EVID = "e AS (SELECT id, q, k, t[4] AS evidence FROM (SELECT id, q, unnest(triples) AS t, unnest(range(len(triples))) AS k FROM pilot_extraction) WHERE q IS NOT NULL AND len(t) > 3 AND t[4] IS NOT NULL)"


def _evidence(spark, d):
    p = table(spark, d, "pilot_extraction").where("q is not null").select("id", "q", F.posexplode("triples").alias("k", "t"))
    return p.select("id", "q", F.col("k").cast("bigint").alias("k"), F.get("t", F.lit(3)).alias("evidence")).where("evidence is not null").distinct()


@query("T5_coverage", f"""WITH {_EVID}, a AS (SELECT DISTINCT id, q, k, evidence FROM e), x AS (SELECT id, k, evidence,
 list_distinct(list_transform(list_filter({_LOW_Q}, lambda t: t NOT IN ({_CONTENT}) AND length(t) > 2), lambda t: {_strip('t', '.,;:!?()')})) AS asked,
 list_distinct(list_transform({_LOW_T}, lambda t: {_strip('t', '.,;:!?()')})) AS held FROM a)
SELECT id, k, evidence, round(CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_intersect(asked, held)) / len(asked) END, 6) AS coverage FROM x""")
def t5(spark, d):
    return _evidence(spark, d).select("id", "k", "evidence", F.round(tx.coverage(F.col("evidence"), F.col("q")), 6).alias("coverage"))


_UNDOT = "replace(target, '.', ' ')"


@query("T6_target_tokens", f"SELECT DISTINCT target, list_sort(list_distinct(list_transform(list_filter({_words(_UNDOT)}, lambda t: length(t) > 1), lambda t: {_strip('lower(t)', tx.SIGNS)}))) AS tokens FROM edges WHERE target IS NOT NULL")
def t6(spark, d):
    long = F.filter(tx.split_words(F.regexp_replace("target", r"\.", " ")), lambda t: F.length(t) > 1)
    tokens = F.array_distinct(F.transform(long, lambda t: tx.strip_signs(F.lower(t))))
    return table(spark, d, "edges").where("target is not null").select("target").distinct().select("target", F.array_sort(tokens).alias("tokens"))


@query("T7_query_entity", f"""WITH p AS (SELECT DISTINCT q, list_transform({_words('q')}, lambda t: {_strip('t', '.,;:!?()' + chr(39))}) AS w FROM pilot_extraction WHERE q IS NOT NULL),
 x AS (SELECT q, list_filter(list_transform(range(len(w)), lambda i: {{'i': i, 't': w[i + 1]}}), lambda p: regexp_matches(p.t, '[A-Z]') AND regexp_full_match(p.t, '[A-Za-z]{{2,}}') AND lower(p.t) NOT IN ({_CONTENT}, {_QW})) AS c,
  list_filter(list_transform(range(len(w)), lambda i: {{'i': i, 't': w[i + 1]}}), lambda p: regexp_full_match(p.t, '[A-Za-z]{{3,}}') AND lower(p.t) NOT IN ({_CONTENT}, {_QW})) AS n FROM p)
SELECT q, CASE WHEN len(c) > 1 AND c[-2].i = c[-1].i - 1 THEN c[-2].t || ' ' || c[-1].t WHEN len(c) > 0 THEN c[-1].t WHEN len(n) > 1 THEN n[-2].t || ' ' || n[-1].t WHEN len(n) = 1 THEN n[-1].t ELSE '' END AS entity FROM x""")
def t7(spark, d):
    return table(spark, d, "pilot_extraction").where("q is not null").select("q").distinct().select("q", tx.query_entity(F.col("q")).alias("entity"))


@query("T8_bridge_entity", f"""WITH {_EVID}, a AS (SELECT DISTINCT id, q, k, evidence FROM e), x AS (SELECT id, k, evidence, {_LOW_Q} AS asked, list_transform({_words('evidence')}, lambda t: {_strip('t', '.,;:!?()[]' + chr(39) + chr(34))}) AS w FROM a),
 c AS (SELECT id, k, evidence, list_filter(w, lambda t: regexp_full_match(t, '[A-Za-z.]{{2,}}') AND NOT list_contains(asked, lower(t)) AND lower(t) NOT IN ({_CONTENT})) AS c FROM x)
SELECT id, k, evidence, coalesce(list_filter(c, lambda t: regexp_matches(t, '^[A-Z]'))[1], list_reduce(c, lambda s, t: CASE WHEN length(t) > length(s) THEN t ELSE s END, ''), '') AS bridge FROM c""")
def t8(spark, d):
    return _evidence(spark, d).select("id", "k", "evidence", tx.bridge_entity(F.col("evidence"), F.col("q")).alias("bridge"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])[ \t\n\r\f]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_SENTENCES = f"s AS (SELECT doc_id, unnest({_SENT}) AS sentence FROM documents WHERE text IS NOT NULL)"


def _sentences(spark, d):
    return docs(spark, d).select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))


def _norm(x: str) -> str:
    return f"regexp_replace(lower({_strip(f'trim({x})', '.,;: ')}), '^the ', '')"


def _fact(i: int) -> str:
    pattern, rel, inverse = tx.FACT_PATTERNS[i]
    s, o = (_norm(f"regexp_extract(sentence, '{pattern}', {g})") for g in (1, 2))
    return f"WHEN regexp_matches(sentence, '{pattern}') THEN {{'s': {s}, 'r': '{rel}', 'o': {o}, 'i': '{inverse}'}}"


@query("T9_extract_triples", f"""WITH {_SENTENCES}, m AS (SELECT doc_id, CASE {' '.join(_fact(i) for i in range(3))} END AS t FROM s)
SELECT doc_id, t.s AS s, t.r AS r, t.o AS o FROM m WHERE t.s <> '' AND t.o <> '' UNION ALL SELECT doc_id, t.o, t.i, t.s FROM m WHERE t.s <> '' AND t.o <> ''""")
def t9(spark, d):
    return _sentences(spark, d).select("doc_id", F.explode(tx.extract_triples(F.col("sentence"))).alias("t")).select("doc_id", "t.*")


def _question(i: int) -> str:
    pattern, chain = tx.QUESTION_PATTERNS[i]
    extracted = f"regexp_extract(sentence, '{pattern}', 1)"
    return f"WHEN regexp_matches(sentence, '{pattern}') THEN {{'a': {_norm(extracted)}, 'c': string_split('{chain}', ',')}}"


@query("T10_plan_question", f"WITH {_SENTENCES}, m AS (SELECT DISTINCT sentence, CASE {' '.join(_question(i) for i in range(9))} END AS p FROM s WHERE contains(sentence, '?')) SELECT sentence, p.a AS anchor, p.c AS chain FROM m WHERE p IS NOT NULL")
def t10(spark, d):
    asked = _sentences(spark, d).where(F.contains("sentence", F.lit("?"))).select("sentence").distinct()
    return asked.select("sentence", tx.plan_question(F.col("sentence")).alias("p")).where("p is not null").select("sentence", "p.anchor", "p.chain")


_SMALL = "'of', 'in', 'and', 'on', 'to', 'by', 'for', 'with'"


def _answer(x: str) -> str:
    norm = f"trim(regexp_replace(regexp_replace(' ' || regexp_replace(lower({x}), '[^a-z0-9]+', '  ', 'g') || ' ', ' (a|an|the) ', ' ', 'g'), ' +', ' ', 'g'))"
    return f"list_distinct(list_transform(list_filter(string_split({norm}, ' '), lambda t: t <> '' AND t NOT IN ({_SMALL})), lambda t: regexp_replace(t, 's+$', '')))"


@query("T12_answer_match", f"WITH x AS (SELECT result_id, {_answer('gold')} AS g, {_answer('ans')} AS a FROM results WHERE gold IS NOT NULL AND ans IS NOT NULL) SELECT result_id, len(g) > 0 AND len(a) > 0 AND (list_has_all(a, g) OR list_has_all(g, a)) AS match FROM x")
def t12(spark, d):
    return table(spark, d, "results").where("gold is not null and ans is not null").select("result_id", tx.answers_match(tx.answer_tokens(F.col("gold")), tx.answer_tokens(F.col("ans"))).alias("match"))


# Sentence templates in order of precedence; the last two are traps that name the object first.
TEMPLATES = [
    (r"^(.+) is headquartered in ([^,]+),", "based_in", False), (r"^(.+) was written by (.+) while", "written_by", False),
    (r"^(.+) joined (.+) in \d{4}", "member_of", False), (r"^(.+) sold its collection to (.+) for", "sold_to", False),
    (r"^In the second passage (.+) is described as a neighbour of (.+), which", "neighbour_of", True), (r"^It is (.+) that receives the output of (.+) once", "receives_from", True),
]


def _template(i: int) -> str:
    pattern, rel, turned = TEMPLATES[i]
    s, o = (f"regexp_extract(sentence, '{pattern}', {g})" for g in ((2, 1) if turned else (1, 2)))
    return f"WHEN regexp_matches(sentence, '{pattern}') THEN {{'s': {s}, 'r': '{rel}', 'o': {o}}}"


@query("T13_templates", f"WITH {_SENTENCES}, m AS (SELECT doc_id, CASE {' '.join(_template(i) for i in range(len(TEMPLATES)))} END AS t FROM s) SELECT doc_id, t.s AS s, t.r AS r, t.o AS o FROM m WHERE t IS NOT NULL")
def t13(spark, d):
    sentence, out = F.col("sentence"), F.lit(None).cast("struct<s:string,r:string,o:string>")
    for pattern, rel, turned in reversed(TEMPLATES):
        a, b = F.regexp_extract(sentence, pattern, 1), F.regexp_extract(sentence, pattern, 2)
        s, o = (b, a) if turned else (a, b)
        out = F.when(sentence.rlike(pattern), F.struct(s.alias("s"), F.lit(rel).alias("r"), o.alias("o"))).otherwise(out)
    return _sentences(spark, d).select("doc_id", out.alias("t")).where("t is not null").select("doc_id", "t.*")


@query("T14_token_estimate", f"SELECT doc_id, greatest(1, floor(len({_words('text')}) * 1.3::DOUBLE))::INT AS tokens FROM documents WHERE text IS NOT NULL")
def t14(spark, d):
    return docs(spark, d).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


def _content(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({x}), '[_-]', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g')"
    return f"list_distinct(list_filter({_words(plain)}, lambda t: length(t) > 2 AND t NOT IN ({_CONTENT})))"


@query("T15_anchor", f"""WITH p AS (SELECT id, min(q) AS q, any_value(triples) AS triples FROM pilot_extraction WHERE q IS NOT NULL GROUP BY id), t AS (SELECT id, q, unnest(triples) AS t, unnest(range(len(triples))) AS k FROM p),
 n AS (SELECT id, q, name, min(k * 2 + w) AS first, sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) AS subj FROM (SELECT id, q, k, t[1] AS name, 0 AS w FROM t UNION ALL SELECT id, q, k, t[3], 1 FROM t) WHERE name IS NOT NULL GROUP BY id, q, name),
 s AS (SELECT *, {_content('name')} AS et, {_content('q')} AS qt FROM n), c AS (SELECT *, CASE WHEN len(et) = 0 THEN 0.0 ELSE len(list_intersect(et, qt)) / len(et) END AS score FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first) AS rs, row_number() OVER (PARTITION BY id ORDER BY subj DESC, first) AS rd FROM c)
SELECT id, coalesce(max(CASE WHEN rs = 1 AND score >= 0.5 THEN name END), max(CASE WHEN rd = 1 AND subj > 0 THEN name END)) AS anchor, max(CASE WHEN rs = 1 AND score >= 0.5 THEN 1 ELSE 0 END) = 1 AS named FROM r GROUP BY id""")
def t15(spark, d):
    p = table(spark, d, "pilot_extraction").where("q is not null").groupBy("id").agg(F.min("q").alias("q"), F.any_value("triples").alias("triples"))
    t = p.select("id", "q", F.posexplode("triples").alias("k", "t"))
    parts = F.array(*[F.struct(F.get("t", F.lit(2 * b)).alias("name"), F.lit(b).alias("b")) for b in (0, 1)])
    n = t.select("id", "q", "k", F.explode(parts).alias("p")).where("p.name is not null").groupBy("id", "q", F.col("p.name").alias("name")).agg(F.min(F.col("k") * 2 + F.col("p.b")).alias("first"), F.sum(1 - F.col("p.b")).alias("subj"))
    content = lambda c: F.array_distinct(F.filter(tx.split_words(F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]", " "), r"[^\p{L}\p{N} ]", " ")), lambda x: (F.length(x) > 2) & ~x.isin(tx.CONTENT_STOP)))
    e, qn = content(F.col("name")), content(F.col("q"))
    scored = n.withColumn("score", F.when(F.size(e) == 0, 0.0).otherwise(F.size(F.array_intersect(e, qn)) / F.size(e)))
    best = scored.groupBy("id").agg(
        F.max(F.struct("score", -F.col("first"), "name")).alias("b"), F.max(F.when(F.col("subj") > 0, F.struct("subj", -F.col("first"), "name"))).alias("m"))
    named = F.col("b.score") >= 0.5
    return best.select("id", F.when(named, F.col("b.name")).otherwise(F.col("m.name")).alias("anchor"), named.alias("named"))


@query("T17_bits", "SELECT user_id, list_transform(range(11, -1, -1), lambda i: ((user_id >> i) & 1)::INT) AS bits, user_id % 4096 AS back FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def t17(spark, d):
    bits = tx.int_to_bits(F.col("user_id"))
    back = F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s * 2 + b)
    return table(spark, d, "events").where("user_id is not null").select("user_id").distinct().select("user_id", bits.alias("bits"), back.alias("back"))


@query("T18_sliding_context", f"""WITH d AS (SELECT doc_id, list_transform({_words('lower(text)')}, lambda t: ('0x' || substr(md5(t), 30, 3))::INT) AS ids FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i, ids[i - 3:i] AS context, ids[i + 1] AS target FROM (SELECT doc_id, ids, unnest(range(4, len(ids))) AS i FROM d)""")
def t18(spark, d):
    ids = docs(spark, d).select("doc_id", F.transform(tx.low_words(F.col("text")), lambda t: F.conv(F.substring(F.md5(t), 30, 3), 16, 10).cast("int")).alias("ids")).where("size(ids) > 4")
    at = ids.select("doc_id", "ids", F.explode(F.expr("sequence(4, size(ids) - 1)")).alias("i")).withColumn("i", F.col("i").cast("bigint"))
    return at.select("doc_id", "i", F.slice("ids", (F.col("i") - 3).cast("int"), F.lit(4)).alias("context"), F.get("ids", F.col("i").cast("int")).alias("target"))


@query("T19_dna_4mers", """WITH d AS (SELECT doc_id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_transform(range(0, 32, 4), lambda i: list_reduce(list_transform(range(4), lambda j: strpos('ACGT', substr(dna, i + j + 1, 1)) - 1), lambda a, b: a * 4 + b)::INT) AS kmers FROM d""")
def t19(spark, d):
    dna = docs(spark, d).select("doc_id", F.translate(F.md5("text"), "0123456789abcdef", "ACGT" * 4).alias("dna"))
    codes = F.transform(F.split("dna", ""), lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c == "T", 3))
    coded = dna.withColumn("codes", F.filter(codes, lambda x: x.isNotNull()))
    mer = lambda i: F.aggregate(F.slice("codes", i + 1, 4), F.lit(0), lambda s, b: s * 4 + b)
    return coded.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(28), F.lit(4)), mer).alias("kmers"))


@query("S16_corpus_chunks", """SELECT doc_id, k, chunk FROM (SELECT doc_id, unnest(list_transform(range(0, length(text), 500), lambda i: substr(text, i + 1, 500))) AS chunk, unnest(range(((length(text) + 499) // 500))) AS k FROM documents WHERE text <> '')""")
def s16(spark, d):
    starts = F.expr("sequence(0, length(text) - 1, 500)")
    return docs(spark, d).where("text <> ''").select("doc_id", "text", F.posexplode(starts).alias("k", "i")).select("doc_id", F.col("k").cast("bigint").alias("k"), F.expr("substring(text, i + 1, 500)").alias("chunk"))


@query("S16_paragraphs", r"SELECT doc_id, paragraph FROM (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS paragraph FROM documents WHERE text IS NOT NULL) WHERE trim(paragraph) <> ''")
def s16p(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("paragraph")).where("trim(paragraph) <> ''")


@query("S18_sequences", f"""WITH d AS (SELECT doc_id, list_transform({_words('lower(text)')}, lambda t: ('0x' || substr(md5(t), 30, 3))::INT) AS ids FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i, ids[i + 1:i + 32] AS x, ids[i + 2:i + 33] AS y FROM (SELECT doc_id, ids, unnest(range(0, len(ids) - 32, 32)) AS i FROM d)""")
def s18(spark, d):
    ids = docs(spark, d).select("doc_id", F.transform(tx.low_words(F.col("text")), lambda t: F.conv(F.substring(F.md5(t), 30, 3), 16, 10).cast("int")).alias("ids")).where("size(ids) > 32")
    at = ids.select("doc_id", "ids", F.explode(F.expr("sequence(0, size(ids) - 33, 32)")).alias("i"))
    return at.select("doc_id", F.col("i").cast("bigint").alias("i"), F.slice("ids", F.col("i") + 1, F.lit(32)).alias("x"), F.slice("ids", F.col("i") + 2, F.lit(32)).alias("y"))


_CHUNKS = f"c AS (SELECT doc_id, k, array_to_string(ws[k * 200 + 1:k * 200 + 200], ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(((len(ws) + 199) // 200))) AS k FROM (SELECT doc_id, {_words('text')} AS ws FROM documents WHERE text IS NOT NULL)))"


@query("S20_word_chunks", f"WITH {_CHUNKS} SELECT doc_id, k, chunk FROM c")
def s20(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tx.chunk_words(F.col("text"))).alias("k", "chunk")).withColumn("k", F.col("k").cast("bigint"))


@query("S21_index_chunks", f"""WITH {_CHUNKS}, w AS (SELECT doc_id, k, {_words('lower(chunk)')} AS ws FROM c), t AS (SELECT doc_id * 1000 + k AS id, unnest(ws) AS t FROM w), ft AS (SELECT id, ('0x' || substr(md5(t), 30, 3))::INT AS bucket, count(*) AS n FROM t GROUP BY id, bucket),
 pj AS (SELECT b AS bucket, {q.item("'proj' || b", 2)} AS v FROM range(4096) r(b)) SELECT id, trace AS state FROM {q.majority('(SELECT id, n, v AS state FROM ft JOIN pj USING (bucket))', 'id', 'state', 2, 'plus')}""")
def s21(spark, d):
    chunks = s20(spark, d).select((F.col("doc_id") * 1000 + F.col("k")).alias("id"), F.explode(tx.low_words(F.col("chunk"))).alias("t"))
    feats = chunks.groupBy("id", F.conv(F.substring(F.md5("t"), 30, 3), 16, 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    matrix = spark.range(tx.FEATURES).select(F.col("id").cast("int").alias("bucket"), w.item(F.concat(F.lit("proj"), F.col("id").cast("string")), 2).alias("row"))
    return bundle(feats.withColumnRenamed("n", "times").join(F.broadcast(matrix), "bucket"), ["id"], "row", 2, F.col("times"), "plus", "state").drop("n")

"""Algebra, codebook and memory queries (A, C and M rows)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import contract as ct
from bitweave.functions import words as w
from bitweave.operators import memory as mm
from bitweave.operators.bundle import bundle
from bitweave.queries import oracle as q
from bitweave.session import spread, table

W = q.W
D = 32 * W


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The fact store as memories of up to 32 documents each: their size does not grow with the store."""
    return mm.clean(spread(table(spark, d, "facts")), F.expr("doc_id div 32"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return n.union(table(spark, d, "region").select("r_name")).union(table(spark, d, "part").select("p_name")).distinct()


_NAMES = "nm AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part)"


@query("A1_item", f"WITH {_NAMES} SELECT name, {q.item('name')} AS words FROM nm")
def a1(spark, d):
    return _names(spark, d).select("name", w.item(F.col("name"), W).alias("words"))


@query("A2_bind", f"WITH {_NAMES} SELECT name, {q.bind(q.item('name'), q.item(chr(39) + 'key' + chr(39)))} AS bound FROM nm")
def a2(spark, d):
    return _names(spark, d).select("name", w.bind(w.item(F.col("name"), W), w.item(F.lit("key"), W)).alias("bound"))


@query("A3_permute", f"WITH {_NAMES}, h AS (SELECT name, {q.item('name')} AS v FROM nm) SELECT name, {q.rho('v')} AS once, {q.rho(q.rho('v'))} AS twice FROM h")
def a3(spark, d):
    v = w.item(F.col("name"), W)
    return _names(spark, d).select("name", w.rho(v, 1, W).alias("once"), w.rho(v, 2, W).alias("twice"))


@query("A4_unbind", f"WITH {_NAMES} SELECT name, {q.item('name')} AS words, TRUE AS same FROM nm")
def a4(spark, d):
    v, k = w.item(F.col("name"), W), w.item(F.lit("key"), W)
    back = w.bind(w.bind(v, k), k)
    return _names(spark, d).select("name", back.alias("words"), (back == v).alias("same"))


@query("A5_bundle", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE} SELECT mem, n::BIGINT AS n, trace FROM {q.majority('(SELECT mem, n, ' + q.bind('k', 'ov') + ' AS state FROM st)', 'mem', 'state')}")
def a5(spark, d):
    return mm.traces(facts(spark, d), W)


@query("A6_majority_plus", f"WITH {q.FACTS}, {q.BOOK}, {q.HV} SELECT mem, n::BIGINT AS n, trace FROM {q.majority('(SELECT mem, 1 AS n, v AS state FROM book JOIN hv USING (name))', 'mem', 'state', tie='plus')}")
def a6(spark, d):
    names = mm.codebook(facts(spark, d))
    return bundle(names.select("mem", w.item(F.col("name"), W).alias("state")), ["mem"], "state", W, tie="plus")


@query("A7_hamming", f"WITH h AS (SELECT n_name AS name, {q.item('n_name')} AS v FROM nation) SELECT a.name AS a, b.name AS b, {q.ham('a.v', 'b.v')} AS dist FROM h a JOIN h b ON a.name < b.name")
def a7(spark, d):
    h = table(spark, d, "nation").select(F.col("n_name").alias("name"), w.item(F.col("n_name"), W).alias("v"))
    return h.alias("a").join(F.broadcast(h.alias("b")), F.expr("a.name < b.name")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), w.hamming(F.col("a.v"), F.col("b.v"), W).alias("dist"))


@query("A8_phi", f"WITH h AS (SELECT n_name AS name, {q.item('n_name')} AS v FROM nation) SELECT a.name AS a, b.name AS b, round(({D} / 2.0 - {q.ham('a.v', 'b.v')}) / sqrt({D}), 6) AS phi FROM h a JOIN h b ON a.name < b.name")
def a8(spark, d):
    return a7(spark, d).select("a", "b", F.round((D / 2 - F.col("dist")) / math.sqrt(D), 6).alias("phi"))


@query("A9_key", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE} SELECT DISTINCT s, r, k AS words FROM st")
def a9(spark, d):
    return facts(spark, d).select("s", "r").distinct().select("s", "r", mm.key(F.col("s"), F.col("r"), W).alias("words"))


@query("A10_fact", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE} SELECT mem, ord, {q.bind('k', 'ov')} AS words FROM st")
def a10(spark, d):
    return facts(spark, d).select("mem", "ord", mm.fact_state(F.col("s"), F.col("r"), F.col("o"), W).alias("words"))


_PAIRS = f"""pr AS (SELECT a.mem, a.s, a.r AS r1, a.o AS bridge, b.r AS r2, b.o, {q.bind(q.bind('a.k', 'a.ov'), q.bind('b.k', 'b.ov'))} AS state
 FROM st a JOIN st b ON a.mem = b.mem AND a.o = b.s WHERE a.o <> a.s AND a.o <> b.o)"""


@query("A11_compose", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE}, {_PAIRS} SELECT mem, s, r1, r2, o, state FROM pr")
def a11(spark, d):
    return mm.compose(facts(spark, d), W).select("mem", "s", "r1", "r2", "o", "state")


@query("A14_normal_form", """WITH t AS (SELECT fact_id, s AS atom, 0 AS depth FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL UNION ALL SELECT fact_id, r, 1 FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL UNION ALL SELECT fact_id, o, 0 FROM facts WHERE s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL)
SELECT fact_id, atom, depth, (count(*) % 2)::INT AS parity FROM t GROUP BY fact_id, atom, depth HAVING count(*) % 2 = 1""")
def a14(spark, d):
    atoms = F.array(*[F.struct(F.col(c).alias("atom"), F.lit(k).alias("depth")) for c, k in (("s", 0), ("r", 1), ("o", 0))])
    rows = table(spark, d, "facts").where("s is not null and r is not null and o is not null").select("fact_id", F.explode(atoms).alias("a")).select("fact_id", "a.*")
    return rows.groupBy("fact_id", "atom", "depth").agg((F.count("*") % 2).cast("int").alias("parity")).where("parity = 1")


@query("A15_raw_chain", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, c AS (SELECT DISTINCT a.mem, a.s, a.r AS r1, b.r AS r2, b.o FROM f a JOIN f b ON a.mem = b.mem AND a.o = b.s WHERE a.o <> a.s AND a.o <> b.o) SELECT c.mem, s, r1, r2, o, {q.ham(q.bind(q.bind('x.v', 'y.v'), 'z.v'), 'u.v')} AS dist FROM c JOIN hv x ON x.name = s JOIN rv y ON y.name = r1 JOIN rv z ON z.name = r2 JOIN hv u ON u.name = o")
def a15(spark, d):
    """Two hops without a cleanup between them: the raw answer of the first is the subject of the second, so
    the trace is bound twice and cancels. What is left does not depend on the trace (the oracle derives it
    without one) and is no nearer to the object than chance."""
    f = facts(spark, d)
    a, b = f.select("mem", "s", F.col("r").alias("r1"), F.col("o").alias("bridge")), f.select("mem", F.col("s").alias("bridge"), F.col("r").alias("r2"), "o")
    chains = a.join(b, ["mem", "bridge"]).where("bridge <> s and bridge <> o").select("mem", "s", "r1", "r2", "o").distinct()
    first = chains.join(mm.traces(f, W), "mem").withColumn("raw", w.bind(F.col("trace"), mm.key(F.col("s"), F.col("r1"), W)))
    second = w.bind(F.col("trace"), w.bind(F.col("raw"), w.rho(w.item(F.col("r2"), W), 1, W)))
    return first.select("mem", "s", "r1", "r2", "o", w.hamming(second, w.item(F.col("o"), W), W).alias("dist"))


@query("A16_noise", f"""WITH {q.MEMORY} SELECT mem, list_transform(range({W}), lambda i: xor(trace[i + 1], ('0x' || substr(md5('noise#' || mem || '#' || i), 1, 8))::BIGINT & ('0x' || substr(md5('more#' || mem || '#' || i), 1, 8))::BIGINT & ('0x' || substr(md5('most#' || mem || '#' || i), 1, 8))::BIGINT)) AS noisy FROM tr""")
def a16(spark, d):
    # One bit in eight is flipped: the AND of three independent hash words.
    word = lambda tag, i: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(tag), F.col("mem").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    mask = lambda i: word("noise", i).bitwiseAND(word("more", i)).bitwiseAND(word("most", i))
    return mm.traces(facts(spark, d), W).select("mem", F.transform("trace", lambda x, i: x.bitwiseXOR(mask(i))).alias("noisy"))


@query("C0_codebook", f"WITH {q.FACTS}, {q.BOOK} SELECT mem, name, idx FROM book")
def c0(spark, d):
    return mm.codebook(facts(spark, d))


_ASK = f"ask AS (SELECT DISTINCT st.mem, s, r, {q.bind('trace', 'k')} AS noisy FROM st JOIN tr USING (mem))"
_CONF = f"round(1 / (1 + exp(-(({D} / 2.0 - dist) / (sqrt({D}) / 2)) / 8)), 6)"


def _asked(f: DataFrame) -> DataFrame:
    return f.select("mem", "s", "r").distinct()


@query("C1_cleanup", f"WITH {q.FACTS}, {q.BOOK}, {q.HV}, no AS (SELECT DISTINCT mem, name AS asked, list_transform(range({W}), lambda i: xor(v[i + 1], ('0x' || substr(md5('dirt#' || i), 1, 8))::BIGINT & ('0x' || substr(md5('dust#' || i), 1, 8))::BIGINT)) AS noisy FROM book JOIN hv USING (name)) SELECT * FROM {q.cleanup('no', 'asked')}")
def c1(spark, d):
    names = mm.codebook(facts(spark, d))
    word = lambda tag, i: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(tag), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    noisy = names.select("mem", F.col("name").alias("asked"), F.transform(w.item(F.col("name"), W), lambda x, i: x.bitwiseXOR(word("dirt", i).bitwiseAND(word("dust", i)))).alias("noisy"))
    return mm.nearest(noisy, names, ["asked"], W)


@query("C2_typed_projection", f"WITH {q.MEMORY}, {_ASK}, typ AS (SELECT DISTINCT mem, r, o FROM f) SELECT * FROM {q.cleanup('ask', 's, r', 'EXISTS (SELECT 1 FROM typ WHERE typ.mem = q.mem AND typ.r = q.r AND typ.o = book.name)')}")
def c2(spark, d):
    f = facts(spark, d)
    # The objects that a relation has in a memory are the subset: the pairs of names and queries come from a join on (mem, r).
    typed = f.select("mem", "r", F.col("o").alias("name")).distinct().join(mm.codebook(f), ["mem", "name"])
    noisy = _asked(f).join(mm.traces(f, W), "mem").select("mem", "s", "r", w.bind(F.col("trace"), mm.key(F.col("s"), F.col("r"), W)).alias("noisy"))
    both = noisy.join(typed, ["mem", "r"]).select("mem", "s", "r", "name", "idx", w.hamming(F.col("noisy"), w.item(F.col("name"), W), W).alias("dist"))
    return both.groupBy("mem", "s", "r").agg(F.min(F.struct("dist", "idx", "name")).alias("b")).select("mem", "s", "r", F.col("b.name").alias("answer"), "b.dist")


@query("C3_query", f"WITH {q.MEMORY}, {_ASK} SELECT mem, s, r, answer, dist, {_CONF} AS conf FROM {q.cleanup('ask', 's, r')}")
def c3(spark, d):
    f = facts(spark, d)
    return mm.query(f, _asked(f), W).withColumn("conf", F.round(ct.confidence(F.col("dist"), D), 6))


@query("C3_accuracy", f"""WITH {q.MEMORY}, {_ASK}, a AS (SELECT * FROM {q.cleanup('ask', 's, r')})
SELECT mem, count(*) AS queries, sum((EXISTS (SELECT 1 FROM f WHERE f.mem = a.mem AND f.s = a.s AND f.r = a.r AND f.o = a.answer))::INT)::BIGINT AS hits FROM a GROUP BY mem""")
def c3_accuracy(spark, d):
    f = facts(spark, d)
    answers = mm.query(f, _asked(f), W)
    true = f.select("mem", "s", "r", F.col("o").alias("answer"), F.lit(1).alias("hit")).distinct()
    return answers.join(true, ["mem", "s", "r", "answer"], "left").groupBy("mem").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"))


_CHAINS = "ch AS (SELECT DISTINCT a.mem, a.s AS s, a.r AS r1, b.r AS r2 FROM f a JOIN f b ON a.mem = b.mem AND a.o = b.s)"


def _starts(f: DataFrame) -> DataFrame:
    a = f.select("mem", "s", F.col("r").alias("r1"), F.col("o").alias("b"))
    b = f.select("mem", F.col("s").alias("b"), F.col("r").alias("r2"))
    pairs = a.join(b, ["mem", "b"]).select("mem", "s", "r1", "r2").distinct()
    return pairs.select("mem", F.concat_ws("|", "s", "r1", "r2").alias("id"), F.col("s").alias("start"), F.array("r1", "r2").alias("rels"))


def _hop_sql(guided: bool) -> str:
    vis1 = "book.name <> q.s" if guided else "TRUE"
    vis2 = "book.name <> q.s AND book.name <> q.node" if guided else "TRUE"
    return f"""h1 AS (SELECT mem, s, r1, r2, answer AS node, {_CONF[6:-4]} AS c1 FROM {q.cleanup("(SELECT ch.mem, s, r1, r2, " + q.bind('trace', q.bind('a.v', 'b.v')) + " AS noisy FROM ch JOIN tr USING (mem) JOIN hv a ON a.name = ch.s JOIN rv b ON b.name = ch.r1)", 's, r1, r2', vis1)}),
 h2 AS (SELECT mem, s, r1, r2, node, c1, answer, {_CONF[6:-4]} AS c2 FROM {q.cleanup("(SELECT h1.mem, s, r1, r2, node, c1, " + q.bind('trace', q.bind('a.v', 'b.v')) + " AS noisy FROM h1 JOIN tr USING (mem) JOIN hv a ON a.name = h1.node JOIN rv b ON b.name = h1.r2)", 's, r1, r2, node, c1', vis2)})
SELECT mem, s || '|' || r1 || '|' || r2 AS id, answer AS node, round(c1 * c2, 6) AS conf FROM h2"""


@query("C4_chain", f"WITH {q.MEMORY}, {_CHAINS}, {_hop_sql(False)}")
def c4(spark, d):
    f = facts(spark, d)
    return mm.chain(f, _starts(f), 2, W).select("mem", "id", "node", F.round("conf", 6).alias("conf"))


@query("C5_guided_chain", f"WITH {q.MEMORY}, {_CHAINS}, {_hop_sql(True)}")
def c5(spark, d):
    f = facts(spark, d)
    return mm.chain(f, _starts(f), 2, W, guided=True).select("mem", "id", "node", F.round("conf", 6).alias("conf"))


@query("C6_member", f"WITH {q.MEMORY} SELECT DISTINCT st.mem, s, r, o, {q.ham('trace', q.bind('k', 'ov'))} AS dist, ({D} / 2.0 - {q.ham('trace', q.bind('k', 'ov'))}) / (sqrt({D}) / 2) >= 3 AS found FROM st JOIN tr USING (mem)")
def c6(spark, d):
    f = facts(spark, d)
    return mm.member(f, f.select("mem", "s", "r", "o").distinct(), W)


_COMPILED = f"{q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE}, {_PAIRS}, ct AS MATERIALIZED (SELECT mem, n, trace FROM {q.majority('(SELECT mem, 1 AS n, state FROM pr)', 'mem', 'state')})"


@query("C7_compile", f"WITH {_COMPILED} SELECT mem, n::BIGINT AS n, trace FROM ct")
def c7(spark, d):
    return bundle(mm.compose(facts(spark, d), W), ["mem"], "state", W)


@query("C8_query_compiled", f"WITH {_COMPILED}, ask AS (SELECT DISTINCT pr.mem, s, r1, r2, {q.bind('trace', q.bind('a.v', q.bind('b.v', 'c.v')))} AS noisy FROM pr JOIN ct USING (mem) JOIN hv a ON a.name = pr.s JOIN rv b ON b.name = pr.r1 JOIN rv c ON c.name = pr.r2) SELECT mem, s, r1, r2, answer, dist, {_CONF} AS conf FROM {q.cleanup('ask', 's, r1, r2')}")
def c8(spark, d):
    f = facts(spark, d)
    pairs = mm.compose(f, W)
    trace = bundle(pairs, ["mem"], "state", W)
    noisy = pairs.select("mem", "s", "r1", "r2").distinct().join(trace, "mem").select("mem", "s", "r1", "r2", w.bind(F.col("trace"), mm.composed_key(F.col("s"), F.col("r1"), F.col("r2"), W)).alias("noisy"))
    return mm.nearest(noisy, mm.codebook(f), ["s", "r1", "r2"], W).withColumn("conf", F.round(ct.confidence(F.col("dist"), D), 6))


@query("C9_query_exact", f"""WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE}, ask AS (SELECT DISTINCT mem, s, r, k FROM st)
SELECT mem, s, r, o AS answer, dist FROM (SELECT a.mem, a.s, a.r, b.o, {q.ham('a.k', 'b.k')} AS dist, row_number() OVER (PARTITION BY a.mem, a.s, a.r ORDER BY {q.ham('a.k', 'b.k')}, b.ord) AS rn FROM ask a JOIN st b ON a.mem = b.mem) WHERE rn = 1""")
def c9(spark, d):
    f = facts(spark, d)
    ask = _asked(f).select("mem", "s", "r", mm.key(F.col("s"), F.col("r"), W).alias("k"))
    held = f.select("mem", "ord", F.col("o").alias("answer"), mm.key(F.col("s"), F.col("r"), W).alias("held"))
    near = ask.join(held, "mem").groupBy("mem", "s", "r").agg(F.min(w.hamming(F.col("k"), F.col("held"), W).cast("bigint") * (1 << 40) + F.col("ord")).alias("code"))
    return near.select("mem", "s", "r", F.expr("code div 1099511627776").cast("int").alias("dist"), F.expr("code % 1099511627776").alias("ord")).join(held.select("mem", "ord", "answer"), ["mem", "ord"]).select("mem", "s", "r", "answer", "dist")


def _zg(m: str) -> str:
    return f"(sqrt(2 * ln({m})) - (ln(ln({m})) + ln(4 * pi())) / (2 * sqrt(2 * ln({m}))))"


def _erf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t})"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


def _acc(n: str, dim: str, m: str) -> str:
    return f"(0.5 * (1 + {_erf('((sqrt(2 * ' + dim + ' / (pi() * ' + n + ')) - ' + _zg(m) + ') / sqrt(2.0))')}))"


def _cap(dim: str, m: str) -> str:
    return f"(0.92 * 2 * {dim} / (pi() * {_zg(m)} * {_zg(m)}))"


_SIZES = f"{q.FACTS}, {q.BOOK}, sz AS (SELECT mem, n, greatest(m, 2)::DOUBLE AS m FROM (SELECT mem, sum(n)::DOUBLE AS n FROM f GROUP BY mem) JOIN (SELECT mem, count(*) AS m FROM book GROUP BY mem) USING (mem))"


def _sizes(spark, d):
    f = facts(spark, d)
    m = mm.codebook(f).groupBy("mem").agg(F.count("*").alias("m"))
    return f.groupBy("mem").agg(F.sum("n").cast("double").alias("n")).join(m, "mem").withColumn("m", F.greatest("m", F.lit(2)).cast("double"))


@query("C10_expected_accuracy", f"WITH {_SIZES} SELECT mem, round({_acc('n', f'{D}.0', 'm')}, 6) AS expected FROM sz")
def c10(spark, d):
    return _sizes(spark, d).select("mem", F.round(ct.predicted_accuracy(F.col("n"), F.lit(float(D)), F.col("m")), 6).alias("expected"))


@query("C11_semantic_memory", f"""WITH {q.FACTS}, {q.BOOK}, {q.HV}, {q.STATE}, ask AS (SELECT DISTINCT mem, s, r, k FROM st),
 d AS (SELECT a.mem, a.s, a.r, b.o, {q.ham('a.k', 'b.k')} AS dist, b.ord FROM ask a JOIN st b ON a.mem = b.mem AND a.r = b.r),
 n AS (SELECT *, row_number() OVER (PARTITION BY mem, s, r ORDER BY dist, ord) AS rn, lead(dist) OVER (PARTITION BY mem, s, r ORDER BY dist, ord) AS next FROM d)
SELECT mem, s, r, o AS answer, dist, coalesce(next - dist, dist)::INT AS margin FROM n WHERE rn = 1""")
def c11(spark, d):
    f = facts(spark, d)
    ask = _asked(f).select("mem", "s", "r", mm.key(F.col("s"), F.col("r"), W).alias("k"))
    held = f.select("mem", "r", "ord", F.col("o").alias("answer"), mm.key(F.col("s"), F.col("r"), W).alias("held"))
    dist = ask.join(held, ["mem", "r"]).select("mem", "s", "r", "ord", "answer", w.hamming(F.col("k"), F.col("held"), W).alias("dist"))
    order = Window.partitionBy("mem", "s", "r").orderBy("dist", "ord")
    ranked = dist.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("dist").over(order))
    return ranked.where("rn = 1").select("mem", "s", "r", "answer", "dist", F.coalesce(F.col("next") - F.col("dist"), F.col("dist")).alias("margin"))


@query("C12_inverse", f"WITH {q.FACTS} SELECT mem, ord, s, r, o, n FROM f UNION ALL SELECT mem, ord, o, r || '_inv', s, n FROM f")
def c12(spark, d):
    return mm.with_inverse(facts(spark, d))


@query("C15_relation_variants", "WITH r AS (SELECT DISTINCT r, list_distinct(list_transform(string_split(r, '_'), lambda x: rtrim(x, 's'))) AS t FROM facts WHERE r IS NOT NULL) SELECT a.r AS planned, b.r AS variant FROM r a JOIN r b ON list_has_any(a.t, b.t)")
def c15(spark, d):
    r = table(spark, d, "facts").where("r is not null").select("r").distinct().withColumn("t", F.transform(F.split("r", "_"), lambda x: F.regexp_replace(x, "s+$", "")))
    a, b = r.select(F.col("r").alias("planned"), F.explode(F.array_distinct("t")).alias("t")), r.select(F.col("r").alias("variant"), F.explode(F.array_distinct("t")).alias("t"))
    return a.join(b, "t").select("planned", "variant").distinct()


@query("C16_relation_vocabulary", "SELECT r, count(*) AS n FROM facts WHERE r IS NOT NULL GROUP BY r ORDER BY n DESC, r LIMIT 60")
def c16(spark, d):
    return table(spark, d, "facts").where("r is not null").groupBy("r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r").limit(60)


@query("M1_M2_confidence", f"WITH {q.MEMORY}, {_ASK} SELECT mem, s, r, round(({D} / 2.0 - dist) / (sqrt({D}) / 2), 6) AS z, {_CONF} AS conf FROM {q.cleanup('ask', 's, r')}")
def m1(spark, d):
    f = facts(spark, d)
    return mm.query(f, _asked(f), W).select("mem", "s", "r", F.round(mm.z_score(F.col("dist"), W), 6).alias("z"), F.round(ct.confidence(F.col("dist"), D), 6).alias("conf"))


@query("M3_M5_capacity", f"WITH {_SIZES} SELECT mem, round({_zg('m')}, 6) AS z_gumbel, round({_acc('n', f'{D}.0', 'm')}, 6) AS accuracy, round({_cap(f'{D}.0', 'm')}, 6) AS capacity FROM sz")
def m3(spark, d):
    m, n, dim = F.col("m"), F.col("n"), F.lit(float(D))
    return _sizes(spark, d).select("mem", F.round(ct.z_gumbel(m), 6).alias("z_gumbel"), F.round(ct.predicted_accuracy(n, dim, m), 6).alias("accuracy"), F.round(ct.capacity(dim, m), 6).alias("capacity"))


def _rec(start: int) -> str:
    return "CASE " + " ".join(f"WHEN n <= 0.5 * {_cap(f'{start << k}.0', 'm')} THEN {start << k}" for k in range(int(math.log2((1 << 20) // start)))) + f" ELSE {1 << 20} END"


_STATS_SQL = f"""WITH {_SIZES}, a AS (SELECT *, {_cap(f'{D}.0', 'm')} AS cap, {_acc('n', f'{D}.0', 'm')} AS acc, {_acc('(n + 100)', f'{D}.0', '(m + 200)')} AS acch FROM sz)
SELECT mem, n::BIGINT AS facts, {D} AS dimension, m::BIGINT AS codebook, floor(cap)::BIGINT AS estimated_capacity, round(n / cap, 2) AS pressure, round(acc, 3) AS expected_accuracy,
 round(0.81, 3) AS grounding_contract, round(0.81 * acc, 3) AS projected_accuracy, greatest(floor(cap)::BIGINT - n::BIGINT, 0) AS capacity_remaining, round(acch, 3) AS expected_after_horizon,
 100 AS horizon, round(sqrt(2 * {D}.0 / (pi() * n)) - {_zg('m')}, 1) AS confidence_margin_sigma, {_rec(D)} AS recommended_dimension,
 CASE WHEN 0.81 < acc THEN 'grounding' ELSE 'capacity' END AS dominant_error, CASE WHEN acc > 0 AND acc < 1 THEN least(floor(ln(0.5) / ln(acc)), 1000000)::BIGINT ELSE 99 END AS max_reasoning_depth_p50 FROM a"""


@query("M6_stats", _STATS_SQL)
def m6(spark, d):
    m, n, dim = F.col("m"), F.col("n"), F.lit(float(D))
    acc, cap, pg = F.col("acc"), F.col("cap"), 0.9**2
    base = _sizes(spark, d).withColumn("cap", ct.capacity(dim, m)).withColumn("acc", ct.predicted_accuracy(n, dim, m)).withColumn("acch", ct.predicted_accuracy(n + 100, dim, m + 200))
    whole = F.floor(cap)
    return base.select(
        "mem", n.cast("bigint").alias("facts"), F.lit(D).alias("dimension"), m.cast("bigint").alias("codebook"), whole.alias("estimated_capacity"),
        F.round(n / cap, 2).alias("pressure"), F.round(acc, 3).alias("expected_accuracy"), F.lit(round(pg, 3)).alias("grounding_contract"), F.round(pg * acc, 3).alias("projected_accuracy"),
        F.greatest(whole - n.cast("bigint"), F.lit(0)).alias("capacity_remaining"), F.round("acch", 3).alias("expected_after_horizon"), F.lit(100).alias("horizon"),
        F.round(F.sqrt(2 * dim / (math.pi * n)) - ct.z_gumbel(m), 1).alias("confidence_margin_sigma"), ct.recommended_dim(n, m, D).alias("recommended_dimension"),
        F.when(pg < acc, "grounding").otherwise("capacity").alias("dominant_error"),
        F.when((acc > 0) & (acc < 1), F.least(F.floor(F.log(F.lit(0.5)) / F.log(acc)), F.lit(1000000))).otherwise(99).alias("max_reasoning_depth_p50"),
    )


@query("M7_aliasing", f"""WITH {q.FACTS}, sj AS (SELECT mem, s, r, arg_max(o, ord) AS o FROM f GROUP BY mem, s, r), ob AS (SELECT mem, o, r, count(*) AS c FROM f GROUP BY mem, o, r),
 {_CHAINS}, h1 AS (SELECT ch.mem, ch.s, r1, r2, greatest(1, (sj.o IS NOT NULL)::INT + coalesce(c, 0)) AS g1, coalesce(sj.o, ch.s) AS node FROM ch LEFT JOIN sj ON sj.mem = ch.mem AND sj.s = ch.s AND sj.r = r1 LEFT JOIN ob ON ob.mem = ch.mem AND ob.o = ch.s AND ob.r = r1),
 h2 AS (SELECT h1.mem, h1.s, r1, r2, g1, greatest(1, (sj.o IS NOT NULL)::INT + coalesce(c, 0)) AS g2 FROM h1 LEFT JOIN sj ON sj.mem = h1.mem AND sj.s = h1.node AND sj.r = r2 LEFT JOIN ob ON ob.mem = h1.mem AND ob.o = h1.node AND ob.r = r2)
SELECT mem, round(avg(1.0 / (g1 * g2)), 3) AS aliasing_factor, list_sort(list_distinct(list_filter(list(CASE WHEN g1 > 1 THEN r1 END) || list(CASE WHEN g2 > 1 THEN r2 END), lambda x: x IS NOT NULL))) AS aliasing_relations FROM h2 GROUP BY mem""")
def m7(spark, d):
    f = facts(spark, d)
    last = f.groupBy("mem", "s", "r").agg(F.max_by("o", "ord").alias("to"))
    into = f.groupBy("mem", F.col("o").alias("s"), "r").agg(F.count("*").alias("c"))
    a = f.select("mem", "s", F.col("r").alias("r1"), F.col("o").alias("b"))
    b = f.select("mem", F.col("s").alias("b"), F.col("r").alias("r2"))
    at = a.join(b, ["mem", "b"]).select("mem", F.col("s").alias("start"), "r1", "r2").distinct().withColumn("node", F.col("start"))
    for h in ("1", "2"):
        step = at.withColumn("s", F.col("node")).withColumn("r", F.col(f"r{h}")).join(last, ["mem", "s", "r"], "left").join(into, ["mem", "s", "r"], "left")
        at = step.withColumn(f"g{h}", F.greatest(F.lit(1), F.col("to").isNotNull().cast("int") + F.coalesce("c", F.lit(0)))).withColumn("node", F.coalesce("to", "node")).drop("s", "r", "to", "c")
    bad = F.array_union(F.collect_set(F.when(F.col("g1") > 1, F.col("r1"))), F.collect_set(F.when(F.col("g2") > 1, F.col("r2"))))
    return at.groupBy("mem").agg(F.round(F.avg(1 / (F.col("g1") * F.col("g2"))), 3).alias("aliasing_factor"), F.array_sort(bad).alias("aliasing_relations"))


@query("M10_recommended_dim", f"WITH {_SIZES} SELECT mem, {_rec(1024)} AS dim FROM sz")
def m10(spark, d):
    return _sizes(spark, d).select("mem", ct.recommended_dim(F.col("n"), F.col("m"), 1024).alias("dim"))


@query("M11_error_composition", "SELECT eps / 100.0 AS eps, round(pr * (1 - eps / 100.0), 6) AS missing, round(pr * (1 - eps / 100.0) * (1 - eps / 100.0), 6) AS wrong, round(pr / (1 + eps / 100.0), 6) AS spurious FROM (SELECT unnest([0, 5, 10, 20, 30]) AS eps, avg(hit::INT) AS pr FROM results WHERE hit IS NOT NULL) ")
def m11(spark, d):
    pr = table(spark, d, "results").agg(F.avg(F.col("hit").cast("int")).alias("pr"))
    eps = F.col("e") / 100
    return pr.select("pr", F.explode(F.array(*map(F.lit, [0, 5, 10, 20, 30]))).alias("e")).select(eps.alias("eps"), F.round(F.col("pr") * (1 - eps), 6).alias("missing"), F.round(F.col("pr") * (1 - eps) * (1 - eps), 6).alias("wrong"), F.round(F.col("pr") / (1 + eps), 6).alias("spurious"))


@query("M12_binomial_ci", "SELECT run_id, count(*) AS n, round(avg(hit::INT), 6) AS p, round(1.96 * sqrt(avg(hit::INT) * (1 - avg(hit::INT)) / count(*)), 6) AS half FROM results WHERE hit IS NOT NULL GROUP BY run_id")
def m12(spark, d):
    p = F.avg(F.col("hit").cast("int"))
    return table(spark, d, "results").where("hit is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.round(p, 6).alias("p"), F.round(1.96 * F.sqrt(p * (1 - p) / F.count("*")), 6).alias("half"))


@query("M14_t_interval", "SELECT run_id, count(*) AS n, round(avg(conf), 6) AS mean, round(2.262 * stddev_samp(conf) / sqrt(count(*)), 6) AS half FROM results WHERE conf IS NOT NULL AND NOT isnan(conf) GROUP BY run_id HAVING count(*) > 1")
def m14(spark, d):
    rows = table(spark, d, "results").where("conf is not null and not isnan(conf)").groupBy("run_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean"), F.round(2.262 * F.stddev_samp("conf") / F.sqrt(F.count("*")), 6).alias("half")).where("n > 1")


_GRID = "g AS (SELECT dim, n, " + _acc("n", "dim", "(3.0 * n)") + " AS acc FROM (SELECT unnest([512.0, 1024.0, 2048.0, 4096.0]) AS dim), (SELECT unnest(range(10, 500, 10))::DOUBLE AS n))"


def _grid(spark):
    n, dim = F.col("n"), F.col("dim")
    g = spark.range(10, 500, 10).select(F.col("id").cast("double").alias("n")).select("n", F.explode(F.array(*map(F.lit, [512.0, 1024.0, 2048.0, 4096.0]))).alias("dim"))
    return g.withColumn("acc", ct.predicted_accuracy(n, dim, 3.0 * n))


@query("M15_collapse_load", f"WITH {_GRID}, l AS (SELECT *, lag(acc) OVER w AS a0, lag(n) OVER w AS n0 FROM g WINDOW w AS (PARTITION BY dim ORDER BY n)) SELECT dim, round(min(n0 + (a0 - 0.5) / (a0 - acc) * (n - n0)), 6) AS n_star FROM l WHERE a0 >= 0.5 AND acc < 0.5 GROUP BY dim")
def m15(spark, d):
    order = Window.partitionBy("dim").orderBy("n")
    g = _grid(spark).withColumn("a0", F.lag("acc").over(order)).withColumn("n0", F.lag("n").over(order)).where("a0 >= 0.5 and acc < 0.5")
    return g.groupBy("dim").agg(F.round(F.min(F.col("n0") + (F.col("a0") - 0.5) / (F.col("a0") - F.col("acc")) * (F.col("n") - F.col("n0"))), 6).alias("n_star"))


@query("M16_fit", f"WITH {_GRID}, x AS (SELECT dim, ln(n) AS x, ln(acc / (1 - acc)) AS y FROM g WHERE acc > 0.001 AND acc < 0.999) SELECT dim, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x GROUP BY dim")
def m16(spark, d):
    g = _grid(spark).where("acc > 0.001 and acc < 0.999").select("dim", F.log("n").alias("x"), F.log(F.col("acc") / (1 - F.col("acc"))).alias("y"))
    return g.groupBy("dim").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))

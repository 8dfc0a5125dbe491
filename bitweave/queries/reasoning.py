"""Multi-hop answers over text and facts, batched episodes and remaining lifecycle operators (X, L, C, T rows)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from bitweave.catalog import query
from bitweave.functions import contract as ct
from bitweave.functions import text as tx
from bitweave.functions import words as w
from bitweave.operators import memory as mm
from bitweave.operators import store as st
from bitweave.queries import oracle as q
from bitweave.queries import stores, texts
from bitweave.queries.algebra import facts
from bitweave.session import stored, table

_THEORY_RULES = [
    (r"^(\w+) is (\w+)\.?$", "fact"),
    (r"^If (?:someone|something) is (.+?) then (?:they|it) (?:are|is) (\w+)\.?$", "if"),
    (r"^(?:All )?(.+?) (?:people|things) are (\w+)\.?$", "all"),
]
_THEORIES = [(1, "Anne is kind. Bob is big. If someone is kind and quiet then they are nice. All big people are green."), (2, "Cleo is red. Nonsense here! If something is red then it is round. Smart, kind things are rare."), (3, "")]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in _THEORIES)


def _case(column: str, kind: int) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {{'kind': '{k}', 'a': regexp_extract({column}, '{p}', 1), 'b': regexp_extract({column}, '{p}', 2)}}" for p, k in _THEORY_RULES)


@query("T11_theory", f"WITH t(id, theory) AS (VALUES {_VALUES}), s AS (SELECT id, unnest(string_split_regex(theory, '\\. ')) AS x FROM t), m AS (SELECT id, x, CASE {_case('x', 0)} END AS p FROM s WHERE trim(x) <> '') SELECT id, p.kind AS kind, list_transform(string_split_regex(lower(p.a), ', *| and '), lambda t: trim(t)) AS premises, lower(p.b) AS conclusion FROM m WHERE p IS NOT NULL")
def t11(spark, d):
    """Facts and rules of small theories in controlled English; sentences of no pattern are left out."""
    s = spark.createDataFrame(_THEORIES, "id int, theory string").select("id", F.explode(F.split("theory", r"\. ")).alias("x")).where("trim(x) <> ''")
    out = F.lit(None).cast("struct<kind:string,a:string,b:string>")
    for p, k in reversed(_THEORY_RULES):
        out = F.when(F.col("x").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("x", p, 1).alias("a"), F.regexp_extract("x", p, 2).alias("b"))).otherwise(out)
    m = s.select("id", out.alias("p")).where("p is not null")
    return m.select("id", "p.kind", F.transform(F.split(F.lower("p.a"), ", *| and "), F.trim).alias("premises"), F.lower("p.b").alias("conclusion"))


_X1 = f"""{q.MEMORY}, pl AS (SELECT DISTINCT a.mem, a.s AS anchor, a.r AS r1 FROM f a),
 ak AS (SELECT pl.mem, anchor, r1, {q.bind('trace', q.bind('h.v', 'r.v'))} AS noisy FROM pl JOIN tr USING (mem) JOIN hv h ON h.name = pl.anchor JOIN rv r ON r.name = pl.r1),
 an AS (SELECT mem, anchor, r1, answer, dist, 1 / (1 + exp(-((512.0 - dist) / 16.0) / 8)) AS conf FROM {q.cleanup('ak', 'anchor, r1')}),
 sr AS (SELECT mem, s, r, arg_max(o, ord) AS last, max(ord) AS source FROM f GROUP BY mem, s, r)"""


@query("X1_V11_answer", f"WITH {_X1} SELECT an.mem, anchor, r1 AS relation, answer, round(conf, 6) AS conf, source FROM an JOIN sr ON sr.mem = an.mem AND sr.s = an.anchor AND sr.r = an.r1 WHERE conf >= 0.60 AND answer <> anchor")
def x1(spark, d):
    """Answers whose confidence reaches 0.60 and that are not the anchor itself, with the fact they come from (the last one of subject and relation)."""
    f = facts(spark, d)
    got = mm.query(f, f.select("mem", "s", "r").distinct(), q.W).withColumn("conf", ct.confidence(F.col("dist"), 32 * q.W))
    source = f.groupBy("mem", "s", "r").agg(F.max("ord").alias("source"))
    kept = got.where((F.col("conf") >= 0.60) & (F.col("answer") != F.col("s"))).join(source, ["mem", "s", "r"])
    return kept.select("mem", F.col("s").alias("anchor"), F.col("r").alias("relation"), "answer", F.round("conf", 6).alias("conf"), "source")


_BEAM = f"""{stores._E}, {stores._NN}, b2 AS (SELECT nn.q, x.vec_id AS ans, nn.dist AS d1, {q.ham('m.words', 'x.words', 2)} AS d2, nn.vec_id AS bridge FROM nn JOIN e m ON m.vec_id = nn.vec_id JOIN e x ON x.label = m.label AND x.vec_id <> m.vec_id AND x.vec_id <> nn.q WHERE nn.rank <= 3),
 sc AS (SELECT q, ans, bridge, round((1 / (1 + exp(-((32.0 - d1) / 4.0) / 8))) * (1 / (1 + exp(-((32.0 - d2) / 4.0) / 8))), 9) AS score FROM b2), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ans, bridge) AS n FROM sc)"""


@query("X5_beam", f"WITH {_BEAM} SELECT q, ans, bridge, round(score, 6) AS score FROM rk WHERE n = 1")
def x5(spark, d):
    """Two hops of search: three bridges per query, answers among the entries of a bridge's label, the compound score is the product of both confidences."""
    e = stores.entries(spark, d)
    near = st.knn(e, stores.asked(e), "vec_id", "words", 5, stores.W, ["label", "words"]).where("rank <= 3").select("q", F.col("vec_id").alias("bridge"), F.col("dist").alias("d1"), "label", F.col("words").alias("m"))
    x = e.select(F.col("vec_id").alias("ans"), "label", "words")
    both = near.join(x, "label").where("ans <> bridge and ans <> q").withColumn("d2", w.hamming(F.col("m"), F.col("words"), stores.W))
    score = F.round(ct.confidence(F.col("d1"), 64) * ct.confidence(F.col("d2"), 64), 9)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "ans", "bridge")
    best = both.select("q", "ans", "bridge", score.alias("score")).withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("q", "ans", "bridge", F.round("score", 6).alias("score"))


@query("X6_feedback", "WITH h AS (SELECT question_id, gold, count(*) AS n, sum(hit::INT)::BIGINT AS ok FROM results WHERE question_id IS NOT NULL AND gold IS NOT NULL AND hit IS NOT NULL GROUP BY question_id, gold) SELECT question_id, gold, n AS support, ok AS success, round(greatest(0.01, least(0.99, (1.0 + ok) / (2.0 + n))), 6) AS confidence, n > 10 AND (1.0 + ok) / (2.0 + n) > 0.9 AS hot FROM h")
def x6(spark, d):
    from bitweave.operators import edges as eg

    r = table(spark, d, "results").where("question_id is not null and gold is not null and hit is not null")
    h = r.groupBy("question_id", "gold").agg(F.count("*").alias("support"), F.sum(F.col("hit").cast("bigint")).alias("success"))
    conf = eg.beta_mean(F.col("success"), F.col("support"))
    return h.select("question_id", "gold", "support", "success", F.round(conf, 6).alias("confidence"), eg.is_hot(F.col("support"), conf).alias("hot"))


@query("L7_plan", f"WITH RECURSIVE {stores._E}, st AS (SELECT vec_id AS start, vec_id AS here, 0 AS step FROM e WHERE vec_id % 20 = 0 UNION ALL SELECT * FROM (SELECT s.start, y.vec_id AS here, s.step + 1 AS step FROM st s JOIN e x ON x.vec_id = s.here JOIN e y ON y.vec_id > s.here WHERE s.step < 3 QUALIFY row_number() OVER (PARTITION BY s.start, s.step ORDER BY {q.ham('x.words', 'y.words', 2)}, y.vec_id) = 1)) SELECT start, here, step FROM st")
def l7(spark, d):
    """Three steps from every asked entry, each to the nearest later one."""
    e = stores.entries(spark, d)
    at = stores.asked(e).select(F.col("vec_id").alias("start"), F.col("vec_id").alias("here"), F.col("words").alias("x"), F.lit(0).alias("step"))
    out = at
    order = Window.partitionBy("start").orderBy("dist", "vec_id")
    for k in range(1, 4):
        near = None
        for block in st.blocks(at, "start"):
            pairs = e.join(F.broadcast(block.select("start", "here", "x")), F.col("vec_id") > F.col("here"))
            found = pairs.withColumn("dist", w.hamming(F.col("x"), F.col("words"), stores.W)).withColumn("n", F.row_number().over(order)).where("n = 1")
            near = found if near is None else near.unionByName(found)
        at = stored(near.select("start", F.col("vec_id").alias("here"), F.col("words").alias("x"), F.lit(k).alias("step")), "step")
        out = out.unionByName(at)
    return out.select("start", "here", "step")


@query("S19_pages", "SELECT doc_id, (i // 2200)::INT AS page, substr(text, i + 1, 2200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 2200)) AS i FROM documents WHERE text <> '')")
def s19(spark, d):
    """Texts as pages of up to 2200 characters, numbered."""
    starts = F.expr("sequence(0, length(text) - 1, 2200)")
    return texts.docs(spark, d).where("text <> ''").select("doc_id", "text", F.posexplode(starts).alias("page", "i")).select("doc_id", "page", F.expr("substring(text, i + 1, 2200)").alias("chunk"))


@query("H2_entity_statistics", f"SELECT source, count(DISTINCT x) AS entities FROM (SELECT source, unnest({texts._ENT}) AS x FROM documents WHERE text IS NOT NULL) GROUP BY source")
def h2(spark, d):
    return texts.docs(spark, d).select("source", F.explode(tx.entities(F.col("text"))).alias("x")).groupBy("source").agg(F.countDistinct("x").alias("entities"))


@query("H36_capacity_table", "WITH g AS (SELECT dim, n FROM (SELECT unnest([1024.0, 8192.0]) AS dim), (SELECT unnest([100.0, 200.0, 400.0, 600.0]) AS n)) SELECT dim, n, round(sqrt(2 * dim / (pi() * n)), 6) AS z_signal FROM g")
def h36(spark, d):
    g = spark.createDataFrame([(a, b) for a in (1024.0, 8192.0) for b in (100.0, 200.0, 400.0, 600.0)], "dim double, n double")
    return g.select("dim", "n", F.round(F.sqrt(2 * F.col("dim") / (F.pi() * F.col("n"))), 6).alias("z_signal"))


@query("M8_M9_contract_text")
def m8(spark, d):
    """The contract of every memory as text."""
    from bitweave.queries.algebra import m6

    s = m6(spark, d)
    pad = lambda name: F.concat(F.rpad(F.lit(name), 28, "."), F.col(name).cast("string"))
    fields = [c for c in s.columns if c != "mem"]
    text = F.format_string("MEMORY CONTRACT\n  Capacity <= %d facts (D=%d, codebook=%d)\n  Expected accuracy >= %s at %d facts\n  Max depth = %d hops\n  Pressure = %s", "estimated_capacity", "dimension", "codebook", F.col("expected_accuracy").cast("string"), "facts", "max_reasoning_depth_p50", F.col("pressure").cast("string"))
    return s.select("mem", text.alias("contract"), F.concat_ws("\n", *[pad(c) for c in fields]).alias("report"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials: the regularised incomplete beta function at p, by its continued fraction."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(k), float(n - k + 1)
    if p > (a + 1) / (a + b + 2):
        return 1 - binomial_tail(n - k + 1, n, 1 - p)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * p / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@query("M13_clopper_pearson")
def m13(spark, d):
    """Exact binomial intervals of every run's hit rate, by bisection of the binomial distribution, whose tail
    is a regularised incomplete beta function: its cost does not grow with the run."""
    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        tail = binomial_tail
        rows = []
        for k, n in zip(ks, ns):
            ends = []
            for upper in (False, True):
                low, high = 0.0, 1.0
                for _ in range(60):
                    mid = (low + high) / 2
                    p = 1 - tail(k + 1, n, mid) if upper else tail(k, n, mid)
                    low, high = (low, mid) if (p < 0.025) == upper else (mid, high)
                ends.append((low + high) / 2)
            rows.append((0.0 if k == 0 else ends[0], 1.0 if k == n else ends[1]))
        return pd.DataFrame(rows, columns=["low", "high"])

    r = table(spark, d, "results").where("hit is not null").groupBy("run_id").agg(F.sum(F.col("hit").cast("int")).alias("k"), F.count("*").cast("int").alias("n"))
    return r.withColumn("i", interval("k", "n")).select("run_id", "k", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("I13_probe")
def i13(spark, d):
    """Logistic probe of the label's lowest bit from the state's bits, on a hash split, against the majority."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = stores.entries(spark, d).where("label is not null")
    rows = e.select("vec_id", array_to_vector(w.unpack(F.col("words")).cast("array<double>")).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows.where(~test))
    judged = model.transform(rows.where(test))
    return judged.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy"), F.round(F.greatest(F.avg("label"), 1 - F.avg("label")), 4).alias("baseline"))


@query("E2_svd_encoder")
def e2(spark, d):
    """256 hashed features of every text projected on the first principal directions, as signs."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    feats = tx.hashed_features(texts.docs(spark, d), "doc_id", "text").groupBy("doc_id", (F.col("bucket") % 256).alias("b")).agg(F.sum("w2").cast("double").alias("v"))
    dense = feats.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    rows = dense.select("doc_id", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))).alias("x"))
    made = PCA(k=32, inputCol="x", outputCol="y").fit(rows).transform(rows)
    return made.select("doc_id", w.let(F.transform(vector_to_array("y"), lambda v: (v >= 0).cast("int")), lambda b: w.pack(b, 1)).alias("state"))

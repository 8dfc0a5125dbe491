"""Queries of the training-data problems, named pN_..., and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm import bpe, canon, names, packing, skeleton, survivor, topn, truncation
from bitweave.session import spread, stored, table

SNAPSHOT = "2026-06-30 00:00:00+00:00"


name_key = names.name_key
NAME_RELATIONS = ["directed_by", "written_by", "portrayed_by", "founded_by", "employed_by", "member_of", "produced_by", "mentored_by"]


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name keys of edges and triples, one row per occurrence after a map-side distinct."""
    edges = table(spark, sf_dir, "edges")
    triple = table(spark, sf_dir, "pilot_extraction").select(F.explode("triples").alias("t"))
    third = F.when(F.get("t", F.lit(1)).isin(NAME_RELATIONS), F.get("t", F.lit(2)))
    ends = edges.select(F.explode(F.array(F.when(~name_key(F.col("source")).startswith("_bridge_"), F.col("source")), F.col("target"))).alias("x"))
    return ends.unionByName(triple.select(F.explode(F.array(F.get("t", F.lit(0)), third)).alias("x"))).select(name_key(F.col("x")).alias("name")).distinct()


def _name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = table(spark, sf_dir, "ref_entities").where("kind in ('work', 'place')")
    return names.link_names(name_keys(spark, sf_dir), "name", others, "canon_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different name keys of one person or organisation."""
    return names.pairs_of(_name_groups(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership instead of pairs: every linked name key with the one that stands for its group."""
    return _name_groups(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose gold and answer look the same but are stored differently."""
    return skeleton.same_look(table(spark, sf_dir, "results"), "gold", "ans", "result_id")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of gold and answers with the number of spellings it is stored in."""
    return skeleton.looks(table(spark, sf_dir, "results"), ["gold", "ans"])


def _usable_confidence() -> Column:
    return F.col("confidence").between(0.0, 1.0)


def _usable_support() -> Column:
    return (F.col("support") >= 0) & (F.col("support") == F.col("success") + F.col("failure"))


def _edge_bundles() -> list[survivor.Bundle]:
    seen = (F.col("last_seen") >= F.col("first_seen")) & (F.col("last_seen") <= F.lit(SNAPSHOT).cast("timestamp"))
    support = F.col("support")
    return [
        survivor.Bundle("confidence", ("confidence",), _usable_confidence(), F.when(_usable_support(), support + 1).otherwise(0)),
        survivor.Bundle("support", ("support", "success", "failure"), _usable_support(), support),
        survivor.Bundle("last_seen", ("first_seen", "last_seen"), seen, F.unix_micros("last_seen") + (1 << 60)),
        survivor.Bundle("version", ("version",), F.col("version") >= 1, F.col("version").cast("bigint")),
    ]


VALUE_RELATIONS = ["based_in", "located_in", "born_in", "headquartered_in", "held_position", "profession"]


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, value) of the anchors (pos 0) and of the place and position objects of the k-th
    triple (pos k). A question delivered again counts once; should its content differ, the
    smallest value counts."""
    asked = table(spark, sf_dir, "pilot_extraction")
    anchor = asked.select("id", F.lit(0).cast("bigint").alias("pos"), F.col("plan.anchor").alias("value"))
    triple = asked.select("id", F.posexplode("triples").alias("k", "t")).where(F.get("t", F.lit(1)).isin(VALUE_RELATIONS))
    placed = triple.select("id", (F.col("k") + 1).cast("bigint").alias("pos"), F.get("t", F.lit(2)).alias("value"))
    return anchor.unionByName(placed).where("value is not null").groupBy("id", "pos").agg(F.min("value").alias("value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the reference list that each typed anchor, place or position stands for."""
    refs = table(spark, sf_dir, "ref_entities")
    return canon.map_values(typed_values(spark, sf_dir), "value", refs, "canon_id", "canon_name").select("id", "pos", "canon_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand for no entry, with the number of places where they are typed."""
    refs = table(spark, sf_dir, "ref_entities")
    mapped = canon.map_values(typed_values(spark, sf_dir), "value", refs, "canon_id", "canon_name")
    return mapped.where("canon_id = -1").groupBy("value").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge that supplies each field of the surviving record of every group of two or more."""
    edges = table(spark, sf_dir, "edges")
    keys = [name_key(F.col("source")), name_key(F.col("target"))]
    return survivor.best_bundles(edges, keys, F.col("edge_id"), _edge_bundles()).drop("k0", "k1")


def _dependent_bundles(spark: SparkSession, sf_dir: str) -> tuple:
    """The version determines the texts: payload, chunk and provenance are taken together, from a
    record of the version that is chosen. A version is worth its number, a text a point per field."""
    keys = [name_key(F.col("source")), name_key(F.col("target"))]
    filled = sum((F.col(c).isNotNull().cast("bigint") for c in ("bridge_chunk", "provenance")), F.lit(1))
    version = F.col("version")
    bundles = [
        *_edge_bundles()[:3],
        survivor.Bundle("version", ("version",), version.between(1, (1 << 30) - 1), version.cast("bigint")),
        survivor.Bundle("text", ("answer_payload", "bridge_chunk", "provenance"), F.col("answer_payload").isNotNull(), filled),
    ]
    return table(spark, sf_dir, "edges"), keys, F.col("edge_id"), bundles, "version", version, "text"


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of the surviving record where the version determines the texts."""
    return survivor.consistent_bundles(*_dependent_bundles(spark, sf_dir)).drop("k0", "k1")


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the search for p4_survivors the root settles and the bound cuts."""
    return survivor.search_effort(*_dependent_bundles(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five edges of highest usable confidence of every source."""
    edges = table(spark, sf_dir, "edges").where(_usable_confidence())
    top = topn.top_n_by_bisection(edges, name_key(F.col("source")), topn.score_words(F.col("confidence")), F.col("edge_id"), 5)
    return top.select(F.col("grp").alias("source"), F.col("ident").alias("edge_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, sized in tokens, in a container of each kind."""
    sizes = stored(bpe.count_tokens(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "tokens", table(spark, sf_dir, "containers"), "container", "capacity")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    capacity = table(spark, sf_dir, "containers")
    used = p7_packed(spark, sf_dir).groupBy("container").agg((F.max("bin") + 1).alias("bins"), F.sum("tokens").alias("tokens"))
    return used.join(capacity, "container").select("container", "capacity", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("fill"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.cut_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation.cut_shares(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p8_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct texts each branch of the decision judges, and how many of them as cut."""
    return truncation.judged_texts(table(spark, sf_dir, "documents"), "text").groupBy("branch").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))


_P4_BASE = """
 e AS (SELECT edge_id, lower(trim(source)) AS s, lower(trim(target)) AS t, version,
        answer_payload, bridge_chunk, provenance, last_seen,
        CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS c,
        CASE WHEN support >= 0 AND support = success + failure THEN support END AS u,
        CASE WHEN last_seen >= first_seen AND last_seen <= TIMESTAMPTZ '2026-06-30 00:00:00+00' THEN last_seen END AS l,
        CASE WHEN version >= 1 THEN version END AS v
   FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
 g AS (SELECT s, t, min(edge_id) AS group_id FROM e GROUP BY s, t HAVING count(*) >= 2),
 rc AS (SELECT s, t, edge_id, row_number() OVER (PARTITION BY s, t ORDER BY u DESC NULLS LAST, edge_id) AS n FROM e WHERE c IS NOT NULL),
 ru AS (SELECT s, t, edge_id, row_number() OVER (PARTITION BY s, t ORDER BY u DESC, edge_id) AS n FROM e WHERE u IS NOT NULL),
 rl AS (SELECT s, t, edge_id, row_number() OVER (PARTITION BY s, t ORDER BY l DESC, edge_id) AS n FROM e WHERE l IS NOT NULL)"""

SQL = {
    "p4_found": f"""WITH {_P4_BASE},
 rv AS (SELECT s, t, edge_id, row_number() OVER (PARTITION BY s, t ORDER BY v DESC, edge_id) AS n FROM e WHERE v IS NOT NULL)
SELECT group_id, coalesce(rc.edge_id, -1) AS confidence_from, coalesce(ru.edge_id, -1) AS support_from,
       coalesce(rl.edge_id, -1) AS last_seen_from, coalesce(rv.edge_id, -1) AS version_from
FROM g LEFT JOIN rc ON rc.s = g.s AND rc.t = g.t AND rc.n = 1 LEFT JOIN ru ON ru.s = g.s AND ru.t = g.t AND ru.n = 1
 LEFT JOIN rl ON rl.s = g.s AND rl.t = g.t AND rl.n = 1 LEFT JOIN rv ON rv.s = g.s AND rv.t = g.t AND rv.n = 1""",
    "p4_survivors": f"""WITH {_P4_BASE},
 b AS (SELECT s, t, v, min(edge_id) AS v_id FROM e WHERE v < 1073741824 GROUP BY s, t, v),
 x AS (SELECT s, t, version, edge_id, 1 + (bridge_chunk IS NOT NULL)::INT + (provenance IS NOT NULL)::INT AS f FROM e WHERE answer_payload IS NOT NULL),
 xb AS (SELECT s, t, version, edge_id, f, row_number() OVER (PARTITION BY s, t, version ORDER BY f DESC, edge_id) AS n FROM x),
 xr AS (SELECT s, t, edge_id, row_number() OVER (PARTITION BY s, t ORDER BY f DESC, edge_id) AS n FROM x),
 w AS (SELECT b.s, b.t, v_id, xb.edge_id AS x_id, row_number() OVER (PARTITION BY b.s, b.t ORDER BY v + coalesce(f, 0) DESC, v DESC) AS n
   FROM b LEFT JOIN xb ON xb.s = b.s AND xb.t = b.t AND xb.version = b.v AND xb.n = 1)
SELECT group_id, coalesce(v_id, -1) AS version_from, coalesce(CASE WHEN v_id IS NULL THEN xr.edge_id ELSE x_id END, -1) AS text_from,
       coalesce(rc.edge_id, -1) AS confidence_from, coalesce(ru.edge_id, -1) AS support_from, coalesce(rl.edge_id, -1) AS last_seen_from
FROM g LEFT JOIN rc ON rc.s = g.s AND rc.t = g.t AND rc.n = 1 LEFT JOIN ru ON ru.s = g.s AND ru.t = g.t AND ru.n = 1
 LEFT JOIN rl ON rl.s = g.s AND rl.t = g.t AND rl.n = 1 LEFT JOIN w ON w.s = g.s AND w.t = g.t AND w.n = 1
 LEFT JOIN xr ON xr.s = g.s AND xr.t = g.t AND xr.n = 1""",
    "p5_found": """SELECT source, edge_id FROM (
 SELECT lower(trim(source)) AS source, edge_id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY confidence DESC, edge_id) AS n
 FROM edges WHERE source IS NOT NULL AND confidence BETWEEN 0 AND 1) WHERE n <= 5""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_survivors": p4_survivors, "p4_search": p4_search, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_shares": p8_shares, "p8_branches": p8_branches}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

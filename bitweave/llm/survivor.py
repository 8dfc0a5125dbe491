"""Best representative of each duplicate group from consistent bundles of fields.

A bundle is a set of dependent fields that only make sense together (support, success and failure;
first and last sighting): it is taken whole from one record. Among the usable candidates of each
bundle the search maximises trust under functional dependencies between bundles.

Branch and bound: the root relaxation ignores the dependencies and takes the most trusted candidate
of every bundle, which one aggregation with map-side combining gives for all groups at once. Where
it meets the dependencies, as it always does without any, it is optimal and the group is done. The
other groups branch on the values of the determinant; a branch whose bound (the trust of its own
determinant plus the root's best dependent) is below the value of the incumbent is cut, the others
are compared. Records are read once: branches are aggregates, and the search runs over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.session import stored

# Trust and record id share one decimal: trust * 2**63 + (2**63 - 1 - id). Decimals, unlike
# structs, can live in the hash aggregate's buffer.
def _half() -> Column:
    return F.lit(1 << 62).cast("decimal(19,0)") * F.lit(2).cast("decimal(1,0)")


@dataclass(frozen=True)
class Bundle:
    """``usable``: whether a record's fields of this bundle make sense. ``trust``: BIGINT from 0 to
    2**61, larger is preferred; of equally trusted records the smaller id is."""

    name: str
    fields: tuple[str, ...]
    usable: Column
    trust: Column


def code(trust: Column, ident: Column) -> Column:
    """Order-preserving code of trust, then of the smaller identifier (from 0)."""
    return (trust.cast("decimal(19,0)") * _half() + (_half() - 1 - ident.cast("decimal(19,0)"))).cast("decimal(38,0)")


def ident_of(c: Column) -> Column:
    """The identifier in a code, -1 for a null code."""
    return F.coalesce((_half() - 1 - c % _half()).cast("bigint"), F.lit(-1).cast("bigint"))


def _candidates(df: DataFrame, keys: list[Column], ident: Column, bundles: list[Bundle]) -> DataFrame:
    picked = [F.when(b.usable, code(b.trust, ident)).alias(f"c_{b.name}") for b in bundles]
    flat = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], ident.alias("ident"), *picked)
    return flat.where(" and ".join(f"k{i} is not null" for i in range(len(keys))))


def best_bundles(df: DataFrame, keys: list[Column], ident: Column, bundles: list[Bundle], least: int = 2) -> DataFrame:
    """Root relaxation: of each group of ``least`` or more records the id that supplies each bundle.

    Columns: ``k0..``, ``group_id`` (the smallest id), ``<bundle>_from`` (-1 if no record of the
    group is usable). Records with a null key belong to no group. Ids are unique and not negative;
    a record repeated with its id changes nothing but the size of its group.
    """
    flat = _candidates(df, keys, ident, bundles)
    names = [f"k{i}" for i in range(len(keys))]
    grouped = flat.groupBy(*names).agg(
        F.count("*").alias("n"), F.min("ident").alias("group_id"), *[F.max(f"c_{b.name}").alias(f"c_{b.name}") for b in bundles]
    )
    return grouped.where(F.col("n") >= least).select(*names, "group_id", *[ident_of(F.col(f"c_{b.name}")).alias(f"{b.name}_from") for b in bundles])


def consistent_bundles(
    df: DataFrame, keys: list[Column], ident: Column, bundles: list[Bundle], determinant: str, by: Column, dependent: str, least: int = 2
) -> DataFrame:
    """As ``best_bundles``, where the bundle ``determinant`` determines the bundle ``dependent``:
    the record that supplies the dependent must agree in ``by`` with the one that supplies the
    determinant. Maximises the sum of both trusts, then the determinant's: trusts are points, and
    how many points a bundle's preference is worth beside another's is the caller's to say. Trusts
    of the two must stay below 2**30, and those of the determinant differ between values of ``by``.

    A group without a usable determinant keeps its best dependent; a branch without a usable
    dependent counts with trust 0 and supplies none (-1).
    """
    names = [f"k{i}" for i in range(len(keys))]
    branches, root = _branches(df, keys, ident, bundles, determinant, by, dependent, least)
    det, dep = determinant, dependent
    rest = [b.name for b in bundles if b.name not in (det, dep)]
    alive = _alive(branches, root, names)
    # The best branch left; its determinant's trust is its own within the group.
    rank = (F.col("value").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(19,0)") + _trust("det")).cast("decimal(38,0)")
    best = alive.groupBy(*names).agg(F.max(rank).alias("rank")).withColumn("det_trust", (F.col("rank") % F.lit(1 << 31).cast("decimal(19,0)")).cast("bigint"))
    chosen = branches.where("det is not null").withColumn("det_trust", _trust("det")).join(best, [*names, "det_trust"]).select(*names, "det", "dep")
    out = root.join(chosen, names, "left")
    return out.select(
        *names, "group_id", ident_of(F.col("det")).alias(f"{det}_from"),
        ident_of(F.when(F.col("det_root").isNull(), F.col("dep_root")).otherwise(F.col("dep"))).alias(f"{dep}_from"),
        *[ident_of(F.col(f"r_{b}")).alias(f"{b}_from") for b in rest],
    )


def _trust(c: str) -> Column:
    """The trust in a code, 0 for none."""
    return F.coalesce(((F.col(c) - F.col(c) % _half()) / _half()).cast("bigint"), F.lit(0))


def _branches(
    df: DataFrame, keys: list[Column], ident: Column, bundles: list[Bundle], determinant: str, by: Column, dependent: str, least: int
) -> tuple[DataFrame, DataFrame]:
    """The branches of every group, one per value of the determinant, and the root relaxations. The
    records are read once; both are stored, for the search uses them several times."""
    names = [f"k{i}" for i in range(len(keys))]
    rest = [b.name for b in bundles if b.name not in (determinant, dependent)]
    picked = [F.when(b.usable, code(b.trust, ident)).alias(f"c_{b.name}") for b in bundles]
    flat = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], ident.alias("ident"), by.alias("by"), *picked)
    flat = flat.where(" and ".join(f"k{i} is not null" for i in range(len(keys))))
    branches = stored(flat.groupBy(*names, "by").agg(
        F.count("*").alias("n"), F.min("ident").alias("group_id"), F.max(f"c_{determinant}").alias("det"), F.max(f"c_{dependent}").alias("dep"),
        *[F.max(f"c_{b}").alias(f"r_{b}") for b in rest],
    ), "branches")
    root = stored(branches.groupBy(*names).agg(
        F.sum("n").alias("n"), F.min("group_id").alias("group_id"), F.max("det").alias("det_root"), F.max("dep").alias("dep_root"),
        *[F.max(f"r_{b}").alias(f"r_{b}") for b in rest],
    ).where(F.col("n") >= least), "roots")
    return branches, root


def _alive(branches: DataFrame, root: DataFrame, names: list[str]) -> DataFrame:
    """The branches with a determinant whose bound, the trust of their own determinant plus the
    root's dependent, is not below the incumbent's value; with their ``value``. The incumbent is the
    branch of the root's determinant: where that branch has the root's dependent too, the root meets
    the dependency and no other branch survives."""
    joined = branches.where("det is not null").select(*names, "det", "dep").join(root.select(*names, "det_root", "dep_root"), names)
    joined = joined.withColumn("value", _trust("det") + _trust("dep"))
    incumbent = joined.where("det = det_root").select(*names, F.col("value").alias("incumbent"), F.col("dep").eqNullSafe(F.col("dep_root")).alias("met"))
    bound = _trust("det") + _trust("dep_root")
    return joined.join(incumbent, names).where((F.col("det") == F.col("det_root")) | ~F.col("met") & (bound >= F.col("incumbent")))


def search_effort(
    df: DataFrame, keys: list[Column], ident: Column, bundles: list[Bundle], determinant: str, by: Column, dependent: str, least: int = 2
) -> DataFrame:
    """One row on the search of ``consistent_bundles``: groups, groups that the root settles, branches
    and those that were compared (the others were cut by their bound)."""
    names = [f"k{i}" for i in range(len(keys))]
    branches, root = _branches(df, keys, ident, bundles, determinant, by, dependent, least)
    alive = _alive(branches, root, names).groupBy(*names).agg(F.count("*").alias("compared"))
    every = branches.where("det is not null").groupBy(*names).agg(F.count("*").alias("branches"))
    each = root.select(*names).join(every, names, "left").join(alive, names, "left").na.fill({"branches": 0, "compared": 0})
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("compared") <= 1).alias("settled_by_root"), F.sum("branches").alias("branches"), F.sum("compared").alias("compared"))

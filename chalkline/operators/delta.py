"""Changes between base and head. A missing row never means absence: only coverage proves that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_operation(base: Column, head: Column, renamed: Column, file_added: Column, file_removed: Column, is_file: Column, looked_up: Column, pure_added: Column, pure_removed: Column, opposite_mapped: Column) -> Column:
    """renamed, modified, added, removed or unresolved, by the first rule that applies.

    base, head: the symbol is there; looked_up: it was searched in the other revision; pure_added, pure_removed: all its
    line changes are; opposite_mapped: all lines opposite its changes (there are some) belong to other symbols.
    """
    one_side = F.when(head, "added").otherwise("removed")
    return (
        F.when(base & head, F.when(renamed, "renamed").otherwise("modified"))
        .when(file_added & head, "added")
        .when(file_removed & base, "removed")
        .when(is_file, "modified")
        .when(looked_up & ((head & pure_added) | (base & pure_removed)), one_side)
        .when(opposite_mapped, one_side)
        .otherwise("unresolved")
    )


def relation_operation(base: Column, head: Column, added_end: Column, removed_end: Column, base_proves: Column, head_proves: Column) -> Column:
    """retained, added, removed or null for a relation; one side alone counts if an endpoint changed or coverage proves the rest."""
    return (
        F.when(base & head, "retained")
        .when(head & (added_end | base_proves), "added")
        .when(base & (removed_end | head_proves), "removed")
        .otherwise(F.lit(None).cast("string"))
    )


def sides(rows: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """keys with in_base and in_head: one aggregate over both revisions in place of a full join."""
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(side) == "base"), F.lit(False)).alias("in_base"), F.coalesce(F.bool_or(F.col(side) == "head"), F.lit(False)).alias("in_head"))


def counterpart_delta(rows: DataFrame, keys: list[str], coverage: DataFrame, cover_keys: list[str], side: str = "side") -> DataFrame:
    """keys and operation: modified, added, removed, or unresolved where coverage (cover_keys) has no row for the key."""
    proven = coverage.select(*cover_keys).distinct().withColumn("proven", F.lit(True))
    joined = sides(rows, keys, side).join(proven, cover_keys, "left")
    none = F.lit(False)
    known = F.coalesce("proven", none)
    operation = change_operation(F.col("in_base"), F.col("in_head"), none, none, none, none, known, known, known, none)
    return joined.select(*keys, operation.alias("operation"))


def relation_delta(rows: DataFrame, source: str, target: str, changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """source, target and operation (null: undecided) of relations rows (source, target, side).

    changed: node and operation (added, removed); coverage: node and side whose relations are known completely.
    """
    both = sides(rows, [source, target])
    ends = changed.groupBy("node").agg(F.bool_or(F.col("operation") == "added").alias("node_added"), F.bool_or(F.col("operation") == "removed").alias("node_removed"))
    known = coverage.groupBy("node").agg(F.bool_or(F.col("side") == "base").alias("base_known"), F.bool_or(F.col("side") == "head").alias("head_known"))
    pick = lambda df, on, names: df.select(F.col("node").alias(on), *[F.col(a).alias(b) for a, b in names])
    joined = both.join(pick(ends, source, [("node_added", "a1"), ("node_removed", "r1")]), source, "left")
    joined = joined.join(pick(ends, target, [("node_added", "a2"), ("node_removed", "r2")]), target, "left")
    joined = joined.join(pick(known, source, [("base_known", "base_known"), ("head_known", "head_known")]), source, "left")
    yes = lambda *names: F.coalesce(*[F.when(F.col(n), True) for n in names], F.lit(False))
    operation = relation_operation(F.col("in_base"), F.col("in_head"), yes("a1", "a2"), yes("r1", "r2"), yes("base_known"), yes("head_known"))
    return joined.select(source, target, operation.alias("operation"))


def replacement_pairs(changes: DataFrame, key: str, links: list[str], kind: str) -> DataFrame:
    """removed_id, added_id and n_links of removed and added rows of one kind that share a link; many to many.

    changes: key, operation, kind and links (equal values link).
    """
    removed = changes.where("operation = 'removed'").select(F.col(key).alias("removed_id"), kind, *links)
    added = changes.where("operation = 'added'").select(F.col(key).alias("added_id"), kind, *links)
    return removed.join(added, [kind, *links]).groupBy("removed_id", "added_id", kind).agg(F.count("*").alias("n_links"))


def cross_revision_identity(symbols: DataFrame, side: str, identity: list[str], own: list[str]) -> DataFrame:
    """symbols with review_symbol_id: a digest of identity, or of own too where one side has the identity more than once."""
    counted = symbols.groupBy(*identity, side).count().groupBy(*identity).agg(F.max("count").alias("most"))
    joined = symbols.join(counted, identity)
    digest = lambda names: F.concat(F.lit("RS:"), F.substring(F.sha2(F.concat_ws("\0", *[F.col(n).cast("string") for n in names]), 256), 1, 20))
    return joined.withColumn("review_symbol_id", F.when(F.col("most") > 1, digest([*identity, side, *own])).otherwise(digest(identity))).drop("most")

"""Bounded selections: each candidate ends selected or deferred, and what a limit cut off is said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Associations and roles from strongest to weakest.
ASSOCIATIONS = ("provided_association", "explicit_reference", "exact_identifier", "distinctive_phrase", "claim_bridge", "structural_bridge", "current_head")
EVIDENCE_ROLES = ("primary", "test_support", "document_support")
# Conclusions of checks as the selection reads them.
CHECK_SUCCESS = ("success", "neutral", "skipped")
CHECK_FAILURE = ("failure", "failed", "error", "cancelled", "timed_out", "action_required")
CHECK_DONE = ("completed", "complete")


def tier_of(association: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ASSOCIATIONS)), association) - 1


def role_of(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EVIDENCE_ROLES)), role) - 1


def selection_order() -> list:
    """The order selections go by: slot, role, tier, ordinal, target."""
    return [F.col("slot"), role_of(F.col("evidence_role")), tier_of(F.col("association")), F.col("source_ordinal"), F.col("target_id")]


def candidate_order() -> list:
    """The order rankings are evaluated by: slot, ordinal, target, association by name. Not the order of selections."""
    return [F.col(c) for c in ("slot", "source_ordinal", "target_id", "association")]


def check_outcome(status: Column, conclusion: Column) -> Column:
    """failure, success, pending or unknown; here neutral and skipped are success, error and failed failures."""
    done = F.coalesce(status.isin(*CHECK_DONE), F.lit(False))
    return (
        F.when(conclusion.isin(*CHECK_FAILURE), "failure")
        .when(conclusion.isin(*CHECK_SUCCESS), "success")
        .when(~done | F.coalesce(conclusion == "pending", F.lit(False)), "pending")
        .otherwise("unknown")
    )


def canonical_targets(candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """candidates with canonical: the first of each target; the rest are its duplicates."""
    return candidates.withColumn("canonical", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def competitive_slot(candidates: DataFrame, group: list[str], tier: str, order: list, keep: int, inspect: int) -> DataFrame:
    """candidates with place, selected and ambiguous: the first keep of a group are selected; if the cut goes through
    equal tiers among the first inspect, the group is ambiguous."""
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    whole = Window.partitionBy(*group)
    seen = F.when(F.col("place") <= inspect, F.col(tier))
    at = F.max(F.when(F.col("place") == keep, seen)).over(whole)
    after = F.max(F.when(F.col("place") == keep + 1, seen)).over(whole)
    return ranked.withColumn("selected", F.col("place") <= keep).withColumn("ambiguous", F.coalesce(at == after, F.lit(False)))


def anchor_budget(candidates: DataFrame, group: list[str], bridged: str, order: list, direct_limit: int, bridged_limit: int, total_limit: int) -> DataFrame:
    """candidates with selected: direct ones first, up to their limit, then bridged ones up to theirs, within the total."""
    classes = Window.partitionBy(*group, bridged).orderBy(*order)
    ranked = candidates.withColumn("class_place", F.row_number().over(classes))
    within = F.when(F.col(bridged), F.col("class_place") <= bridged_limit).otherwise(F.col("class_place") <= direct_limit)
    ranked = ranked.withColumn("within", within)
    total = Window.partitionBy(*group).orderBy(F.col("within").desc(), bridged, *order)
    return ranked.withColumn("selected", F.col("within") & (F.row_number().over(total) <= total_limit)).drop("within", "class_place")


def check_convergence(checks: DataFrame, group: list[str], identity: list[str], outcome: str, order: list, identities: int) -> DataFrame:
    """Canonical checks with conflicting, identity_place and selected.

    A check's identity keeps one row, or one for each outcome where outcomes conflict; identities go failures first, then
    pending, then success, and so many are selected.
    """
    rank = F.when(F.col(outcome) == "failure", 0).when(F.col(outcome) == "pending", 1).when(F.col(outcome) == "success", 2).otherwise(3)
    per = Window.partitionBy(*group, *identity)
    rows = checks.withColumn("outcome_rank", rank)
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy(*group, *identity, outcome).orderBy(*order)))
    rows = rows.where("first = 1").withColumn("conflicting", F.count("*").over(per) > 1).withColumn("identity_rank", F.min("outcome_rank").over(per))
    rows = rows.withColumn("identity_place", F.dense_rank().over(Window.partitionBy(*group).orderBy("identity_rank", *identity)))
    return rows.withColumn("selected", F.col("identity_place") <= identities).drop("first", "outcome_rank", "identity_rank")


def admission_tiers(rows: DataFrame, group: list[str], item: str, tier: str, limit: int) -> DataFrame:
    """group, item, best tier and selected: each item's least tier, the first of them (tier, item) admitted."""
    best = rows.groupBy(*group, item).agg(F.min(tier).alias("tier"))
    return best.withColumn("selected", F.row_number().over(Window.partitionBy(*group).orderBy("tier", item)) <= limit)


def admission_state(admitted: DataFrame, group: list[str], baseline: Column) -> DataFrame:
    """group, n_selected, n_deferred and state: blocked if a baseline row is deferred, then empty, ready_truncated, ready."""
    counted = admitted.groupBy(*group).agg(F.count_if("selected").alias("n_selected"), F.count_if(~F.col("selected")).alias("n_deferred"), F.count_if(baseline & ~F.col("selected")).alias("lost"))
    state = F.when(F.col("lost") > 0, "blocked").when(F.col("n_selected") == 0, "empty").when(F.col("n_deferred") > 0, "ready_truncated").otherwise("ready")
    return counted.select(*group, "n_selected", "n_deferred", state.alias("state"))


def char_budget(rows: DataFrame, group: list[str], order: list, length: str, each: int, whole: int) -> DataFrame:
    """rows with used: the least of length, each, and what is left of the whole, in order."""
    capped = F.least(F.col(length), F.lit(each))
    before = F.coalesce(F.sum(capped).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("used", F.greatest(F.lit(0), F.least(capped, F.lit(whole) - before)))


def bounded_code(added: Column, removed: Column, budget: Column) -> tuple[Column, Column]:
    """Prefixes of added and removed text that share a budget: removed text has half of it at most, and what added text leaves."""
    a, r = F.length(added), F.length(removed)
    keep_a = F.greatest(F.lit(0), F.least(a, budget - F.least(r, F.floor(budget / 2))))
    keep_r = F.greatest(F.lit(0), F.least(r, budget - keep_a))
    return F.substring(added, F.lit(1), keep_a.cast("int")), F.substring(removed, F.lit(1), keep_r.cast("int"))


def partition_check(candidates: DataFrame, parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Counts of ids that parts miss, repeat or don't share with the candidates; all 0 if parts partition them."""
    from functools import reduce

    told = reduce(DataFrame.unionByName, [p.select(*key) for p in parts]).groupBy(*key).agg(F.count("*").alias("times"))
    own = candidates.select(*key).distinct().withColumn("own", F.lit(True))
    joined = own.join(told, key, "full_outer")
    return joined.agg(F.count_if(F.col("times").isNull()).alias("n_missing"), F.count_if(F.col("own").isNull()).alias("n_unknown"), F.count_if(F.col("times") > 1).alias("n_repeated"), F.count("*").alias("n_ids"))

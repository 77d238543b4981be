"""Roll-ups for a review's header and attention list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conclusions of checks as the header reads them.
CI_FAILURE = ("failure", "failed", "error", "cancelled", "timed_out")
CI_PASSING = ("success", "neutral", "skipped")
# Classes of membership from strongest to weakest, and states of model runs.
MEMBERSHIP = ("asserted", "matched", "suggested", "context", "unresolved")


def ci_state(checks: DataFrame, review: list[str], current: Column, conclusion: str = "conclusion") -> DataFrame:
    """review, n_checks and state: failure over passing over pending over the current head's conclusions.

    Only conclusions that there are count, so an unfinished check beside a success passes.
    """
    value = F.lower(F.when(current & (F.col(conclusion) != ""), F.col(conclusion)))
    folded = checks.groupBy(*review).agg(F.count_if(current).alias("n_checks"), F.bool_or(value.isin(*CI_FAILURE)).alias("failed"), F.bool_and(value.isin(*CI_PASSING)).alias("passed"))
    state = F.when(F.col("n_checks") == 0, "not_observed").when(F.col("failed"), "failure").when(F.col("passed"), "passing").otherwise("pending")
    return folded.select(*review, "n_checks", state.alias("state"))


def pull_request_state(merged: Column, draft: Column, state: Column) -> Column:
    plain = F.lower(F.coalesce(state, F.lit("")))
    return F.when(merged, "merged").when(draft, "draft").when(plain.isin("open", "closed"), plain).otherwise("unknown")


def diagnostic_groups(diagnostics: DataFrame, keys: list[str], focus: str, message: str) -> DataFrame:
    """keys, n_rows, n_foci, messages (joined) and owner: the focus of a group that has one, else the review."""
    folded = diagnostics.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(focus).alias("n_foci"), F.min(F.col(focus).cast("string")).alias("first_focus"), F.array_join(F.array_sort(F.collect_set(message)), ",").alias("messages"))
    owner = F.when(F.col("n_foci") == 1, F.concat(F.lit("focus:"), F.col("first_focus"))).otherwise("review")
    return folded.select(*keys, "n_rows", "n_foci", "messages", owner.alias("owner"))


def strongest_membership(rows: DataFrame, keys: list[str], membership: str) -> DataFrame:
    names = F.array(*map(F.lit, MEMBERSHIP))
    return rows.groupBy(*keys).agg(F.element_at(names, F.min(F.array_position(names, F.col(membership))).cast("int")).alias(membership))


def coverage_counts(coverage: DataFrame, review: list[str]) -> DataFrame:
    """review, n_seeds, n_complete and n_truncated of seed coverage (state)."""
    return coverage.groupBy(*review).agg(F.count("*").alias("n_seeds"), F.count_if(F.col("state") == "complete").alias("n_complete"), F.count_if(F.col("state") == "truncated").alias("n_truncated"))


def run_summary(observations: DataFrame, review: list[str]) -> DataFrame:
    """review, n_runs and state of runs (execution_state): empty, failed, partial or completed; not-run ones aren't counted."""
    ran = F.col("execution_state") != "not_run"
    folded = observations.groupBy(*review).agg(F.count_if(ran).alias("n_runs"), F.count_if(F.col("execution_state") == "accepted").alias("ok"))
    state = F.when(F.col("n_runs") == 0, "empty").when(F.col("ok") == 0, "failed").when(F.col("ok") < F.col("n_runs"), "partial").otherwise("completed")
    return folded.select(*review, "n_runs", state.alias("state"))


def component_membership(groups: DataFrame, members: DataFrame) -> DataFrame:
    """component, n_internal and n_boundary relation groups (group_id, source, target) by members (node, component)."""
    ends = groups.select("group_id", F.explode(F.array("source", "target")).alias("node")).join(members, "node").select("group_id", "component").groupBy("group_id", "component").agg(F.count("*").alias("ends"))
    return ends.groupBy("component").agg(F.count_if(F.col("ends") >= 2).alias("n_internal"), F.count_if(F.col("ends") == 1).alias("n_boundary"))

"""Verdicts on claims: contradicted, demonstrated, partial or unverified, and never more than the facts carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conclusions of checks as verdicts read them; neutral, skipped and error are neither.
SUCCESS = ("success",)
FAILURE = ("failure", "cancelled", "timed_out", "action_required", "startup_failure")
STATUSES = ("demonstrated", "partial", "contradicted", "unverified")
SUCCESS_WORDING = r"(?i)\b(?:success(?:ful(?:ly)?)?|succeed(?:s|ed)?|pass(?:es|ed)?|green)\b"


def expects_success(text: Column) -> Column:
    return text.rlike(SUCCESS_WORDING)


def rolled_status(any_contradicted: Column, all_demonstrated: Column, any_positive: Column) -> Column:
    return F.when(any_contradicted, "contradicted").when(all_demonstrated, "demonstrated").when(any_positive, "partial").otherwise("unverified")


def predicate_rollup(predicates: DataFrame, claim: list[str], status: str = "status") -> DataFrame:
    """claim, n_predicates and status of all its predicates' together."""
    s = F.col(status)
    folded = predicates.groupBy(*claim).agg(F.count("*").alias("n_predicates"), F.bool_or(s == "contradicted").alias("c"), F.bool_and(s == "demonstrated").alias("d"), F.bool_or(s.isin("demonstrated", "partial")).alias("p"))
    return folded.select(*claim, "n_predicates", rolled_status(F.col("c"), F.col("d"), F.col("p")).alias("status"))


def supporting_evidence(predicates: DataFrame, claim: list[str]) -> DataFrame:
    """claim with supporting ids less the contradicting ones, and those (arrays supporting, contradicting of each predicate)."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    folded = predicates.groupBy(*claim).agg(union("supporting").alias("s"), union("contradicting").alias("contradicting"))
    return folded.select(*claim, F.array_except("s", "contradicting").alias("supporting"), "contradicting")


def component_rollup(components: DataFrame, parent: list[str], required: tuple[str, ...], component: str = "component", status: str = "status") -> DataFrame:
    """parent, n_groups, n_missing and status over the groups of components that must all be there.

    A group that is missing is unverified, so a parent is demonstrated only if every group is.
    """
    groups = predicate_rollup(components.where(F.col(component).isin(*required)), [*parent, component], status)
    s = F.col("status")
    folded = groups.groupBy(*parent).agg(F.count("*").alias("n_groups"), F.bool_or(s == "contradicted").alias("c"), F.bool_and(s == "demonstrated").alias("d"), F.bool_or(s.isin("demonstrated", "partial")).alias("p"))
    full = F.col("n_groups") == len(required)
    return folded.select(*parent, "n_groups", (F.lit(len(required)) - F.col("n_groups")).alias("n_missing"), rolled_status(F.col("c"), F.col("d") & full, F.col("p")).alias("status"))


def closure_status(transition: Column, expectation: Column, base_complete: Column, head_complete: Column, base_matches: Column, head_matches: Column) -> Column:
    """Of a scan's matches of one predicate: gone from a complete head after being in a complete base (transition), or just
    absent from a complete head (absent_head). Matches in a complete head contradict; an incomplete scan is partial.

    A selector that symbol tokens can't spell (dots, hyphens, calls) can't be seen by a scan of names: spelled_by_symbols()
    tells, and callers that want its absence unproven pass head_complete as false for it.
    """
    seen = head_complete & (head_matches > 0)
    moved = head_complete & base_complete & (base_matches > 0) & (head_matches == 0)
    incomplete = ~head_complete | (transition & ~base_complete)
    rest = F.when(incomplete, "partial").otherwise("unverified")
    return (
        F.when(transition, F.when(moved, "demonstrated").when(seen, "contradicted").otherwise(rest))
        .when(expectation == "absent_head", F.when(seen, "contradicted").when(head_complete, "demonstrated").otherwise(rest))
        .otherwise(rest)
    )


def spelled_by_symbols(selector: Column) -> Column:
    """Whether a selector is one symbol token, so that scans of symbol names can see it."""
    return selector.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def verification_status(checks: DataFrame, claim: list[str], head: Column, require_success: Column) -> DataFrame:
    """claim and status by its checks (status, conclusion), of which head tells those of the reviewed head.

    Only others: partial. Failures contradict where success is asked for, and otherwise show that checks ran; a completed
    success demonstrates; anything else is partial.
    """
    failed = head & F.coalesce(F.col("conclusion").isin(*FAILURE), F.lit(False))
    passed = head & (F.col("status") == "completed") & F.coalesce(F.col("conclusion").isin(*SUCCESS), F.lit(False))
    folded = checks.groupBy(*claim).agg(F.bool_or(failed).alias("failed"), F.bool_or(F.coalesce(passed, F.lit(False))).alias("passed"), F.bool_or(require_success).alias("required"))
    status = F.when(F.col("failed"), F.when(F.col("required"), "contradicted").otherwise("demonstrated")).when(F.col("passed"), "demonstrated").otherwise("partial")
    return folded.select(*claim, status.alias("status"))


def selector_free_closure(has_result: Column, complete: Column) -> Column:
    """A closure claim without a selector is never better than partial."""
    return F.when(has_result & ~complete, "partial").otherwise("unverified")


def claim_status(kind: Column, has_predicates: Column, rolled: Column, has_binding: Column, closure: Column, has_plan: Column, verification: Column, decisive: Column, exact: Column) -> Column:
    """A claim's status by the first rule that applies; closure, verification and rolled are statuses or null."""
    return (
        F.when(kind.isin("before_state", "after_state", "uncertainty"), "unverified")
        .when(has_predicates, rolled)
        .when(~has_binding, "unverified")
        .when(closure.isNotNull(), closure)
        .when(has_plan, "partial")
        .when(verification.isNotNull() & ((kind == "completion_condition") | decisive), verification)
        .when(exact & (kind == "change"), "demonstrated")
        .otherwise("partial")
    )


def ordered_match(events: DataFrame, keys: list[str], order: str, value: str, steps: tuple[str, ...]) -> DataFrame:
    """keys, n_matched and complete: how many of steps occur one after another, each found at its first place after the last.

    A window for each step in place of a list of all events, so a key of any size is sorted once and never collected.
    """
    rows = events.where(F.col(value).isin(*steps)).select(*keys, order, value)
    found = rows.select(*keys).distinct().withColumn("at", F.lit(None).cast(rows.schema[order].dataType)).withColumn("n_matched", F.lit(0))
    for k, step in enumerate(steps):
        own = rows.where(F.col(value) == step).select(*keys, F.col(order).alias("here"))
        open_ = (F.col("n_matched") == k) & (F.col("at").isNull() | (F.col("here") > F.col("at")))
        first = own.join(found, keys).where(open_).groupBy(*keys).agg(F.min("here").alias("first"))
        found = found.join(first, keys, "left").select(*keys, F.coalesce("first", "at").alias("at"), (F.col("n_matched") + F.col("first").isNotNull().cast("int")).alias("n_matched"))
    return found.select(*keys, "n_matched", (F.col("n_matched") == len(steps)).alias("complete"))


def path_subsequence(nodes: Column, steps: Column) -> Column:
    """Whether steps (sets of keys) are met in order along nodes (sets of keys), each by the first node that fits."""
    cursor = F.aggregate(nodes, F.lit(0), lambda at, n: F.when((at < F.size(steps)) & F.arrays_overlap(F.coalesce(F.try_element_at(steps, at + 1), F.array().cast("array<string>")), n), at + 1).otherwise(at))
    return cursor == F.size(steps)


def authority_controls(nodes: Column, authorities: Column) -> Column:
    """Whether an authority stands on a path before its last node."""
    return F.arrays_overlap(F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0))), authorities)

"""Authored predicates: which bindings speak for each, and what it is worth by the rule of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.assessment import FAILURE, SUCCESS, closure_status

KEYS = ("review_id", "claim_id", "predicate_id")
#: Associations that name a fact exactly; kinds of claims that a fact's presence shows.
EXACT = ("provided_association", "exact_identifier")
PRESENCE_KINDS = ("change",)


def marked(bound: DataFrame, subjects: DataFrame, hits: DataFrame, paths: DataFrame) -> DataFrame:
    """bound with selected_by and hit_by (predicate ids of its claim) and on_path, for speaking(); tables of predicate_bindings()."""
    keys = ["review_id", "claim_id", "evidence_id"]
    none, off = F.lit(None).cast("string"), F.lit(False)
    rows = subjects.select(*keys, F.col("predicate_id").alias("selected"), none.alias("hit"), off.alias("on_path"))
    rows = rows.union(hits.select(*keys, none, "predicate_id", off)).union(paths.select(*keys, none, none, F.lit(True)))
    marks = rows.groupBy(*keys).agg(F.collect_set("selected").alias("selected_by"), F.collect_set("hit").alias("hit_by"), F.bool_or("on_path").alias("on_path"))
    return bound.join(marks, keys, "left")


def speaking(predicates: DataFrame, bound: DataFrame, planned: DataFrame) -> DataFrame:
    """predicate_bindings() of a bound table that is marked already; a bound table dealt by review_id and claim_id isn't shuffled again.

    The pairs of predicates and bindings, many times as many rows, aren't shuffled before they are grouped.
    """
    scans = planned.select(*KEYS).distinct().withColumn("scanned", F.lit(True))
    rows = predicates.join(scans, [*KEYS], "left").join(bound, ["review_id", "claim_id"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    selected, hit = (yes(F.array_contains(c, F.col("predicate_id"))) for c in ("selected_by", "hit_by"))
    role, association = F.col("evidence_role"), F.col("association")
    ordered = yes(F.col("on_path")) | ((role == "verification") & hit)
    closure = (role == "closure") & (F.col("expectation") == "absent_head") & yes(F.col("scanned"))
    given_path = (F.col("claim_kind") == "authority") & (role == "structural_path") & (association == "provided_association")
    other = selected | closure | ((role != "closure") & hit) | (association == "structural_bridge") | given_path
    return rows.where(F.when(F.col("selector_kind") == "ordered_path", ordered).otherwise(other)).drop("selected_by", "hit_by", "scanned", "on_path")


def predicate_bindings(predicates: DataFrame, bound: DataFrame, subjects: DataFrame, hits: DataFrame, planned: DataFrame, paths: DataFrame) -> DataFrame:
    """The bindings of a claim that speak for each of its predicates, with the predicate's columns.

    predicates: KEYS, claim_kind, selector_kind, expectation; bound: review_id, claim_id, binding_id, evidence_id,
    evidence_role, association; subjects and hits: KEYS, evidence_id that the predicate has selected, or whose words or
    paths its selectors match; planned: KEYS of predicates that a closure scan covers; paths: review_id, claim_id,
    evidence_id of the claim's selected paths.
    """
    return speaking(predicates, marked(bound, subjects, hits, paths), planned)


def judged(rows: DataFrame, checks: DataFrame, keys: tuple[str, ...] = ("review_id", "evidence_id")) -> DataFrame:
    """rows with failed and passed, as checks (keys, status, conclusion, at_head) of the head say of their evidence."""
    found = checks.groupBy(*keys).agg(
        F.bool_or(F.col("at_head") & F.coalesce(F.col("conclusion").isin(*FAILURE), F.lit(False))).alias("failed"),
        F.bool_or(F.col("at_head") & (F.col("status") == "completed") & F.coalesce(F.col("conclusion").isin(*SUCCESS), F.lit(False))).alias("passed"),
    )
    return rows.join(found, [*keys], "left")


def closure_matches(predicates: DataFrame, scanned: DataFrame, matches: DataFrame, states: DataFrame) -> DataFrame:
    """KEYS, transition, base_complete, head_complete, base_matches and head_matches of predicates that scans cover.

    scanned: review_id, plan_id, scan_id and source_predicate_id of scan predicates, and expectation of their plan;
    matches: review_id, plan_id, scan_id, revision_side, surface; states: review_id, plan_id, revision_side, state. Only
    paths count for a path, only symbol names for anything else.
    """
    own = predicates.select(*KEYS, "selector_kind").join(scanned.select("review_id", "plan_id", "scan_id", F.col("source_predicate_id").alias("predicate_id"), "expectation"), ["review_id", "predicate_id"])
    surface = F.when(F.col("selector_kind") == "repository_path", "paths").otherwise("symbol_names")
    met = own.withColumn("surface", surface).join(matches.select("review_id", "plan_id", "scan_id", "surface", "revision_side"), ["review_id", "plan_id", "scan_id", "surface"], "left")
    side = lambda name: F.count_if(F.col("revision_side") == name).alias(f"{name}_matches")
    counted = met.groupBy(*KEYS, "plan_id").agg(F.bool_or(F.col("expectation") == "transition").alias("transition"), side("base"), side("head"))
    done = lambda name: F.coalesce(F.bool_or((F.col("revision_side") == name) & (F.col("state") == "complete")), F.lit(False)).alias(f"{name}_complete")
    known = states.groupBy("review_id", "plan_id").agg(done("base"), done("head"))
    joined = counted.join(known, ["review_id", "plan_id"], "left").na.fill(False, ["base_complete", "head_complete"])
    return joined.select(*KEYS, "transition", "base_complete", "head_complete", "base_matches", "head_matches")


def predicate_status(predicates: DataFrame, spoken: DataFrame, checks: DataFrame | None, closures: DataFrame) -> DataFrame:
    """KEYS, status, reason, supporting and contradicting (binding ids) of every predicate.

    predicates: KEYS, claim_kind, selector_kind, expectation, n_deferred (paths left out by limits), uncertain (an authored
    uncertainty names the same subject); spoken: of predicate_bindings(), with in_order (its path meets all selectors in
    their order), controls (an authority stands on it before its end), bypasses (it reaches a controlled end without one)
    and whole (its traversal is complete); checks: review_id, evidence_id, status, conclusion, at_head, or None where spoken
    is of judged() already; closures: of closure_matches(). An authority's predicates go by control, ordered paths by order, scanned ones by the scan,
    verified_head ones by checks; the rest by whether a fact is named exactly.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    role, exact = F.col("evidence_role"), F.col("association").isin(*EXACT)
    is_path = role == "structural_path"
    rows = spoken if checks is None else judged(spoken, checks)
    tests = {
        "all_ids": F.lit(True), "exact_ids": exact, "closure_ids": role == "closure", "check_ids": role == "verification",
        "failed_ids": (role == "verification") & yes("failed"), "passed_ids": (role == "verification") & yes("passed"),
        "order_ids": is_path & yes("in_order"), "control_ids": yes("controls"), "bypass_ids": yes("bypasses"),
    }
    said = F.collect_set(F.struct("binding_id", *[test.alias(n) for n, test in tests.items()])).alias("said")
    folded = rows.groupBy(*KEYS).agg(said, F.coalesce(F.bool_or(yes("controls") & ~yes("whole")), F.lit(False)).alias("control_cut"))
    joined = predicates.join(folded, [*KEYS], "left").join(closures.withColumn("planned", F.lit(True)), [*KEYS], "left")
    of = lambda n: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("said", lambda x: x[n]), lambda x: x["binding_id"]), lambda x: x.isNotNull())))
    none = F.array().cast("array<string>")
    joined = joined.select("*", *[F.coalesce(of(n), none).alias(f"_{n}") for n in tests])
    some = lambda c: F.size(f"_{c}") > 0
    cut = F.col("n_deferred") > 0

    def answer(status, reason, supporting=none, contradicting=none):
        pick = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(pick(status).alias("status"), pick(reason).alias("reason"), supporting.alias("supporting"), contradicting.alias("contradicting"))

    # checks: failures contradict, as success is asked for
    checked = F.when(some("failed_ids"), "contradicted").when(some("passed_ids"), "demonstrated").otherwise("partial")
    check_reason = F.when(some("failed_ids"), "verification_failure_observed").when(some("passed_ids"), "verification_success_observed").otherwise("verification_incomplete")
    check_support = F.when(some("failed_ids"), none).when(some("passed_ids"), F.col("_passed_ids")).otherwise(F.col("_check_ids"))
    authority = (
        F.when(some("bypass_ids"), answer("contradicted", "authority_bypass_observed", F.col("_control_ids"), F.col("_bypass_ids")))
        .when(some("control_ids"), answer(F.when(cut | F.col("control_cut") | F.col("uncertain"), "partial").otherwise("demonstrated"), "authority_path_observed", F.col("_control_ids")))
        .otherwise(answer(F.when(some("exact_ids") | cut, "partial").otherwise("unverified"), F.when(cut, "coverage_incomplete").when(some("exact_ids"), "association_only").otherwise("no_binding"), F.col("_exact_ids")))
    )
    unresolved = answer(F.when(cut, "partial").otherwise("unverified"), F.when(cut, "coverage_incomplete").otherwise("no_binding"))
    order = (
        F.when(~some("order_ids"), unresolved)
        .when(F.col("expectation") == "absent_head", answer("contradicted", "closure_conflict_observed", none, F.col("_order_ids")))
        .when(F.col("expectation") != "verified_head", answer("demonstrated", "exact_fact_observed", F.col("_order_ids")))
        .when(~some("check_ids"), answer("partial", "exact_fact_observed", F.col("_order_ids")))
        .otherwise(answer(checked, "exact_fact_observed", F.array_union("_order_ids", check_support), F.col("_failed_ids")))
    )
    scan = closure_status(F.col("transition"), F.col("expectation"), F.col("base_complete"), F.col("head_complete"), F.col("base_matches"), F.col("head_matches"))
    scan_reason = (
        F.when(scan == "contradicted", "closure_conflict_observed")
        .when(scan == "demonstrated", F.when(F.col("transition"), "closure_transition_observed").otherwise("closure_absence_observed"))
        .otherwise(F.when(scan == "partial", "coverage_incomplete").otherwise("association_only"))
    )
    scanned = answer(scan, scan_reason, F.when(scan == "contradicted", none).otherwise(F.col("_closure_ids")), F.when(scan == "contradicted", F.col("_closure_ids")).otherwise(none))
    shown = F.col("claim_kind").isin(*PRESENCE_KINDS) & (F.col("expectation") == "reference")
    named = answer(F.when(shown, "demonstrated").otherwise("partial"), F.when(shown, "exact_fact_observed").otherwise("association_only"), F.col("_exact_ids"))
    result = (
        F.when(F.col("claim_kind") == "authority", authority)
        .when(F.col("selector_kind") == "ordered_path", order)
        .when(some("closure_ids") & F.coalesce("planned", F.lit(False)), scanned)
        .when((F.col("expectation") == "verified_head") & some("check_ids"), answer(checked, check_reason, check_support, F.col("_failed_ids")))
        .when(some("exact_ids"), named)
        .when(some("all_ids"), answer("partial", "association_only", F.col("_all_ids")))
        .otherwise(answer("unverified", "no_binding"))
    )
    return joined.select(*KEYS, result.alias("r")).select(*KEYS, "r.*")

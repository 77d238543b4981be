"""Selections by a recorded outside selector: what it may see, whether its answer is whole, and how it compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tiers of admission from first to last, and limits.
TIERS = ("baseline", "provided", "identifier", "phrase", "bridge", "same_hunk", "fallback")
TIER_OF = {"provided_association": "provided", "explicit_reference": "provided", "current_head": "provided", "exact_identifier": "identifier", "distinctive_phrase": "phrase", "claim_bridge": "bridge", "structural_bridge": "bridge"}
CANDIDATES, REQUESTS, EACH_CHARS, ALL_CHARS = 40, 3, 2000, 24000


def association_tier(association: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tier in TIER_OF.items():
        out = F.when(association == name, tier).otherwise(out)
    return out


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def candidate_identities(direct: DataFrame, items: DataFrame, claims: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """review_id, claim_id, evidence_id, tier and selected.

    direct: review_id, claim_id, evidence_id, tier of baselines and bindings; items: review_id, claim_id (it is eligible
    for), id, kind, ordinal, change_relation_ids. Facts of the direct ones' changes come with them; only a claim without
    any takes all eligible structural changes, or else change relations.
    """
    keys = ["review_id", "claim_id"]
    touched = direct.join(items.select("review_id", F.col("id").alias("evidence_id"), "change_relation_ids").distinct(), ["review_id", "evidence_id"]).select(*keys, F.explode("change_relation_ids").alias("relation")).distinct()
    anchors = items.where(F.col("kind").isin("structural_change", "change_relation"))
    beside = anchors.withColumn("relation", F.explode("change_relation_ids")).join(touched, [*keys, "relation"], "left_semi").select(*keys, F.col("id").alias("evidence_id")).distinct().withColumn("tier", F.lit("same_hunk"))
    bare = claims.select(*keys).join(direct.select(*keys).distinct(), keys, "left_anti")
    loose = anchors.join(bare, keys, "left_semi").withColumn("any_structural", F.max(F.col("kind") == "structural_change").over(Window.partitionBy(*keys)))
    loose = loose.where(F.col("kind") == F.when(F.col("any_structural"), "structural_change").otherwise("change_relation")).select(*keys, F.col("id").alias("evidence_id"), F.lit("fallback").alias("tier"))
    rows = direct.select(*keys, "evidence_id", "tier").union(beside).union(loose)
    best = rows.groupBy(*keys, "evidence_id").agg(F.min(tier_rank(F.col("tier"))).alias("rank"))
    places = items.groupBy("review_id", F.col("id").alias("evidence_id")).agg(F.min("ordinal").alias("ordinal"))
    ranked = best.join(places, ["review_id", "evidence_id"], "left")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", F.col("ordinal").asc_nulls_last(), "evidence_id"))
    return ranked.select(*keys, "evidence_id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank").cast("int")).alias("tier"), (place <= limit).alias("selected"))


def admissions(claims: DataFrame, identities: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """review_id, claim_id, state, eligible_count and deferred_count: empty for uncertainty and for none, blocked where the
    baseline alone is over the limit, else ready or ready_truncated."""
    folded = identities.groupBy("review_id", "claim_id").agg(F.count("*").alias("eligible_count"), F.count_if(~F.col("selected")).alias("deferred_count"), F.count_if(F.col("tier") == "baseline").alias("n_baseline"))
    joined = claims.select("review_id", "claim_id", "kind").join(folded, ["review_id", "claim_id"], "left").na.fill(0, ["eligible_count", "deferred_count", "n_baseline"])
    state = F.when((F.col("kind") == "uncertainty") | (F.col("eligible_count") == 0), "empty").when(F.col("n_baseline") > limit, "blocked").when(F.col("deferred_count") > 0, "ready_truncated").otherwise("ready")
    return joined.select("review_id", "claim_id", state.alias("state"), "eligible_count", "deferred_count")


def run_first(requests: DataFrame, ordinal: str, limit: int = REQUESTS) -> DataFrame:
    """requests (review_id) with execution: requested for the first of a review, deferred for the rest."""
    place = F.row_number().over(Window.partitionBy("review_id").orderBy(ordinal))
    return requests.withColumn("execution", F.when(place <= limit, "requested").otherwise("deferred"))


def compare_selections(request: DataFrame, deterministic: DataFrame, shadow: DataFrame) -> DataFrame:
    """review_id, claim_id, evidence_id and side (shared, deterministic_only, shadow_only) of a request's candidates (ordinal), in its order."""
    keys = ["review_id", "claim_id", "evidence_id"]
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    joined = request.join(mark(deterministic, "d"), keys, "left").join(mark(shadow, "s"), keys, "left")
    side = F.when(F.col("d") & F.col("s"), "shared").when(F.col("d"), "deterministic_only").when(F.col("s"), "shadow_only")
    return joined.select(*keys, "ordinal", side.alias("side")).where("side is not null")


def measured(requests: DataFrame, provider, schema: str) -> DataFrame:
    """Rows that provider(row as dict) gives for each request, with error: a failure is told and stops nothing else."""
    names = StructType.fromDDL(schema).names

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append({**row, **provider(row), "error": None})
                except Exception as e:  # noqa: BLE001 - an outside selector may fail in any way
                    out.append({**row, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names, dtype=object)

    return requests.mapInPandas(run, schema)


def shadow_metrics(expected: DataFrame, observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of counts and ratios over labelled candidates; a ratio of nothing is 1.

    expected and observed: case_id, claim_id, evidence_id, disposition (selected, rejected, insufficient), role; baseline:
    case_id, claim_id, evidence_id.
    """
    keys = ["case_id", "claim_id", "evidence_id"]
    e = expected.select(*keys, F.col("disposition").alias("ed"), F.col("role").alias("er"))
    o = observed.select(*keys, F.col("disposition").alias("od"), F.col("role").alias("orole"))
    b = baseline.select(*keys).distinct().withColumn("base", F.lit(True))
    rows = e.join(o, keys, "full_outer").join(b, keys, "left")
    want, got = F.coalesce(F.col("ed") == "selected", F.lit(False)), F.coalesce(F.col("od") == "selected", F.lit(False))
    counts = rows.agg(
        F.count("ed").alias("n_labels"),
        F.count_if(want).alias("n_expected"),
        F.count_if(got).alias("n_observed"),
        F.count_if(want & got).alias("n_shared"),
        F.count_if(want & got & F.col("er").eqNullSafe(F.col("orole"))).alias("n_roles"),
        F.count_if(F.col("ed") == F.col("od")).alias("n_dispositions"),
        F.count_if(want & (F.col("od") == "rejected")).alias("n_false_rejected"),
        F.count_if(F.col("ed") == "insufficient").alias("n_insufficient"),
        F.count_if((F.col("ed") == "insufficient") & (F.col("od") == "insufficient")).alias("n_insufficient_shared"),
        F.count_if(want & F.col("base")).alias("n_baseline"),
        F.count_if(want & got & F.col("base")).alias("n_baseline_kept"),
    )
    ratio = lambda a, c, name: F.coalesce(F.col(a) / F.nullif(F.col(c), F.lit(0)), F.lit(1.0)).alias(name)
    return counts.select(
        "*",
        ratio("n_shared", "n_observed", "selection_precision"),
        ratio("n_shared", "n_expected", "selection_recall"),
        ratio("n_roles", "n_expected", "role_accuracy"),
        ratio("n_dispositions", "n_labels", "disposition_accuracy"),
        ratio("n_false_rejected", "n_expected", "false_rejection_rate"),
        ratio("n_insufficient_shared", "n_insufficient", "insufficient_recall"),
        ratio("n_baseline_kept", "n_baseline", "baseline_retention"),
    )


def outcome_mismatches(outcomes: DataFrame) -> DataFrame:
    """case_id, claim_id and code of what differs in outcomes; only states and diagnostics count where no human has labelled.

    outcomes: case_id, claim_id, labelled, diagnostics_matched, and expected_ and observed_ of state, and of the arrays
    selected, roles, unresolved, rejected, insufficient (compared as sets; null arrays count as empty).
    """
    empty = F.array().cast("array<string>")
    members = lambda name: F.array_sort(F.array_distinct(F.coalesce(F.col(name), empty)))
    differ = lambda *names: F.reduce(F.array(*[members(f"expected_{n}") != members(f"observed_{n}") for n in names]), F.lit(False), lambda a, b: a | b)
    labelled = F.coalesce("labelled", F.lit(False))
    rules = {
        "shadow_state_mismatch": ~F.col("expected_state").eqNullSafe(F.col("observed_state")),
        "shadow_selection_mismatch": labelled & differ("selected"),
        "shadow_role_mismatch": labelled & differ("roles"),
        "shadow_unresolved_mismatch": labelled & differ("unresolved"),
        "shadow_disposition_mismatch": labelled & differ("rejected", "insufficient"),
        "shadow_diagnostic_mismatch": ~F.coalesce("diagnostics_matched", F.lit(False)),
    }
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))
    return outcomes.select("case_id", "claim_id", F.explode(codes).alias("code"))

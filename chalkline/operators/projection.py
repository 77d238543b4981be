"""One graph for a review and overlays of it for each focus, with where every membership comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.paths import architectural_domain, architectural_layer
from chalkline.operators.graph import membership_class
from chalkline.operators.rollups import MEMBERSHIP


def graph_nodes(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """review_id, node_id, delta, display_id, path and the ids of a node's facts (symbols: review_id, node_id, id, side,
    path; changes: review_id, node_id, id, operation, path).

    A changed node shows its change; another its head symbol, or else its base one.
    """
    facts = symbols.select("review_id", "node_id", "id", "side", "path", F.lit(None).cast("string").alias("operation"), F.when(F.col("side") == "head", 1).otherwise(2).alias("rank"))
    facts = facts.unionByName(changes.select("review_id", "node_id", "id", F.lit("review").alias("side"), "path", "operation", F.lit(0).alias("rank")))
    folded = facts.groupBy("review_id", "node_id").agg(
        F.min_by(F.struct("id", "path"), F.struct("rank", "id")).alias("shown"),
        F.array_sort(F.collect_set("operation")).alias("operations"),
        F.array_sort(F.collect_set("side")).alias("sides"),
        F.array_sort(F.collect_set("id")).alias("evidence_ids"),
    )
    delta = F.when(F.size("operations") == 1, F.col("operations")[0]).when(F.array_contains("sides", "base") & F.array_contains("sides", "head"), "retained").otherwise("unresolved")
    return folded.select("review_id", "node_id", delta.alias("delta"), F.col("shown.id").alias("display_id"), F.col("shown.path").alias("path"), "evidence_ids")


def focus_overlay(anchors: DataFrame, contexts: DataFrame, paths: DataFrame, owners: DataFrame) -> DataFrame:
    """review_id, focus_id, node_id, membership and sources of every node of a focus's overlay.

    anchors: review_id, focus_id, relation_id, node_id, association; contexts the same of selected context symbols;
    paths: review_id, focus_id, relation_id, node_ids of selected paths; owners: review_id, node_id, owner (all levels).
    The strongest membership counts; all sources are kept.
    """
    keys = ["review_id", "focus_id", "node_id"]
    rows = anchors.select(*keys, membership_class(F.col("association")).alias("membership"), F.concat(F.lit("anchor:"), "relation_id").alias("source"))
    rows = rows.union(contexts.select(*keys, F.lit("context"), F.concat(F.lit("context:"), "relation_id")))
    rows = rows.union(paths.select("review_id", "focus_id", F.explode("node_ids").alias("node_id"), F.lit("context"), F.concat(F.lit("path:"), "relation_id")))
    above = rows.select(*keys).distinct().join(owners, ["review_id", "node_id"]).select("review_id", "focus_id", F.col("owner").alias("node_id"), F.lit("context"), F.concat(F.lit("owner:"), "node_id"))
    names = F.array(*map(F.lit, MEMBERSHIP))
    every = rows.union(above).groupBy(*keys).agg(F.min(F.array_position(names, F.col("membership"))).alias("rank"), F.array_sort(F.collect_set("source")).alias("sources"))
    return every.select(*keys, F.element_at(names, F.col("rank").cast("int")).alias("membership"), "sources")


def strays(overlay: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of overlays that the review's graph doesn't have; there must be none."""
    return overlay.join(nodes.select("review_id", "node_id"), ["review_id", "node_id"], "left_anti")


def components(nodes: DataFrame) -> DataFrame:
    """review_id, domain, layer, authority and node_ids of the architecture that changed nodes (node_id, path) touch."""
    placed = nodes.select("review_id", "node_id", architectural_domain(F.col("path")).alias("domain"), architectural_layer(F.col("path")).alias("layer"))
    authority = F.when(F.col("layer") == "unclassified", "path_structure").otherwise("path_convention")
    return placed.groupBy("review_id", "domain", "layer").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids")).withColumn("authority", authority)


def verification_matrix(subjects: DataFrame, assessments: DataFrame, bindings: DataFrame, overlay: DataFrame) -> DataFrame:
    """review_id, subject_id, status, evidence_ids and n_nodes of every subject, those without anything too.

    assessments: review_id, subject_id, status; bindings: review_id, subject_id, evidence_id; overlay: review_id,
    subject_id, node_id.
    """
    keys = ["review_id", "subject_id"]
    bound = bindings.groupBy(*keys).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    members = overlay.groupBy(*keys).agg(F.count_distinct("node_id").alias("n_nodes"))
    joined = subjects.select(*keys).join(assessments.select(*keys, "status"), keys, "left").join(bound, keys, "left").join(members, keys, "left")
    return joined.select(*keys, F.coalesce("status", F.lit("unverified")).alias("status"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def status_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("review_id", "status").agg(F.count("*").alias("n"))


def overview_files(owners: DataFrame, nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """review_id, file and role of files that own nodes: changed if any of them is, else bridge, else context.

    owners: review_id, node_id, file; nodes: review_id, node_id, delta; bridges: review_id, file.
    """
    changed = F.col("delta").isin("added", "removed", "modified", "renamed")
    folded = owners.join(nodes, ["review_id", "node_id"]).groupBy("review_id", "file").agg(F.bool_or(changed).alias("changed"))
    joined = folded.join(bridges.select("review_id", "file").distinct().withColumn("bridge", F.lit(True)), ["review_id", "file"], "left")
    return joined.select("review_id", "file", F.when(F.col("changed"), "changed").when(F.col("bridge"), "bridge").otherwise("context").alias("role"))


def observed_focuses(overlay: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """review_id, focus_id and sorted direct, suggested, context and unresolved nodes and exact relations of overlays.

    edges: review_id, focus_id, edge_id; groups: review_id, edge_id, group_id.
    """
    pick = lambda *names: F.array_sort(F.collect_set(F.when(F.col("membership").isin(*names), F.col("node_id"))))
    nodes = overlay.groupBy("review_id", "focus_id").agg(pick("asserted", "matched").alias("direct"), pick("suggested").alias("suggested"), pick("context").alias("context"), pick("unresolved").alias("unresolved"))
    exact = edges.join(groups, ["review_id", "edge_id"]).groupBy("review_id", "focus_id").agg(F.array_sort(F.collect_set("group_id")).alias("exact_relations"))
    return nodes.join(exact, ["review_id", "focus_id"], "left").withColumn("exact_relations", F.coalesce("exact_relations", F.array().cast("array<string>")))


def focus_coverage(labels: DataFrame, seeds: DataFrame, mapping: DataFrame) -> DataFrame:
    """review_id, focus_id and coverage of reference labels (unresolved, members, direct_nodes: arrays).

    seeds: review_id, node_id, state; mapping: review_id, state of the packet's seed mapping.
    """
    keys = ["review_id", "focus_id"]
    met = labels.select(*keys, F.explode("direct_nodes").alias("node_id")).join(seeds, ["review_id", "node_id"])
    met = met.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "truncated").alias("cut"), F.bool_or(F.col("state") == "unknown").alias("unknown"))
    joined = labels.join(mapping.select("review_id", F.col("state").alias("mapped")), "review_id", "left").join(met, keys, "left")
    coverage = (
        F.when(F.col("unresolved"), "reference unresolved")
        .when(F.size("members") == 0, "not required for empty reference")
        .when(F.coalesce(F.col("mapped"), F.lit("")) != "complete", "unknown · exact seed mapping unavailable")
        .when(F.coalesce("n", F.lit(0)) == 0, "unknown · no admitted direct seed")
        .when(F.col("cut"), "limited · admitted seed truncated")
        .when(F.col("unknown"), "unknown · admitted seed state unavailable")
        .otherwise("complete for admitted direct seeds")
    )
    return joined.select(*keys, coverage.alias("coverage"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of memberships that one of two snapshots of equal columns lacks, with which side has them; copies count."""
    gone = baseline.exceptAll(current).withColumn("only_in", F.lit("baseline"))
    return gone.unionByName(current.exceptAll(baseline).withColumn("only_in", F.lit("current")))


def code_packet(items: DataFrame, each: int = 2000, whole: int = 24000) -> DataFrame:
    """items (request_id, ordinal, added, removed) with added_code and removed_code within both limits, and truncated.

    An item's excerpt is the least of its text, each, and what is left of the whole; what earlier ones use is their sum,
    as each uses all it may.
    """
    from chalkline.operators.convergence import bounded_code, char_budget

    sized = items.withColumn("chars", F.length("added") + F.length("removed"))
    budget = char_budget(sized, ["request_id"], ["ordinal"], "chars", each, whole)
    added, removed = bounded_code(F.col("added"), F.col("removed"), F.col("used"))
    cut = (F.col("added_code") != F.col("added")) | (F.col("removed_code") != F.col("removed"))
    return budget.withColumn("added_code", added).withColumn("removed_code", removed).withColumn("truncated", cut).drop("chars", "used")


def owned_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """diagnostics (review_id, id, focus_id, scope, provider, slot, state) with one owner each: hidden if not applicable,
    the review if the scope is or several focuses share the group, else their focus."""
    group = Window.partitionBy("review_id", "scope", "provider", "slot", "state")
    shared = F.size(F.collect_set("focus_id").over(group)) > 1
    owner = F.when(F.col("state") == "not_applicable", "hidden").when((F.col("scope") == "review") | F.col("focus_id").isNull() | shared, "review").otherwise(F.concat(F.lit("focus:"), "focus_id"))
    return diagnostics.withColumn("owner", owner)


def merged_members(rows: DataFrame, keys: list[str], agreeing: list[str], unions: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row for each member (keys) of several selections, its list columns (unions) as sorted unions, and the conflicts.

    A member must be described alike wherever it is selected: conflicts names keys and columns of agreeing that aren't.
    Unknown values (null, unresolved) agree with any.
    """
    known = lambda c: F.when(F.col(c) != "unresolved", F.col(c))
    folded = rows.groupBy(*keys).agg(
        *[F.coalesce(F.max(known(c)), F.max(c)).alias(c) for c in agreeing],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions],
        F.array_compact(F.array(*[F.when(F.min(known(c)) != F.max(known(c)), F.lit(c)) for c in agreeing])).alias("_conflicts"),
    )
    conflicts = folded.select(*keys, F.explode("_conflicts").alias("column"))
    return folded.drop("_conflicts"), conflicts


def is_structural(slot: Column, target_kind: Column) -> Column:
    """Whether a selected relation has a place in the graph: a path, or an anchor or context that is a symbol or its change."""
    around = slot.isin("changed_anchor", "runtime_context", "test_context") & target_kind.isin("symbol", "structural_change")
    return F.coalesce((slot == "structural_path") | around, F.lit(False))


def claim_disposition(projected: Column, n_deferred: Column, kind: Column, n_predicates: Column, n_seeds: Column) -> Column:
    """The disposition of a transformation claim: state claims need no structure, predicates without subjects are unassociated."""
    return (
        F.when(projected, "projected")
        .when(n_deferred > 0, "deferred")
        .when(kind.isin("before_state", "after_state", "uncertainty"), "not_applicable")
        .when((n_predicates > 0) & (n_seeds == 0), "unassociated")
        .otherwise("no_structural_evidence")
    )


def selector_provenance(found: DataFrame, facts: DataFrame) -> DataFrame:
    """review_id, claim_id, node_id, membership and sources of nodes that predicates' subjects are (found: review_id,
    claim_id, predicate_id, evidence_id; facts: review_id, id, node_id): all asserted."""
    met = found.join(facts.select("review_id", F.col("id").alias("evidence_id"), "node_id"), ["review_id", "evidence_id"])
    sources = F.array_sort(F.collect_set(F.concat_ws(":", F.lit("selector"), "predicate_id", "evidence_id")))
    return met.where("node_id is not null").groupBy("review_id", "claim_id", "node_id").agg(sources.alias("sources")).withColumn("membership", F.lit("asserted"))


def overlay_evidence(overlay: DataFrame, nodes: DataFrame) -> DataFrame:
    """review_id, focus_id and the sorted ids of facts behind an overlay's members (nodes: review_id, node_id, evidence_ids)."""
    met = overlay.join(nodes.select("review_id", "node_id", F.explode("evidence_ids").alias("id")), ["review_id", "node_id"])
    return met.groupBy("review_id", "focus_id").agg(F.array_sort(F.collect_set("id")).alias("evidence_ids"))

"""Whole reviews with their recorded code graphs: structural facts of both revisions, closures, and one projection of each review.

All parts read one node table (a symbol of both revisions is one node), written once: nodes, edges, ownership, overlays of
focuses, relation groups, dispositions and the verification matrix. Reviews whose ownership has a cycle are refused whole.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.lexical import association_signature
from chalkline.operators import alignment, closure, convergence, delta, graph, overlap, projection, structure
from chalkline.operators.facts import evidence_id
from chalkline.plans.review import Review, review
from chalkline.plans.shared import kept
from chalkline.sources import packets

CHANGES = ("added", "removed", "modified", "renamed", "unresolved")


@dataclass
class Graphs:
    """Recorded code graphs of reviews, both revisions (side: base or head); symbol_id is the provider's, within review and side.

    symbols: review_id, side, symbol_id, file_path, qualified_name, kind, profile, start_line, end_line; paths: review_id, side,
    path_id, seed, steps (source, target, relation, direction) of symbol_ids; ownership: review_id, side, parent, child;
    looked_up: review_id, side, file_path, qualified_name, kind of symbols searched there, found or not; seeds: review_id, side,
    seed, state of their traversals; owned: review_id, side, state of the ownership coverage.
    """

    symbols: DataFrame
    paths: DataFrame
    ownership: DataFrame
    looked_up: DataFrame
    seeds: DataFrame
    owned: DataFrame


@dataclass
class StructuralFacts:
    nodes: DataFrame
    symbols: DataFrame
    changes: DataFrame
    relations: DataFrame
    ownership: DataFrame
    paths: DataFrame
    touched: DataFrame
    undecided: DataFrame
    unmapped: DataFrame


@dataclass
class Projection:
    refused: DataFrame
    nodes: DataFrame
    edges: DataFrame
    placements: DataFrame
    chains: DataFrame
    overlays: DataFrame
    focus_edges: DataFrame
    groups: DataFrame
    group_members: DataFrame
    components: DataFrame
    dispositions: DataFrame
    matrix: DataFrame
    statuses: DataFrame
    evidence: DataFrame
    observed: DataFrame


def file_keys(files: DataFrame) -> DataFrame:
    """review_id, base_path and file_key of renamed files: base symbols there have their identity under the head's path."""
    moved = files.where("status = 'renamed' and base_path <> head_path")
    return moved.select("review_id", "base_path", F.col("head_path").alias("file_key")).distinct()


def structural_facts(graphs: Graphs, files: DataFrame, relations: DataFrame) -> StructuralFacts:
    """Facts of symbols, relations and ownership of both revisions.

    files: review_id, base_path, head_path, status; relations: of diffs.change_relations(), with base_path, head_path and
    relation_id. Changed lines belong to the narrowest symbols around them; a symbol is changed if a line of it is, and its
    counterpart with it. What the other revision lacks is added or removed only where it was looked for.
    """
    moved = file_keys(files)
    keyed = lambda df: df.join(moved.withColumnRenamed("base_path", "file_path").withColumn("side", F.lit("base")), ["review_id", "side", "file_path"], "left").withColumn("renamed", F.col("file_key").isNotNull()).withColumn("file_key", F.coalesce("file_key", "file_path"))
    identity = ["review_id", "file_key", "qualified_name", "kind"]
    symbols = kept(delta.cross_revision_identity(keyed(graphs.symbols), "side", identity, ["symbol_id"]).withColumnRenamed("review_symbol_id", "node_id"))

    # lines of each side, with the path they have there
    side = lambda name, path, lines: relations.select("review_id", "relation_id", F.lit(name).alias("side"), F.col(path).alias("path"), F.explode(F.transform(lines, lambda x: x["number"])).alias("line"))
    lines = kept(side("base", "base_path", "removed").union(side("head", "head_path", "added")).where("path is not null"))
    place = F.concat_ws("\0", "review_id", "side", "path")
    spans = symbols.where("kind <> 'file'").select(F.concat_ws("\0", "review_id", "side", F.col("file_path")).alias("file_at"), F.struct("review_id", "side", "symbol_id").alias("span_id"), "start_line", "end_line")
    at = lines.select(place.alias("file_at"), "line").distinct()
    met = overlap.narrowest_spans(at, spans, "file_at").select("file_at", "line", F.col("span_id.symbol_id").alias("symbol_id"))
    touched = kept(lines.withColumn("file_at", place).join(met, ["file_at", "line"]).select("review_id", "side", "relation_id", "line", "symbol_id"))
    outside = overlap.unmapped(at, spans, "file_at")
    outside = lines.withColumn("file_at", place).join(outside, ["file_at", "line"]).select("review_id", "side", "path", "relation_id", "line")

    own = touched.groupBy("review_id", "side", "symbol_id").agg(F.array_sort(F.collect_set("relation_id")).alias("change_relation_ids"))
    direct = symbols.join(own, ["review_id", "side", "symbol_id"], "left").withColumn("change_relation_ids", F.coalesce("change_relation_ids", F.array().cast("array<string>")))
    # a changed symbol's counterpart changes with it
    hit = direct.where(F.size("change_relation_ids") > 0).select(*identity).distinct()
    changed = direct.join(hit, identity, "left_semi")
    shown = lambda df: df.select("review_id", "side", F.col("file_key").alias("file_path"), "qualified_name", "kind")
    paths_of = files.select("review_id", F.when(F.col("status") == "renamed", F.col("head_path")).otherwise(F.col("base_path")).alias("base_path"), "head_path", "status")
    counted = relations.select("review_id", "relation_id", "kind", F.transform("added", lambda x: x["number"]).alias("added"), F.transform("removed", lambda x: x["number"]).alias("removed"))
    own = changed.select("review_id", "side", F.col("file_key").alias("file_path"), "qualified_name", "kind", "change_relation_ids")
    decided = structure.symbol_changes(own, paths_of, shown(keyed(graphs.looked_up)), counted, touched.select("review_id", "side", "relation_id", "line"))
    names = symbols.groupBy(*identity).agg(F.min("node_id").alias("node_id"), F.bool_or("renamed").alias("renamed"), F.max_by("file_path", "side").alias("path"))
    decided = decided.withColumnRenamed("file_path", "file_key").join(names, identity)
    operation = F.when(F.col("renamed") & F.col("in_base") & F.col("in_head"), "renamed").otherwise(F.col("operation"))
    changes = kept(decided.select("review_id", "node_id", evidence_id("structural_change", F.col("node_id")).alias("id"), operation.alias("operation"), "path", "qualified_name", "kind"))

    # providers' ids to nodes, step by step
    node = symbols.select("review_id", "side", "symbol_id", "node_id")
    as_node = lambda df, column: df.join(node.select("review_id", "side", F.col("symbol_id").alias(column), F.col("node_id").alias(f"{column}_node")), ["review_id", "side", column])
    steps = graphs.paths.select("review_id", "side", "path_id", "seed", F.posexplode("steps").alias("n", "s")).select("review_id", "side", "path_id", "seed", "n", "s.source", "s.target", "s.relation", "s.direction")
    steps = kept(as_node(as_node(as_node(steps, "seed"), "source"), "target"))
    one = F.array(F.struct(F.col("source_node").alias("source"), F.col("target_node").alias("target"), "relation", "direction"))
    seeds = as_node(graphs.seeds, "seed").select("review_id", "side", F.col("seed_node").alias("seed"), "state")
    known = changes.select("review_id", F.col("node_id").alias("node"), "operation")
    relation_rows, undecided = structure.relation_changes(steps.select("review_id", "side", F.col("seed_node").alias("seed"), one.alias("steps")), known, seeds)
    owns = as_node(as_node(graphs.ownership, "parent"), "child").select("review_id", "side", F.col("parent_node").alias("parent"), F.col("child_node").alias("child"))
    owned = structure.ownership_changes(owns, known, graphs.owned, symbols.select("review_id", "side", F.col("node_id").alias("node")))

    ordered = steps.groupBy("review_id", "side", "path_id").agg(
        F.min("seed_node").alias("seed"), F.count("*").alias("depth"),
        F.sort_array(F.collect_list(F.struct("n", F.struct(F.col("source_node").alias("source"), F.col("target_node").alias("target"), "relation", "direction").alias("s")))).alias("s"),
    )
    ordered = ordered.withColumn("steps", F.transform("s", lambda x: x["s"])).drop("s")
    ordered = ordered.select("review_id", "side", F.concat_ws(":", "side", "path_id").alias("path_id"), "seed", "depth", "steps", graph.path_nodes(F.col("steps")).alias("nodes"), structure.path_key(F.col("seed"), F.col("steps"), F.col("side")).alias("key"))
    labelled = symbols.withColumn("id", structure.symbol_fact_id(F.col("symbol_id"), F.col("side")))
    return StructuralFacts(
        nodes=symbols.select("review_id", "node_id").distinct(),
        symbols=kept(labelled.select("review_id", "side", "symbol_id", "node_id", "id", F.col("file_path").alias("path"), "qualified_name", "kind", "profile")),
        changes=changes,
        relations=kept(relation_rows.withColumn("id", evidence_id("relation_change", F.concat_ws(">", "source", "relation", "target")))),
        ownership=kept(owned.join(owns.groupBy("review_id", "parent", "child").agg(F.array_sort(F.collect_set("side")).alias("sides")), ["review_id", "parent", "child"])),
        paths=kept(ordered),
        touched=touched,
        undecided=undecided,
        unmapped=outside,
    )


def project(facts: StructuralFacts, anchors: DataFrame, contexts: DataFrame, paths: DataFrame, subjects: DataFrame, assessments: DataFrame, bindings: DataFrame, others: DataFrame) -> Projection:
    """One graph of each review and its focuses' overlays.

    anchors, contexts and paths: review_id, focus_id, relation_id with node_id and association, node_id, and node_ids; subjects:
    review_id, focus_id; assessments: review_id, focus_id, status; bindings: review_id, focus_id, evidence_id; others: review_id,
    focus_id, n_deferred, n_other, states of what a focus has besides.
    """
    key = ["review_id"]
    placed = structure.placements(facts.ownership.select("review_id", F.explode("sides").alias("side"), "parent", "child", F.concat_ws(">", "parent", "child").alias("id")))
    primary = graph.primary_placements(placed, key)
    chains, cycles = graph.ownership_chains(primary)
    cycles = kept(cycles)
    refused = cycles.groupBy("review_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.lit("placement_cycle").alias("reason"))
    open_ = lambda df: df.join(cycles.select("review_id").distinct(), "review_id", "left_anti")
    alone = facts.nodes.join(chains.select("review_id", F.col("node").alias("node_id")), [*key, "node_id"], "left_anti").select("review_id", F.col("node_id").alias("node"), F.array("node_id").alias("chain"))
    chains = kept(open_(chains.union(alone)))
    nodes = kept(open_(projection.graph_nodes(facts.symbols, facts.changes)))
    owners = chains.select("review_id", F.col("node").alias("node_id"), F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("owner"))
    overlays = kept(open_(projection.focus_overlay(anchors, contexts, paths, owners)))
    strays = projection.strays(overlays, nodes)
    if not strays.isEmpty():
        raise ValueError(f"an overlay has a node that its review's graph lacks: {strays.first()}")

    edges = kept(open_(facts.relations.withColumn("edge_id", F.concat_ws(">", "source", "relation", "target"))))
    groups = graph.relation_groups(edges, chains, ["relation", "operation"], key)
    grouped = graph.grouped_edges(edges, chains, key).select("review_id", "edge_id", F.concat_ws(":", F.concat_ws(">", "lifted_source", "lifted_target"), "relation", "operation").alias("group_id"))
    members = overlays.select("review_id", "focus_id", "node_id")
    ends = edges.select("review_id", "edge_id", F.col("source").alias("node_id"), "target").join(members, [*key, "node_id"])
    focus_edges = kept(ends.join(members.withColumnRenamed("node_id", "target"), [*key, "focus_id", "target"]).select("review_id", "focus_id", "edge_id"))

    subjects = open_(subjects)
    has = overlays.select("review_id", "focus_id").distinct().withColumn("projected", F.lit(True))
    told = subjects.join(has, [*key, "focus_id"], "left").join(others, [*key, "focus_id"], "left").na.fill(False, ["projected"]).na.fill(0, ["n_deferred", "n_other"])
    state = graph.disposition_state(F.col("projected"), F.col("n_deferred"), F.col("n_other"), F.coalesce("states", F.array().cast("array<string>")))
    named = lambda df: df.withColumnRenamed("focus_id", "subject_id")
    matrix = projection.verification_matrix(named(subjects), named(assessments), named(bindings), named(overlays))
    return Projection(
        refused=refused,
        nodes=nodes,
        edges=edges,
        placements=open_(primary),
        chains=chains,
        overlays=overlays,
        focus_edges=focus_edges,
        groups=groups,
        group_members=grouped,
        components=projection.components(nodes.where(F.col("delta").isin(*CHANGES))),
        dispositions=told.select("review_id", "focus_id", state.alias("state")),
        matrix=matrix,
        statuses=projection.status_counts(matrix),
        evidence=projection.overlay_evidence(overlays, nodes),
        observed=projection.observed_focuses(overlays, focus_edges, grouped),
    )


@dataclass
class WholeReview:
    review: Review
    facts: StructuralFacts
    closure: DataFrame
    projection: Projection
    subjects: DataFrame
    unmatched: DataFrame
    claim_overlays: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name."""
        parts = (("", self.review), ("facts_", self.facts), ("projection_", self.projection))
        return {f"{mark}{f.name}": getattr(part, f.name) for mark, part in parts for f in fields(part)} | {n: getattr(self, n) for n in ("closure", "subjects", "unmatched", "claim_overlays")}


def whole_review(read: DataFrame, graphs: Graphs) -> WholeReview:
    """review() of packets with their recorded graphs, up to the projection."""
    read = kept(read)
    told = review(read)
    files = packets.changed_files(read).select("review_id", "base_path", "head_path", "status")
    found = structural_facts(graphs, files, told.relations.withColumn("relation_id", F.concat_ws(":change:", "hunk_id", "ordinal")))

    # selected anchors are change relations; the symbols that their lines touch stand for them in the graph
    node = found.symbols.select("review_id", "side", "symbol_id", "node_id")
    symbols_of = found.touched.join(node, ["review_id", "side", "symbol_id"]).select("review_id", F.col("relation_id").alias("change_id"), "node_id").distinct()
    lines_of = told.facts.select("review_id", F.col("id").alias("target_id"), F.explode("change_relation_ids").alias("change_id"))
    chosen = told.selections.where("selected").select("review_id", "focus_id", "relation_id", "target_id", "association")
    anchors = kept(chosen.join(lines_of, ["review_id", "target_id"]).join(symbols_of, ["review_id", "change_id"]).select("review_id", "focus_id", "relation_id", "target_id", "node_id", "association").distinct())

    # paths through an anchor's symbol, and unchanged symbols on them
    reach = found.paths.select("review_id", "path_id", F.explode("nodes").alias("node_id")).distinct()
    path_ids = anchors.join(reach, ["review_id", "node_id"]).groupBy("review_id", "focus_id", F.col("target_id").alias("anchor_id")).agg(F.array_sort(F.collect_set("path_id")).alias("path_ids"))
    around = found.symbols.groupBy("review_id", F.col("node_id").alias("symbol_id")).agg(F.min("profile").alias("profile"))
    around = around.join(found.changes.select("review_id", F.col("node_id").alias("symbol_id")).distinct().withColumn("changed", F.lit(True)), ["review_id", "symbol_id"], "left").na.fill(False, ["changed"])
    on = reach.groupBy("review_id", F.col("node_id").alias("symbol_id")).agg(F.array_sort(F.collect_set("path_id")).alias("path_ids"))
    candidates = kept(structure.structural_candidates(path_ids, found.paths.select("review_id", "path_id"), around.join(on, ["review_id", "symbol_id"])))
    # relations of a focus come in the order of their targets
    ranked = candidates.withColumn("rank", F.dense_rank().over(Window.partitionBy("review_id", "focus_id").orderBy("target_id")).cast("long"))
    paths = ranked.where("slot = 'structural_path'").join(found.paths.select("review_id", F.col("path_id").alias("target_id"), "depth", "nodes"), ["review_id", "target_id"])
    contexts = ranked.where("slot <> 'structural_path'").groupBy("review_id", "focus_id", "slot", "target_id", "rank").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bridge_ids")))).alias("bridge_ids")).withColumn("source_ordinal", F.lit(0).cast("long"))
    closed = kept(closure.structural_closure(paths.select("review_id", "focus_id", "target_id", F.col("depth").cast("int").alias("depth"), "rank", "nodes", "bridge_ids"), anchors.select("review_id", "focus_id", "target_id", "node_id"), contexts))

    relation = F.concat(F.lit("PR:"), F.substring(F.sha2(F.concat_ws("\0", "focus_id", "slot", "id"), 256), 1, 20)).alias("relation_id")
    kept_paths = closed.where("kind = 'path'").select("review_id", "focus_id", relation, F.col("id").alias("path_id")).join(found.paths.select("review_id", "path_id", F.col("nodes").alias("node_ids")), ["review_id", "path_id"])
    kept_contexts = closed.where("kind = 'context'").select("review_id", "focus_id", relation, F.col("id").alias("node_id"))
    foci = told.statements.where("statement_id rlike '^[RG][0-9]+$'").select("review_id", F.col("statement_id").alias("focus_id"))
    foci = foci.union(told.diagnostics.where("focus_id is not null").select("review_id", "focus_id")).union(chosen.select("review_id", "focus_id")).distinct()
    states = told.diagnostics.groupBy("review_id", "focus_id").agg(F.array_sort(F.collect_set("state")).alias("states"))
    deferred = told.selections.where("canonical and not selected").groupBy("review_id", "focus_id").agg(F.count("*").alias("n_deferred"))
    other = chosen.join(anchors.select("review_id", "focus_id", "relation_id").distinct(), ["review_id", "focus_id", "relation_id"], "left_anti").groupBy("review_id", "focus_id").agg(F.count("*").alias("n_other"))
    others = foci.join(states, ["review_id", "focus_id"], "left").join(deferred, ["review_id", "focus_id"], "left").join(other, ["review_id", "focus_id"], "left")

    # what checks of the head say of each focus
    checks = told.check_selections.where("selected").withColumn("said", convergence.check_outcome(F.col("status"), F.col("conclusion")))
    folded = checks.groupBy("review_id", "focus_id").agg(F.bool_or(F.col("said") == "failure").alias("failed"), F.bool_or(F.col("said") == "success").alias("passed"))
    assessed = folded.select("review_id", "focus_id", F.when(F.col("failed"), "contradicted").when(F.col("passed"), "partial").otherwise("unverified").alias("status"))
    bindings = chosen.select("review_id", "focus_id", F.col("target_id").alias("evidence_id"))
    shown = project(found, anchors, kept_contexts, kept_paths, foci, assessed, bindings, others.select("review_id", "focus_id", "n_deferred", "n_other", "states"))
    subjects, lost = claim_subjects(told, found)
    nodes_of = found.changes.select("review_id", "id", "node_id")
    return WholeReview(told, found, closed, shown, kept(subjects), lost, projection.selector_provenance(subjects, nodes_of))


def claim_subjects(told: Review, found: StructuralFacts) -> tuple[DataFrame, DataFrame]:
    """Structural changes that the predicates of authored claims select, and predicates that select none."""
    signature = association_signature(F.col("qualified_name"), F.col("path"))
    signed = found.changes.select("review_id", "id", "path", F.col("path").alias("base_path"), F.col("path").alias("head_path"), signature.alias("base_signature"), signature.alias("head_signature"))
    return alignment.subjects(told.predicates, signed)

"""Structural facts of reviews: symbols, relations and ownership of both revisions, and the candidates that paths give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators import delta
from chalkline.operators.facts import evidence_id

IDENTITY = ("file_path", "qualified_name", "kind")


def sided(symbol_id: Column, side: Column) -> Column:
    """A provider's id with its revision: base ids have a prefix."""
    return F.when(side == "base", F.concat(F.lit("base:"), symbol_id)).otherwise(symbol_id)


def symbol_fact_id(symbol_id: Column, side: Column) -> Column:
    return evidence_id("symbol", sided(symbol_id, side))


def path_key(seed: Column, steps: Column, side: Column) -> Column:
    """A path's identity: its seed and steps, with the revision."""
    text = F.transform(steps, lambda s: F.concat_ws(">", s["source"], s["relation"], s["direction"], s["target"]))
    return sided(F.concat(seed, F.lit("|"), F.array_join(text, "|")), side)


def path_summary(names: Column) -> Column:
    return F.array_join(names, " → ")


def symbol_changes(symbols: DataFrame, files: DataFrame, coverage: DataFrame, relations: DataFrame, mapped: DataFrame) -> DataFrame:
    """review_id, the identity, in_base, in_head and operation of every symbol that either revision has changed.

    symbols: review_id, side, the identity, change_relation_ids; files: review_id, base_path, head_path, status; coverage:
    review_id, side and the identities looked up completely there; relations: review_id, relation_id, kind, added and
    removed (line numbers); mapped: review_id, side, relation_id, line for lines that symbols of that side contain.
    """
    keys = ["review_id", *IDENTITY]
    both = symbols.groupBy(*keys).agg(
        F.bool_or(F.col("side") == "base").alias("in_base"),
        F.bool_or(F.col("side") == "head").alias("in_head"),
        F.array_distinct(F.flatten(F.collect_list("change_relation_ids"))).alias("relation_ids"),
    )
    status = files.select("review_id", F.explode(F.array_distinct(F.array_compact(F.array("base_path", "head_path")))).alias("file_path"), "status", "base_path", "head_path")
    status = status.groupBy("review_id", "file_path").agg(F.bool_or((F.col("status") == "added") & (F.col("head_path") == F.col("file_path"))).alias("file_added"), F.bool_or((F.col("status") == "removed") & (F.col("base_path") == F.col("file_path"))).alias("file_removed"))
    seen = coverage.groupBy(*keys).agg(F.bool_or(F.col("side") == "base").alias("base_looked"), F.bool_or(F.col("side") == "head").alias("head_looked"))
    # how far each relation's lines on one side belong to symbols there
    lines = relations.select("review_id", "relation_id", F.inline(F.array(F.struct(F.lit("base").alias("line_side"), F.col("removed").alias("numbers")), F.struct(F.lit("head").alias("line_side"), F.col("added").alias("numbers")))))
    lines = lines.select("review_id", "relation_id", "line_side", F.explode("numbers").alias("line"))
    held = mapped.select("review_id", "relation_id", F.col("side").alias("line_side"), "line").distinct().withColumn("held", F.lit(1))
    full = lines.join(held, ["review_id", "relation_id", "line_side", "line"], "left").groupBy("review_id", "relation_id").agg(
        F.coalesce(F.bool_and(F.when(F.col("line_side") == "base", F.col("held").isNotNull())), F.lit(False)).alias("base_full"),
        F.coalesce(F.bool_and(F.when(F.col("line_side") == "head", F.col("held").isNotNull())), F.lit(False)).alias("head_full"),
    )
    known = relations.select("review_id", "relation_id", F.col("kind").alias("relation_kind")).join(full, ["review_id", "relation_id"], "left")
    own = both.select(*keys, F.explode("relation_ids").alias("relation_id")).join(known, ["review_id", "relation_id"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = own.groupBy(*keys).agg(F.bool_and(F.col("relation_kind") == "added").alias("all_added"), F.bool_and(F.col("relation_kind") == "removed").alias("all_removed"), F.bool_and(no("base_full")).alias("all_base"), F.bool_and(no("head_full")).alias("all_head"))
    joined = both.join(status, ["review_id", "file_path"], "left").join(seen, keys, "left").join(own, keys, "left")
    looked = F.when(F.col("in_head"), no("base_looked")).otherwise(no("head_looked"))
    opposite = F.when(F.col("in_head"), no("all_base")).otherwise(no("all_head"))
    operation = delta.change_operation(F.col("in_base"), F.col("in_head"), F.lit(False), no("file_added"), no("file_removed"), F.col("kind") == "file", looked, no("all_added"), no("all_removed"), opposite)
    return joined.select(*keys, "in_base", "in_head", operation.alias("operation"))


def relation_changes(paths: DataFrame, changed: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of relations on paths, and how many are undecided for each review.

    paths: review_id, side, seed, steps (source, target, relation, direction; symbols as identities over both revisions);
    changed: review_id, node, operation; seeds: review_id, side, seed, state. A relation that one revision alone shows is
    added or removed if an end is, or if a seed of a path that shows it is complete in the other revision.
    """
    steps = paths.select("review_id", "side", "seed", F.explode("steps").alias("s"))
    back = F.col("s.direction") == "incoming"
    steps = steps.select("review_id", "side", "seed", F.when(back, F.col("s.target")).otherwise(F.col("s.source")).alias("source"), F.when(back, F.col("s.source")).otherwise(F.col("s.target")).alias("target"), F.col("s.relation").alias("relation")).distinct()
    keys = ["review_id", "source", "target", "relation"]
    complete = seeds.where("state = 'complete'").select("review_id", F.when(F.col("side") == "base", "head").otherwise("base").alias("side"), "seed").distinct().withColumn("other_complete", F.lit(True))
    shown = steps.join(complete, ["review_id", "side", "seed"], "left")
    folded = shown.groupBy(*keys).agg(
        F.bool_or(F.col("side") == "base").alias("in_base"),
        F.bool_or(F.col("side") == "head").alias("in_head"),
        F.coalesce(F.bool_or((F.col("side") == "head") & F.col("other_complete")), F.lit(False)).alias("base_proves"),
        F.coalesce(F.bool_or((F.col("side") == "base") & F.col("other_complete")), F.lit(False)).alias("head_proves"),
    )
    ends = changed.groupBy("review_id", "node").agg(F.bool_or(F.col("operation") == "added").alias("a"), F.bool_or(F.col("operation") == "removed").alias("r"))
    for end in ("source", "target"):
        folded = folded.join(ends.select("review_id", F.col("node").alias(end), F.col("a").alias(f"{end}_a"), F.col("r").alias(f"{end}_r")), ["review_id", end], "left")
    either = lambda k: F.coalesce(F.col(f"source_{k}"), F.lit(False)) | F.coalesce(F.col(f"target_{k}"), F.lit(False))
    operation = delta.relation_operation(F.col("in_base"), F.col("in_head"), either("a"), either("r"), F.col("base_proves"), F.col("head_proves"))
    decided = folded.select(*keys, operation.alias("operation"))
    undecided = decided.where("operation is null").groupBy("review_id").agg(F.count("*").alias("n_undecided"))
    return decided.where("operation is not null"), undecided


def ownership_changes(rows: DataFrame, changed: DataFrame, coverage: DataFrame, observed: DataFrame) -> DataFrame:
    """review_id, parent, child and operation of containment rows (review_id, side, parent, child).

    The other revision proves an absence if its ownership coverage is complete and it has the child (observed: review_id,
    side, node; coverage: review_id, side, state). Undecided rows have a null operation.
    """
    keys = ["review_id", "parent", "child"]
    folded = delta.sides(rows, keys)
    known = coverage.where("state = 'complete'").join(observed, ["review_id", "side"]).groupBy("review_id", F.col("node").alias("child")).agg(F.bool_or(F.col("side") == "base").alias("b"), F.bool_or(F.col("side") == "head").alias("h"))
    ends = changed.groupBy("review_id", "node").agg(F.bool_or(F.col("operation") == "added").alias("a"), F.bool_or(F.col("operation") == "removed").alias("r"))
    joined = folded.join(known, ["review_id", "child"], "left")
    for end in ("parent", "child"):
        joined = joined.join(ends.select("review_id", F.col("node").alias(end), F.col("a").alias(f"{end}_a"), F.col("r").alias(f"{end}_r")), ["review_id", end], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    operation = delta.relation_operation(F.col("in_base"), F.col("in_head"), yes("parent_a") | yes("child_a"), yes("parent_r") | yes("child_r"), yes("b"), yes("h"))
    return joined.select(*keys, operation.alias("operation"))


def structural_candidates(anchors: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """Paths of candidate anchors, and unchanged symbols on them as runtime or test context, with what bridges them.

    anchors: review_id, focus_id, anchor_id, path_ids; paths: review_id, path_id; symbols: review_id, symbol_id, profile,
    changed, path_ids. Rows: review_id, focus_id, slot, target_id, bridge_ids.
    """
    keys = ["review_id", "focus_id"]
    reached = anchors.select(*keys, "anchor_id", F.explode("path_ids").alias("path_id")).join(paths.select("review_id", "path_id"), ["review_id", "path_id"])
    routes = reached.groupBy(*keys, "path_id").agg(F.array_sort(F.collect_set("anchor_id")).alias("bridge_ids"))
    slot = F.when(F.col("profile") == "test", "test_context").when(F.col("profile") == "production", "runtime_context")
    around = symbols.where(~F.col("changed")).select("review_id", "symbol_id", slot.alias("slot"), F.explode("path_ids").alias("path_id")).where("slot is not null")
    context = routes.select(*keys, "path_id").join(around, ["review_id", "path_id"])
    return routes.select(*keys, F.lit("structural_path").alias("slot"), F.col("path_id").alias("target_id"), "bridge_ids").unionByName(context.select(*keys, "slot", F.col("symbol_id").alias("target_id"), F.array("path_id").alias("bridge_ids")))


def reachable(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """candidates without bridges, or with one that is selected (review_id, focus_id, target_id)."""
    keys = ["review_id", "focus_id"]
    bridged = candidates.where(F.size("bridge_ids") > 0).withColumn("bridge", F.explode("bridge_ids"))
    met = bridged.join(selected.select(*keys, F.col("target_id").alias("bridge")), [*keys, "bridge"], "left_semi").drop("bridge").dropDuplicates([*keys, "slot", "target_id"])
    return candidates.where(F.size("bridge_ids") == 0).unionByName(met)


def check_candidates(foci: DataFrame, checks: DataFrame, packets: DataFrame) -> DataFrame:
    """Every focus with the checks of its review's head (checks: review_id, id, head_sha; packets: review_id, head_sha)."""
    current = checks.join(packets.select("review_id", F.col("head_sha").alias("reviewed")), "review_id").where("head_sha = reviewed and reviewed <> ''")
    return foci.select("review_id", "focus_id").join(current.select("review_id", F.col("id").alias("target_id")), "review_id").withColumn("slot", F.lit("verification")).withColumn("association", F.lit("current_head"))


def missing_slots(foci: DataFrame, candidates: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """review_id, focus_id and slot of each slot of a focus that has no candidate."""
    wanted = foci.select("review_id", "focus_id", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    return wanted.join(candidates.select("review_id", "focus_id", "slot").distinct(), ["review_id", "focus_id", "slot"], "left_anti")


def placements(ownership: DataFrame) -> DataFrame:
    """parent, child, and the ids of ownership rows (review_id, side, id) by revision."""
    ids = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("id")))).alias(f"{side}_ids")
    return ownership.groupBy("review_id", "parent", "child").agg(ids("base"), ids("head"), F.bool_or(F.col("side") == "head").alias("in_head"))


def revision_diagnostics(indexes: DataFrame) -> DataFrame:
    """review_id, side and state of what a revision's graph can't tell (indexes: state, n_truncated): stale over unavailable
    over partial, and truncated besides."""
    base = F.when(F.col("state") == "stale", "stale_source").when(F.col("state").isin("missing", "invalid", "error"), "provider_unavailable").when(F.col("state") == "partial", "partial_coverage")
    both = F.array_compact(F.array(base, F.when(F.col("n_truncated") > 0, "traversal_truncated")))
    return indexes.select("review_id", "side", F.explode(both).alias("diagnostic"))

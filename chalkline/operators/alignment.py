"""Claims bound to facts: by closure scans, by selected subjects, and by words; then what each claim is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.lexical import distinctive_terms, identifier_keys, semantic_tokens
from chalkline.functions.selectors import candidate_keys, candidate_paths, eligible_evidence, selector_matches

#: Bounds of a claim's closure.
CLOSURE_DEPTH, CLOSURE_PATHS, OWNERSHIP_DEPTH = 3, 30, 3


def subjects(predicates: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structural changes that predicates select, and predicates that select none.

    predicates: review_id, claim_id, predicate_id, selector_kind, values, expectation; changes: review_id, id, path,
    base_path, head_path, base_signature, head_signature.
    """
    each = predicates.select("review_id", "claim_id", "predicate_id", "selector_kind", "expectation", F.explode("values").alias("value"))
    kind = F.when(F.col("selector_kind") == "ordered_path", F.lit("symbol")).otherwise(F.col("selector_kind"))
    pairs = each.join(changes, "review_id")
    paths = candidate_paths(F.col("expectation"), F.col("path"), F.col("base_path"), F.col("head_path"))
    keys = candidate_keys(F.col("expectation"), F.col("base_signature"), F.col("head_signature"))
    met = pairs.where(selector_matches(kind, F.col("value"), paths, keys, F.lit(False), F.lit(""), F.lit("")))
    found = met.select("review_id", "claim_id", "predicate_id", F.col("value").alias("selector"), F.col("id").alias("evidence_id")).distinct()
    lost = predicates.select("review_id", "claim_id", "predicate_id").join(found, ["review_id", "claim_id", "predicate_id"], "left_anti").withColumn("state", F.lit("no_structural_match"))
    return found, lost


def claim_closure(found: DataFrame, paths: DataFrame, depth: int = CLOSURE_DEPTH, limit: int = CLOSURE_PATHS) -> DataFrame:
    """review_id, claim_id, path_id and selected: paths of a claim's subjects, shortest first (paths: review_id, seed_id, path_id, depth)."""
    own = found.select("review_id", "claim_id", F.col("evidence_id").alias("seed_id")).join(paths, ["review_id", "seed_id"]).groupBy("review_id", "claim_id", "path_id").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy("review_id", "claim_id").orderBy("depth", "path_id"))
    return own.withColumn("selected", (F.col("depth") <= depth) & (place <= limit))


def lexical_bindings(claims: DataFrame, items: DataFrame) -> DataFrame:
    """review_id, claim_id, evidence_id and association of eligible facts that share an identifier or telling words.

    claims: review_id, claim_id, kind, text; items: review_id, id, evidence_role, profile, operation, base_signature,
    head_signature. Words must tell among the claims and among the claim's eligible facts.
    """
    signed = claims.select("review_id", "claim_id", F.col("kind").alias("claim_kind"), semantic_tokens(F.col("text")).alias("tokens"), identifier_keys(F.col("text")).alias("claim_ids"))
    telling = distinctive_terms(signed, ["claim_id"], "tokens", ["review_id"]).groupBy("review_id", "claim_id").agg(F.collect_list("term").alias("telling"))
    every = lambda s: F.concat(f"{s}.identifiers", f"{s}.tokens")
    pairs = signed.join(items, "review_id").where(eligible_evidence(F.col("claim_kind"), F.col("evidence_role"), F.col("profile"), F.col("operation"), every("base_signature"), every("head_signature")))
    base = F.col("claim_kind").isin("removal", "before_topology")
    pick = lambda part: F.when(base, F.col(f"base_signature.{part}")).otherwise(F.col(f"head_signature.{part}"))
    pairs = pairs.select("review_id", "claim_id", "id", "tokens", "claim_ids", pick("tokens").alias("fact_tokens"), pick("identifiers").alias("fact_ids"))
    there = distinctive_terms(pairs.select("review_id", "claim_id", "id", F.col("fact_tokens").alias("tokens")), ["id"], "tokens", ["review_id", "claim_id"]).groupBy("review_id", "claim_id", "id").agg(F.collect_list("term").alias("there"))
    pairs = pairs.join(telling, ["review_id", "claim_id"], "left").join(there, ["review_id", "claim_id", "id"], "left")
    none = F.array().cast("array<string>")
    shared = F.array_intersect("tokens", "fact_tokens")
    words = F.array_intersect(F.array_intersect(shared, F.coalesce("telling", none)), F.coalesce("there", none))
    association = F.when(F.arrays_overlap("claim_ids", "fact_ids"), "exact_identifier").when((F.size(shared) >= 2) & (F.size(words) > 0), "distinctive_phrase")
    return pairs.select("review_id", "claim_id", F.col("id").alias("evidence_id"), association.alias("association")).where("association is not null")


def bindings(closures: DataFrame, selected: DataFrame, lexical: DataFrame) -> DataFrame:
    """One row for each claim and fact: a closure scan's over a selected subject's over words'.

    closures and selected: review_id, claim_id, evidence_id; both count as provided.
    """
    given = closures.select("review_id", "claim_id", "evidence_id", F.lit(0).alias("rank")).union(selected.select("review_id", "claim_id", "evidence_id", F.lit(1)))
    rows = given.withColumn("association", F.lit("provided_association")).unionByName(lexical.select("review_id", "claim_id", "evidence_id", "association", F.lit(2).alias("rank")))
    best = rows.groupBy("review_id", "claim_id", "evidence_id").agg(F.min_by("association", "rank").alias("association"), F.min("rank").alias("rank"))
    source = F.element_at(F.array(F.lit("closure"), F.lit("subject"), F.lit("lexical")), F.col("rank") + 1)
    return best.select("review_id", "claim_id", "evidence_id", "association", source.alias("origin"))


def unbound(claims: DataFrame, bound: DataFrame, eligible: DataFrame) -> DataFrame:
    """Claims without a binding: no_association if a fact was eligible (review_id, claim_id), else no_eligible_fact."""
    left = claims.select("review_id", "claim_id").join(bound.select("review_id", "claim_id").distinct(), ["review_id", "claim_id"], "left_anti")
    some = eligible.select("review_id", "claim_id").distinct().withColumn("some", F.lit(True))
    return left.join(some, ["review_id", "claim_id"], "left").select("review_id", "claim_id", F.when(F.col("some"), "no_association").otherwise("no_eligible_fact").alias("state"))


def bypasses(bound: DataFrame, paths: DataFrame, authority: DataFrame) -> DataFrame:
    """review_id, claim_id, path_id of outgoing executable paths that reach a controlled sink without an authority before it.

    bound: paths already bound to the claim; paths: review_id, path_id, nodes; authority: review_id, claim_id, node. Paths are
    listed by their nodes once; authorities and sinks meet them by node, so no claim meets all paths of its review.
    """
    claim, path = ["review_id", "claim_id"], ["review_id", "claim_id", "path_id"]
    last = paths.select("review_id", "path_id", F.element_at("nodes", -1).alias("sink"))
    along = paths.select("review_id", "path_id", F.posexplode("nodes").alias("at", "node"), (F.size("nodes") - 1).alias("end"))
    met = along.join(authority.select(*claim, "node").distinct(), ["review_id", "node"])
    controlled = met.where("at < end").select(*path).distinct().join(bound.select(*path), path, "left_semi")
    sinks = controlled.join(last, ["review_id", "path_id"]).select(*claim, "sink").distinct()
    reached = last.join(sinks, ["review_id", "sink"]).select(*path)
    return reached.join(met.select(*path), path, "left_anti").join(bound.select(*path), path, "left_anti")


def control(bound: DataFrame, paths: DataFrame, authority: DataFrame, revisions: DataFrame, doubts: DataFrame) -> DataFrame:
    """review_id, claim_id, n_controls, n_bypasses, incomplete, uncertain and status of every claim with an authority.

    revisions: review_id, state and n_truncated of the head's graph; doubts: review_id, claim_id of claims that authored
    uncertainty speaks of. A bypass contradicts; control demonstrates if the head's graph is complete and nobody doubts it.
    """
    claim, path = ["review_id", "claim_id"], ["review_id", "claim_id", "path_id"]
    along = paths.select("review_id", "path_id", F.posexplode("nodes").alias("at", "node"), (F.size("nodes") - 1).alias("end")).where("at < end")
    holds = along.join(authority.select(*claim, "node").distinct(), ["review_id", "node"]).select(*path).distinct().join(bound.select(*path), path, "left_semi")
    count = lambda df, name: df.groupBy(*claim).agg(F.count("*").alias(name))
    gaps = revisions.groupBy("review_id").agg(F.bool_or((F.coalesce("state", F.lit("")) != "complete") | (F.col("n_truncated") > 0)).alias("incomplete"))
    out = authority.select(*claim).distinct().join(count(holds, "n_controls"), claim, "left").join(count(bypasses(bound, paths, authority), "n_bypasses"), claim, "left")
    out = out.join(gaps, "review_id", "left").join(doubts.select(*claim).distinct().withColumn("uncertain", F.lit(True)), claim, "left")
    out = out.na.fill(0, ["n_controls", "n_bypasses"]).na.fill({"incomplete": True, "uncertain": False})
    status = F.when(F.col("n_bypasses") > 0, "contradicted").when(F.col("n_controls") == 0, "unverified").when(F.col("incomplete") | F.col("uncertain"), "partial").otherwise("demonstrated")
    return out.withColumn("status", status)

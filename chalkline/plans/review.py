"""Whole reviews as one plan: packets to statements, facts, associations and bounded selections, many reviews at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import focus as focusing
from chalkline.functions.lexical import distinctive_terms, identifier_keys, semantic_tokens
from chalkline.operators import convergence, extraction, facts, structure
from chalkline.plans.shared import kept
from chalkline.sources import diffs, packets

#: Limits of selected anchors: direct, bridged, all.
DIRECT, BRIDGED, ANCHORS = 20, 10, 30
#: Claims kept of those looked at, and identities of checks.
CLAIMS, LOOKED_AT, CHECKS = 2, 12, 20
SLOTS = ("claim", "changed_anchor", "verification")
PRECISION = ("structural_change", "change_relation", "changed_file")


@dataclass
class Review:
    statements: DataFrame
    claims: DataFrame
    predicates: DataFrame
    relations: DataFrame
    facts: DataFrame
    checks: DataFrame
    notes: DataFrame
    candidates: DataFrame
    selections: DataFrame
    claim_selections: DataFrame
    check_selections: DataFrame
    diagnostics: DataFrame


def relation_id(*parts: str) -> Column:
    return F.concat(F.lit("PR:"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 20))


def anchor_candidates(foci: DataFrame, anchors: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """Candidates of foci (review_id, focus_id, kind, purpose, text) and anchors (review_id, id, kind, profile, ...).

    Eligible anchors by profile; identifiers over phrases; generic phrases only in lanes without a discriminative one;
    guardrails by identifiers alone. bridges: review_id, focus_id, fact_id, bridge_ids of claims in between.
    """
    spark = foci.sparkSession
    foci = foci.withColumn("tokens", semantic_tokens(F.col("text"))).withColumn("identifiers", identifier_keys(F.col("text")))
    foci = kept(foci)
    foci = foci.withColumn("focus_profile", focusing.requirement_profile(F.col("kind"), F.col("text"), F.col("tokens"))).withColumn("removal", focusing.asks_removal(F.col("tokens")))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECISION)), F.col("kind")), F.lit(0)), F.lit(9))
    anchors = anchors.withColumn("precision", place).withColumnRenamed("kind", "fact_kind")
    lanes = foci.join(F.broadcast(focusing.admissions(spark)), "focus_profile")
    pairs = lanes.join(anchors, (lanes["review_id"] == anchors["review_id"]) & (lanes["admitted_profile"] == anchors["profile"])).drop(anchors["review_id"])
    old = (F.col("revision_side") == "base") | (F.col("operation") == "removed")
    guard = F.col("focus_profile") == "guardrail"
    pairs = pairs.where("role = 'changed_anchor'").where(~old | guard | F.col("removal"))
    signature = focusing.directional_signature(F.col("head_signature"), F.col("base_signature"), F.col("revision_side"), guard, F.col("removal"))
    pairs = pairs.withColumn("signature", signature)
    order = Window.partitionBy("review_id", "focus_id").orderBy("precision", "path", "first_line", "id")
    pairs = kept(pairs.withColumn("source_ordinal", F.row_number().over(order) - 1))
    keys = ["review_id", "focus_id", "id"]
    # terms distinctive among the foci, and among each focus's eligible anchors too
    own = distinctive_terms(foci, ["focus_id"], "tokens", ["review_id"]).groupBy("review_id", "focus_id").agg(F.collect_list("term").alias("focus_terms"))
    there = distinctive_terms(pairs.select(*keys, F.col("signature.tokens").alias("tokens")), ["id"], "tokens", ["review_id", "focus_id"]).groupBy(*keys).agg(F.collect_list("term").alias("anchor_terms"))
    pairs = pairs.join(own, ["review_id", "focus_id"], "left").join(there, keys, "left")
    none = F.array().cast("array<string>")
    shared = F.array_intersect("tokens", "signature.tokens")
    telling = F.array_intersect(shared, F.coalesce("focus_terms", none))
    phrase = (F.size(shared) >= 2) & (F.size(telling) > 0)
    sharp = F.array_intersect(telling, F.coalesce("anchor_terms", none))
    pairs = pairs.withColumn("exact", F.array_intersect("identifiers", "signature.identifiers")).withColumn("phrase", F.when(phrase, telling)).withColumn("sharp", F.when(phrase & (F.size(sharp) > 0), sharp))
    is_exact = F.size("exact") > 0
    cohort = F.max(~is_exact & F.col("sharp").isNotNull()).over(Window.partitionBy("review_id", "focus_id", "profile"))
    pairs = pairs.withColumn("cohort", cohort)
    direct = F.when(is_exact, "exact_identifier").when(F.col("phrase").isNotNull() & (F.col("sharp").isNotNull() | ~F.col("cohort")) & (F.col("kind") != "guardrail"), "distinctive_phrase")
    terms = F.when(is_exact, F.col("exact")).otherwise(F.coalesce("sharp", "phrase"))
    pairs = pairs.withColumn("direct", direct).withColumn("terms", terms)
    if bridges is None:
        pairs = pairs.withColumn("bridge_ids", none)
    else:
        pairs = pairs.join(bridges.withColumnRenamed("fact_id", "id"), keys, "left").withColumn("bridge_ids", F.coalesce("bridge_ids", none))
    association = F.when(F.col("direct").isNotNull(), F.col("direct")).when(F.size("bridge_ids") > 0, "claim_bridge")
    out = pairs.withColumn("association", association).where("association is not null")
    out = out.withColumn("evidence_role", focusing.evidence_role(F.col("focus_profile"), F.col("profile"))).withColumn("slot", F.lit("changed_anchor")).withColumn("target_type", F.lit("evidence")).withColumnRenamed("id", "target_id")
    return out.select("review_id", "focus_id", relation_id("focus_id", "slot", "target_type", "target_id", "association", "evidence_role").alias("relation_id"), "slot", "target_id", "association", "evidence_role", "source_ordinal", F.when(F.col("direct").isNotNull(), F.col("terms")).otherwise(none).alias("matched_terms"), "bridge_ids")


def claim_links(foci: DataFrame, claims: DataFrame) -> DataFrame:
    """review_id, focus_id, claim_id and association: claims that name the focus, share an identifier, or a telling phrase."""
    signed = lambda df, key: df.select("review_id", F.col("statement_id").alias(key), "text", semantic_tokens(F.col("text")).alias(f"{key}_tokens"), identifier_keys(F.col("text")).alias(f"{key}_keys"))
    left, right = signed(foci, "focus_id"), signed(claims, "claim_id").withColumnRenamed("text", "claim_text")
    own = distinctive_terms(left.withColumnRenamed("focus_id_tokens", "tokens"), ["focus_id"], "tokens", ["review_id"]).groupBy("review_id", "focus_id").agg(F.collect_list("term").alias("telling"))
    pairs = kept(left.join(right, "review_id").join(own, ["review_id", "focus_id"], "left"))
    named = F.array_contains(F.regexp_extract_all("claim_text", F.lit(r"\b([RG][0-9]+)\b"), F.lit(1)), F.col("focus_id"))
    shared = F.array_intersect("focus_id_tokens", "claim_id_tokens")
    phrase = (F.size(shared) >= 2) & F.arrays_overlap(shared, F.coalesce("telling", F.array().cast("array<string>")))
    association = F.when(named, "explicit_reference").when(F.size(F.array_intersect("focus_id_keys", "claim_id_keys")) > 0, "exact_identifier").when(phrase, "distinctive_phrase")
    return pairs.select("review_id", "focus_id", "claim_id", association.alias("association")).where("association is not null")


def claim_bridges(links: DataFrame, claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """review_id, focus_id, fact_id and bridge_ids: facts of claims that the focus is linked with, on terms that are
    telling among the claims and among the anchors."""
    signed = claims.select("review_id", F.col("statement_id").alias("claim_id"), semantic_tokens(F.col("text")).alias("tokens"), identifier_keys(F.col("text")).alias("claim_keys"))
    facts_ = anchors.where("role = 'changed_anchor'").select("review_id", F.col("id").alias("fact_id"), F.col("head_signature.tokens").alias("fact_tokens"), F.col("head_signature.identifiers").alias("fact_keys"))
    own = distinctive_terms(signed, ["claim_id"], "tokens", ["review_id"]).groupBy("review_id", "claim_id").agg(F.collect_list("term").alias("c"))
    there = distinctive_terms(facts_.withColumnRenamed("fact_tokens", "tokens"), ["fact_id"], "tokens", ["review_id"]).groupBy("review_id", "fact_id").agg(F.collect_list("term").alias("f"))
    pairs = kept(signed.join(facts_, "review_id").join(own, ["review_id", "claim_id"], "left").join(there, ["review_id", "fact_id"], "left"))
    none = F.array().cast("array<string>")
    shared = F.array_intersect("tokens", "fact_tokens")
    telling = F.array_intersect(F.array_intersect(shared, F.coalesce("c", none)), F.coalesce("f", none))
    met = pairs.where((F.size(F.array_intersect("claim_keys", "fact_keys")) > 0) | ((F.size(shared) >= 2) & (F.size(telling) > 0)))
    return links.join(met.select("review_id", "claim_id", "fact_id"), ["review_id", "claim_id"]).groupBy("review_id", "focus_id", "fact_id").agg(F.array_sort(F.collect_set("claim_id")).alias("bridge_ids"))


def select_anchors(candidates: DataFrame) -> DataFrame:
    """candidates with canonical and selected, within the limits."""
    order = [c for c in convergence.selection_order()]
    ranked = convergence.canonical_targets(candidates, ["review_id", "focus_id", "target_id"], order)
    kept = ranked.where("canonical").withColumn("bridged", F.col("association") == "claim_bridge")
    chosen = convergence.anchor_budget(kept, ["review_id", "focus_id"], "bridged", order, DIRECT, BRIDGED, ANCHORS).drop("bridged")
    return chosen.unionByName(ranked.where("not canonical").withColumn("selected", F.lit(False)))


def select_claims(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of each focus with selected and ambiguous: they compete by tier, then by their own order."""
    order = claims.select("review_id", F.col("statement_id").alias("claim_id"), F.regexp_extract("statement_id", "([0-9]+)$", 1).cast("int").alias("source_ordinal"))
    rows = links.join(order, ["review_id", "claim_id"]).withColumn("slot", F.lit("claim")).withColumn("target_type", F.lit("statement")).withColumn("evidence_role", F.lit("primary")).withColumnRenamed("claim_id", "target_id")
    rows = rows.withColumn("tier", convergence.tier_of(F.col("association"))).withColumn("relation_id", relation_id("focus_id", "slot", "target_type", "target_id", "association", "evidence_role"))
    return convergence.competitive_slot(rows, ["review_id", "focus_id"], "tier", convergence.selection_order(), CLAIMS, LOOKED_AT).drop("tier", "place")


def select_checks(foci: DataFrame, checks: DataFrame, heads: DataFrame) -> DataFrame:
    """The reviewed head's checks for each focus with conflicting and selected: failures first, conflicts kept."""
    rows = structure.check_candidates(foci, checks, heads).join(checks.select("review_id", F.col("id").alias("target_id"), "identity", "status", "conclusion"), ["review_id", "target_id"])
    rows = rows.withColumn("target_type", F.lit("evidence")).withColumn("evidence_role", F.lit("primary")).withColumn("outcome", convergence.check_outcome(F.col("status"), F.col("conclusion")))
    rows = rows.withColumn("relation_id", relation_id("focus_id", "slot", "target_type", "target_id", "association", "evidence_role"))
    return convergence.check_convergence(rows, ["review_id", "focus_id"], ["identity"], "outcome", ["target_id"], CHECKS).drop("identity_place")


def truncations(selections: DataFrame) -> DataFrame:
    """A diagnostic for each focus whose canonical anchors don't all fit, with how many there are and how many stay."""
    folded = selections.where("canonical").groupBy("review_id", "focus_id").agg(F.count("*").alias("n_canonical"), F.count_if("selected").alias("n_selected"))
    return folded.where("n_selected < n_canonical").withColumn("slot", F.lit("changed_anchor")).withColumn("state", F.lit("budget_truncated"))


def review(read: DataFrame) -> Review:
    """All tables of the reviews in read (of packets.read_packets())."""
    read = kept(read)
    parsed = kept(extraction.parsed(packets.records(read)))
    stated = kept(extraction.requirements(parsed).unionByName(extraction.other_statements(parsed)))
    files = packets.changed_files(read)
    lines = diffs.patch_lines(files.where("patch is not null").withColumn("path", F.coalesce("head_path", "base_path")), ["review_id", "base_path", "head_path", "path"])
    relations = diffs.change_relations(lines, ["review_id", "base_path", "head_path", "path"]).withColumn("hunk_id", diffs.hunk_id(F.coalesce("base_path", "head_path"), F.col("head_path"), F.col("hunk")))
    relations = kept(relations)
    found = kept(facts.change_facts(relations, ["review_id"]).unionByName(facts.file_facts(files, relations, ["review_id"])))
    given = read.where("refusal is null").select("review_id", F.explode("requirements").alias("r")).select("review_id", F.col("r.id").alias("statement_id"), "r.text", F.coalesce("r.kind", F.lit("deliverable")).alias("kind"))
    foci = stated.where("statement_id rlike '^[RG][0-9]+$'").select("review_id", "statement_id", "text", "kind")
    foci = foci.join(given.select("review_id").distinct(), "review_id", "left_anti").unionByName(given)
    claims = stated.where("role = 'claim' and statement_id rlike '^C[0-9]+$'")
    links = claim_links(foci, claims)
    bridges = kept(claim_bridges(links, claims, found))
    candidates = kept(anchor_candidates(foci.withColumnRenamed("statement_id", "focus_id"), found, bridges))
    selections = kept(select_anchors(candidates))
    claim_selections = kept(select_claims(links, claims))
    checks = kept(facts.check_facts(packets.observations(read), ["review_id"]))
    named = foci.select("review_id", F.col("statement_id").alias("focus_id"))
    check_selections = kept(select_checks(named, checks, read.where("refusal is null").select("review_id", "packet.head_sha")))
    slots = selections.select("review_id", "focus_id", "slot").union(claim_selections.select("review_id", "focus_id", "slot")).union(check_selections.select("review_id", "focus_id", "slot"))
    empty = structure.missing_slots(named, slots, SLOTS).select("review_id", "focus_id", F.lit(0).cast("long").alias("n_canonical"), F.lit(0).cast("long").alias("n_selected"), "slot", F.lit("no_association").alias("state"))
    transformed = extraction.transformation_claims(parsed)
    notes = packets.supplied(read)
    return Review(
        statements=stated,
        claims=transformed,
        predicates=extraction.predicates(transformed),
        relations=relations,
        facts=found,
        checks=checks,
        notes=facts.supplied_facts(notes, ["review_id"]),
        candidates=candidates,
        selections=selections,
        claim_selections=claim_selections,
        check_selections=check_selections,
        diagnostics=truncations(selections).unionByName(empty).unionByName(diffs.missing_patches(files, ["review_id"]).select("review_id", F.lit(None).cast("string").alias("focus_id"), F.lit(0).cast("long").alias("n_canonical"), F.lit(0).cast("long").alias("n_selected"), F.lit("changed_file").alias("slot"), F.col("code").alias("state"))),
    )

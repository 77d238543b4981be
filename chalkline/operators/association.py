"""Associations of authored texts with facts and with each other: joins over inverted token indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.lexical import distinctive_terms, each

#: Rows of a token index that may be broadcast.
INDEX_ROWS = 200_000
#: Words without distinction that are bits instead of rows of the index.
COMMON_TERMS = 62


def indexed(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= INDEX_ROWS else df


def _common_mask(tokens: Column, common: list[str]) -> Column:
    """A bit for each of common that tokens has."""
    if not common:
        return F.lit(0).cast("long")
    known = F.array(*map(F.lit, common))
    return F.aggregate(F.array_intersect(tokens, known), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position(known, x).cast("int") - 1)))


def text_association(foci: DataFrame, facts: DataFrame, focus_key: str, fact_key: str) -> DataFrame:
    """focus_key, fact_key, n_shared, n_distinctive and matched_terms (joined) of pairs that share two tokens, one of them distinctive.

    foci and facts have a key and tokens (sorted distinct). Tokens meet through an inverted index, so only pairs with a
    common token exist. The COMMON_TERMS commonest words that aren't distinctive make no pairs: they are bits of both
    sides, and what two sides share of them is counted there. Facts dealt by their key beforehand (facts.repartition(n,
    fact_key)) stay where they are: pairs are then counted without a shuffle of their own, as a fact's pairs are all with it.
    """
    index = each(foci, "tokens", "term", focus_key)
    telling = distinctive_terms(foci, [focus_key]).withColumn("telling", F.lit(1))
    index = index.join(telling, [focus_key, "term"], "left").select(focus_key, "term", F.coalesce("telling", F.lit(0)).alias("telling"))
    often = index.where("telling = 0").groupBy("term").count().orderBy(F.col("count").desc(), "term").limit(COMMON_TERMS)
    common = [r["term"] for r in often.collect()]
    masks = foci.select(F.col(focus_key).alias("_focus"), _common_mask(F.col("tokens"), common).alias("_wanted"))
    index = index.where(~F.col("term").isin(common)).join(masks, F.col(focus_key).eqNullSafe(F.col("_focus"))).drop("_focus")
    own = facts.select(fact_key, _common_mask(F.col("tokens"), common).alias("_own"), F.explode(F.filter("tokens", lambda x: ~x.isin(common))).alias("term"))
    pairs = own.join(indexed(index, index.count()), "term")
    counted = pairs.groupBy(focus_key, fact_key).agg(
        (F.count("*") + F.bit_count(F.max("_own").bitwiseAND(F.max("_wanted")))).alias("n_shared"),
        F.sum("telling").alias("n_distinctive"),
        F.array_sort(F.collect_list(F.when(F.col("telling") == 1, F.col("term")))).alias("terms"),
    )
    kept = counted.where("n_shared >= 2 and n_distinctive >= 1")
    return kept.select(focus_key, fact_key, "n_shared", "n_distinctive", F.array_join("terms", ",").alias("matched_terms"))


def identifier_association(foci: DataFrame, facts: DataFrame, focus_key: str, fact_key: str) -> DataFrame:
    """focus_key, fact_key and matched_terms of pairs that share an identifier key; both have identifiers (arrays)."""
    left = foci.select(focus_key, F.explode("identifiers").alias("term"))
    right = facts.select(fact_key, F.explode("identifiers").alias("term"))
    return left.join(right, "term").groupBy(focus_key, fact_key).agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("matched_terms"))


def association_reasons(foci: DataFrame, facts: DataFrame, focus_key: str, fact_key: str) -> DataFrame:
    """focus_key, fact_key, kind and matched_terms: an exact identifier wins over a distinctive phrase.

    Both tables have tokens and identifiers.
    """
    exact = identifier_association(foci, facts, focus_key, fact_key).withColumn("kind", F.lit("exact_identifier"))
    phrase = text_association(foci, facts, focus_key, fact_key).select(focus_key, fact_key, "matched_terms", F.lit("distinctive_phrase").alias("kind"))
    rest = phrase.join(exact.select(focus_key, fact_key), [focus_key, fact_key], "left_anti")
    return exact.unionByName(rest).select(focus_key, fact_key, "kind", "matched_terms")


def explicit_references(statements: DataFrame, key: str) -> DataFrame:
    """key and referenced id (R or G and a number) of authored statements (authority, text) that name requirements."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"\b([RG][0-9]+)\b"), F.lit(1))))
    return statements.where(F.col("authority").isin("pull_request", "provided")).select(key, found.alias("referenced"))


def phrase_cohort(pairs: DataFrame, focus_key: str, lane: str, discriminative: str) -> DataFrame:
    """pairs without generic matches in lanes of a focus where any match is discriminative."""
    best = pairs.groupBy(focus_key, lane).agg(F.max(F.col(discriminative).cast("int")).alias("any_discriminative"))
    return pairs.join(best, [focus_key, lane]).where((F.col("any_discriminative") == 0) | F.col(discriminative)).drop("any_discriminative")


def claim_bridges(focus_claims: DataFrame, claim_facts: DataFrame) -> DataFrame:
    """focus_id, fact_id and bridge_ids: facts that a claim of the focus is associated with.

    focus_claims: focus_id, claim_id; claim_facts: claim_id, fact_id.
    """
    joined = focus_claims.join(claim_facts, "claim_id")
    return joined.groupBy("focus_id", "fact_id").agg(F.array_sort(F.collect_set("claim_id")).alias("bridge_ids"))


def focus_anchors(provided: DataFrame, direct: DataFrame, bridged: DataFrame) -> DataFrame:
    """focus_id, fact_id, association and bridge_ids: provided over direct over bridged; a direct match keeps its bridges.

    provided: focus_id, fact_id; direct: focus_id, fact_id, kind; bridged: of claim_bridges().
    """
    keys = ["focus_id", "fact_id"]
    named = provided.select(*keys).distinct().withColumn("given", F.lit(True))
    joined = named.join(direct.select(*keys, "kind"), keys, "full_outer").join(bridged, keys, "full_outer")
    kind = F.when(F.col("given"), "provided_association").when(F.col("kind").isNotNull(), F.col("kind")).otherwise("claim_bridge")
    return joined.select(*keys, kind.alias("association"), F.when(F.col("given"), F.array().cast("array<string>")).otherwise(F.coalesce("bridge_ids", F.array().cast("array<string>"))).alias("bridge_ids"))

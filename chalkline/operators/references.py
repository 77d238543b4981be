"""Reference labels and observations of a frozen structural packet: the empty template to label, and what doesn't fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("changed", "retained_bridge", "retained_context")
#: The lists of a focus whose members the packet must know, by what they list.
LISTS = {
    "focus_file": ("direct_file_node_ids", "suggested_file_node_ids", "context_file_node_ids", "unresolved_file_node_ids"),
    "focus_node": ("direct_node_ids", "suggested_node_ids", "context_node_ids", "unresolved_node_ids"),
    "relation": ("relation_ids",),
    "exact_relation": ("exact_relation_ids",),
}


def _ids(values, *kinds: str):
    """A struct of kind and id for each of values and kinds; null arrays count as empty."""

    def of(kind: str):  # a second parameter of the lambda would be the element's place
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("id")))

    each = [of(kind) for kind in kinds]
    return F.coalesce(F.concat(*each), F.array().cast("array<struct<kind:string,id:string>>"))


def label_template(packets: DataFrame, proposed_by: str = "unassigned") -> DataFrame:
    """digest, files, focuses and authority of labels that leave everything of a packet (digest, candidates, subjects) unresolved."""
    return packets.select(
        F.col("digest").alias("packet_digest"),
        F.transform("candidates", lambda c: F.struct(c["file_node_id"].alias("file_node_id"), F.lit("unresolved").alias("disposition"), F.lit(None).cast("string").alias("role"))).alias("files"),
        F.transform("subjects", lambda s: F.struct(s["subject_id"].alias("subject_id"), F.lit(True).alias("unresolved"))).alias("focuses"),
        F.struct(F.lit("proposed").alias("status"), F.lit(proposed_by).alias("proposed_by")).alias("authority"),
    )


def known_ids(packets: DataFrame) -> DataFrame:
    """packet_digest, kind and id of all that observations of packets may name."""
    parts = [
        _ids(F.col("candidates.file_node_id"), "file", "focus_file", "focus_node"),
        _ids(F.col("symbols.node_id"), "focus_node"),
        _ids(F.col("relation_ids"), "relation"),
        _ids(F.col("relations.relation_id"), "exact_relation"),
        _ids(F.col("subjects.subject_id"), "subject"),
    ]
    return packets.select(F.col("digest").alias("packet_digest"), F.inline(F.concat(*parts))).distinct()


def observation_faults(observations: DataFrame, packets: DataFrame) -> DataFrame:
    """packet_digest, subject_id (null for files), id and fault of observations that don't belong to their packet.

    Faults: unknown packet; unknown, repeated or missing members by kind; a file's role; a node in several lists of a focus.
    Observations are told apart by their packet's digest. Equi-joins on digest, kind and id; a packet has no rows apart.
    """
    key = ["packet_digest", "kind", "id"]
    focus = observations.select("packet_digest", F.explode("focuses").alias("f"))
    files = observations.select("packet_digest", F.explode("files").alias("x")).select("packet_digest", F.lit(None).cast("string").alias("subject_id"), F.lit("file").alias("kind"), F.col("x.file_node_id").alias("id"), F.lit("files").alias("list"), F.col("x.role").alias("role"))
    none = F.lit(None).cast("string").alias("role")
    subjects = focus.select("packet_digest", F.col("f.subject_id").alias("subject_id"), F.lit("subject").alias("kind"), F.col("f.subject_id").alias("id"), F.lit("focuses").alias("list"), none)
    lists = F.array(*[F.struct(F.lit(name).alias("list"), _ids(F.col(f"f.{name}"), kind).alias("members")) for kind, names in LISTS.items() for name in names])
    listed = focus.select("packet_digest", F.col("f.subject_id").alias("subject_id"), F.inline(lists)).select("packet_digest", "subject_id", "list", F.inline("members")).withColumn("role", none)
    told = files.unionByName(subjects).unionByName(listed)
    known = known_ids(packets)
    bound = told.join(packets.select(F.col("digest").alias("packet_digest")).distinct(), "packet_digest", "left_semi")
    row = lambda df, fault: df.select("packet_digest", "subject_id", "id", fault.alias("fault"))
    without = F.lit(None).cast("string")
    counted = bound.groupBy("packet_digest", "subject_id", "kind", "id").agg(F.count("*").alias("times"), F.count_distinct("list").alias("lists"))
    faults = [
        observations.join(packets, F.col("packet_digest") == F.col("digest"), "left_anti").select("packet_digest", without.alias("subject_id"), without.alias("id"), F.lit("unknown packet").alias("fault")),
        row(bound.join(known, key, "left_anti"), F.concat(F.lit("unknown "), "kind")),
        row(known.where("kind = 'subject'").join(observations.select("packet_digest").distinct(), "packet_digest", "left_semi").join(subjects, key, "left_anti").withColumn("subject_id", F.col("id")), F.lit("missing subject")),
        row(counted.where("kind in ('file', 'subject') and times > 1"), F.concat(F.lit("repeated "), "kind")),
        row(counted.where("kind = 'focus_node' and lists > 1"), F.lit("node in several lists")),
        row(bound.where((F.col("kind") == "file") & ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))), F.lit("invalid role")),
    ]
    return reduce(DataFrame.unionByName, faults).distinct()

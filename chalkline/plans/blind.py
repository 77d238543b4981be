"""Blind packets: what people label of a review before they see what the engine made of it, and the engine's own observation of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators import graph, projection, rollups
from chalkline.operators.stages import kept
from chalkline.plans.projection import WholeReview
from chalkline.sources import packets
from chalkline.sources.artifacts import stored_digest
from chalkline.sources.stable import canonical_lines

HEADERS = 32
SUBJECTS = {"R": "requirement", "G": "guardrail"}
CHANGED = ("added", "removed", "modified", "renamed")


def _listed(df: DataFrame, name: str, *fields) -> DataFrame:
    """review_id and the sorted structs of its rows. A packet is one document of a review, so its rows meet in one row."""
    return df.groupBy("review_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(name))


def _named(whole: WholeReview) -> tuple[DataFrame, DataFrame]:
    """Files (review_id, file_node_id, path, operation) and other nodes (node_id, file_node_id, path, qualified_name, symbol_kind, operation) of reviews' graphs."""
    side = F.struct(F.when(F.col("side") == "head", 0).otherwise(1), "id")
    shown = whole.facts.symbols.groupBy("review_id", "node_id").agg(F.min_by(F.struct("qualified_name", "kind"), side).alias("s"))
    nodes = whole.projection.nodes.join(shown, ["review_id", "node_id"]).select("review_id", "node_id", "path", F.col("delta").alias("operation"), "s.qualified_name", F.coalesce("s.kind", F.lit("unknown")).alias("symbol_kind"))
    nodes = kept(nodes)
    files = nodes.where("symbol_kind = 'file' and path <> ''").select("review_id", F.col("node_id").alias("file_node_id"), "path", "operation")
    by_path = files.groupBy("review_id", "path").agg(F.max("file_node_id").alias("file_node_id"))
    return files, nodes.where("symbol_kind <> 'file'").join(by_path, ["review_id", "path"])


def structural_packets(read: DataFrame, whole: WholeReview, seeds: DataFrame) -> DataFrame:
    """digest and the fields of the format's packets, one a review whose graph was projected; refused reviews have none.

    read: of packets.read_packets(); seeds: review_id, state of the recorded traversals. A file's hunk headers are cut to
    32 within its own row, before anything is shuffled. The digest is that of the canonical JSON, whose lists are sorted, so
    it doesn't depend on the order or number of rows.
    """
    files, symbols = _named(whole)
    # members are all nodes of a file's path, other file nodes there too
    same = symbols.select("review_id", "path", "node_id").union(files.select("review_id", "path", "file_node_id"))
    inside = files.join(same, ["review_id", "path"], "left").groupBy("review_id", "file_node_id", "path", "operation").agg(F.array_sort(F.collect_set(F.when(F.col("node_id") != F.col("file_node_id"), F.col("node_id")))).alias("member_node_ids"))
    groups = whole.projection.groups.select("review_id", F.concat_ws(":", F.concat_ws(">", "lifted_source", "lifted_target"), "relation", "operation").alias("relation_id"), F.col("lifted_source").alias("source_node_id"), F.col("lifted_target").alias("target_node_id"), "relation", "operation")
    headers = F.slice(F.transform(F.filter(F.split(F.coalesce("patch", F.lit("")), r"\r\n|\r|\n"), lambda x: x.startswith("@@")), F.trim), 1, HEADERS)
    surfaces = packets.changed_files(read).select("review_id", F.struct("base_path", "head_path", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), headers.alias("hunk_headers")).alias("s"))
    text = whole.review.statements.select("review_id", F.col("statement_id").alias("subject_id"), "text")
    kind = F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])[F.substring("subject_id", 1, 1)]
    subjects = whole.projection.matrix.select("review_id", "subject_id").distinct().join(text, ["review_id", "subject_id"], "left").withColumn("subject_kind", kind)

    counts = rollups.coverage_counts(seeds, ["review_id"])
    state = F.when(F.coalesce("n_seeds", F.lit(0)) == 0, "unavailable").when(F.col("n_complete") == F.col("n_seeds"), "complete").otherwise("limited")
    own = read.where("refusal is null").select("review_id", "packet.repository", F.col("packet.pull_request").cast("long").alias("pull_request"), "packet.base_sha", "packet.head_sha")
    own = own.join(whole.projection.nodes.select("review_id").distinct(), "review_id", "left_semi").join(counts, "review_id", "left").withColumn("state", state)
    told = own.select(
        "review_id", F.lit("structural_correctness_packet.v3").alias("schema_version"), "repository", "pull_request", "base_sha", "head_sha",
        F.struct("state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_seeds", "n_complete", "n_truncated")]).alias("coverage"),
    )
    parts = [
        _listed(inside, "candidates", "file_node_id", "path", "operation", "member_node_ids"),
        _listed(symbols, "symbols", "node_id", "file_node_id", "path", "qualified_name", "symbol_kind", "operation"),
        _listed(groups, "relations", "relation_id", "source_node_id", "target_node_id", "relation", "operation"),
        _listed(surfaces, "changed_surfaces", "s.*"),
        _listed(subjects, "subjects", "subject_id", "subject_kind", F.col("text").alias("authored_statement")),
    ]
    for part in parts:
        name = part.columns[1]
        told = told.join(part, "review_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    told = told.withColumn("relation_ids", F.col("relations.relation_id"))
    return told.select(stored_digest(canonical_lines(told.drop("review_id"))).alias("digest"), "*")


def stale_packets(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """review_id, digest and now of frozen packets that their review's current packet isn't; now is null where there is none."""
    now = current.select("review_id", F.col("digest").alias("now"))
    return frozen.select("review_id", "digest").join(now, "review_id", "left").where("not digest <=> now")


def structural_observation(whole: WholeReview, frozen: DataFrame) -> DataFrame:
    """packet_digest, files and focuses that the engine itself makes of the reviews of packets (structural_packets()).

    Nodes of files that the recorded graph lacks are listed all the same; no packet knows them, which observation_faults() tells.
    """
    files, symbols = _named(whole)
    node_files = symbols.select("review_id", "node_id", "file_node_id").union(files.select("review_id", F.col("file_node_id").alias("node_id"), "file_node_id"))
    key = lambda c: F.concat_ws("\0", "review_id", c)
    deltas = whole.projection.nodes.select("review_id", "node_id", "delta")
    changed = deltas.where(F.col("delta").isin(*CHANGED)).join(node_files, ["review_id", "node_id"]).select(key("file_node_id").alias("file")).distinct()
    owners = node_files.select(key("node_id").alias("node"), key("file_node_id").alias("file"))
    edges = graph.file_rollup(whole.projection.edges.select(key("source").alias("source"), key("target").alias("target"), "relation"), owners)
    bridges = graph.retained_bridges(kept(edges.select(F.col("source_file").alias("source"), F.col("target_file").alias("target"))), kept(changed))
    bridges = bridges.select(F.split("file", "\0")[0].alias("review_id"), F.split("file", "\0")[1].alias("file"))
    roles = projection.overview_files(node_files.withColumnRenamed("file_node_id", "file"), deltas, bridges)
    role = F.when(F.col("role") == "changed", "changed").otherwise(F.concat(F.lit("retained_"), "role"))

    empty = F.array().cast("array<string>")
    own = whole.projection.observed
    lists = ("direct", "suggested", "context", "unresolved")
    # a file stands in the strongest list of its nodes
    placed = own.select("review_id", "focus_id", F.inline(F.concat(*[F.transform(F.col(c), _at(i)) for i, c in enumerate(lists)])))
    placed = placed.join(node_files, ["review_id", "node_id"]).groupBy("review_id", "focus_id", "file_node_id").agg(F.min("rank").alias("rank"))
    by_file = placed.groupBy("review_id", "focus_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("rank") == i, F.col("file_node_id")))).alias(f"{c}_file_node_ids") for i, c in enumerate(lists)])
    focus = whole.projection.dispositions.join(own, ["review_id", "focus_id"], "left").join(by_file, ["review_id", "focus_id"], "left")
    exact = F.coalesce("exact_relations", empty).alias("relation_ids"), F.coalesce("exact_relations", empty).alias("exact_relation_ids")
    focus = _listed(focus, "focuses", F.col("focus_id").alias("subject_id"), F.col("state").alias("disposition_state"), *[F.coalesce(f"{c}_file_node_ids", empty).alias(f"{c}_file_node_ids") for c in lists], *[F.coalesce(c, empty).alias(f"{c}_node_ids") for c in lists], *exact)
    seen = _listed(roles.select("review_id", F.col("file").alias("file_node_id"), role.alias("role")), "files", "file_node_id", "role")
    joined = frozen.select("review_id", F.col("digest").alias("packet_digest")).join(seen, "review_id", "left").join(focus, "review_id", "left")
    return joined.select("review_id", F.lit("structural_correctness_observation.v3").alias("schema_version"), "packet_digest", F.coalesce("files", F.array().cast(seen.schema["files"].dataType)).alias("files"), F.coalesce("focuses", F.array().cast(focus.schema["focuses"].dataType)).alias("focuses"))


def _at(rank: int):
    def placed(node: Column) -> Column:  # its own function, as a lambda of two parameters would take the place
        return F.struct(node.alias("node_id"), F.lit(rank).alias("rank"))

    return placed

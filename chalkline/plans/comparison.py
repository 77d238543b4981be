"""Comparisons for people: frozen requests against a run and human labels; a structural packet's labels against an observation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators import evaluation, references, runs, shadow


def shadow_refusals(packets: DataFrame, executions: DataFrame, labels: DataFrame) -> DataFrame:
    """source and fault of why a packet, a run and labels can't be compared; no rows if they can."""
    spelled = lambda df, source, *parts: df.select(F.lit(source).alias("source"), F.concat_ws(" ", *parts).alias("fault"))
    told = ("claim_id", "field", "stored", "derived")
    return (
        spelled(runs.admission_faults(packets), "packet", *told)
        .union(spelled(runs.run_faults(executions), "run", *told))
        .union(spelled(runs.packet_differences(packets, executions), "run against packet", F.col("ordinal").cast("string"), "field"))
        .union(spelled(runs.label_faults(labels, packets), "labels", "claim_id", "fault"))
    )


def _dispositions(df: DataFrame, answer: str) -> DataFrame:
    """claim_id, evidence_id, disposition, role and semantic_role of answers."""
    none = F.lit(None).cast("string")
    row = lambda i, name, role, meaning: F.struct(i.alias("evidence_id"), F.lit(name).alias("disposition"), role.alias("role"), meaning.alias("semantic_role"))
    rest = lambda name: F.transform(F.coalesce(f"{answer}.{name}_evidence_ids", F.array().cast("array<string>")), lambda i: row(i, name, none, none))
    picked = F.transform(f"{answer}.selections", lambda s: row(s["evidence_id"], "selected", s["role"], s["semantic_role"]))
    return df.where(f"{answer} is not null").select("claim_id", F.inline(F.concat(picked, rest("rejected"), rest("insufficient"))))


def shadow_tables(packets: DataFrame, executions: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """candidates, claims, metrics (all labelled claims, and accepted ones) and summary of inputs without refusals.

    A claim's candidates are at most 100; everything meets by claim and evidence.
    """
    seen = runs.observations(executions)
    asked = runs.admissions(packets)
    human, model = _dispositions(labels, "response"), _dispositions(seen.select("claim_id", F.col("run.selection").alias("selection")), "selection")
    mark = lambda df, name: df.select("claim_id", "evidence_id", *[F.col(c).alias(f"{name}_{c}") for c in ("disposition", "role", "semantic_role")])
    listed = asked.where("request is not null").select("claim_id", F.posexplode("request.candidates").alias("place", "c"), "deterministic_evidence_ids")
    listed = listed.select("claim_id", "place", "c.evidence_id", "c.summary", F.coalesce(F.array_contains("deterministic_evidence_ids", F.col("c.evidence_id")), F.lit(False)).alias("deterministic"))
    keys = ["claim_id", "evidence_id"]
    met = listed.join(mark(human, "human"), keys, "left").join(mark(model, "run"), keys, "left")
    own, picked = F.col("deterministic"), F.col("run_disposition") == "selected"
    group = F.when(F.col("run_disposition").isNull(), "not_observed").when(own & picked, "shared").when(own, "deterministic_only").when(picked, "shadow_only").otherwise("unselected")
    both = F.col("human_role").isNotNull() & F.col("run_role").isNotNull()
    same = (F.col("human_role") == F.col("run_role")) & (F.col("human_semantic_role") == F.col("run_semantic_role"))
    candidates = met.select(*keys, "place", "summary", "deterministic", F.coalesce("human_disposition", F.lit("not_observed")).alias("human"), F.coalesce("run_disposition", F.lit("not_observed")).alias("run"), group.alias("side"), F.when(~both, "not_applicable").when(same, "match").otherwise("mismatch").alias("roles"))

    said = seen.select("ordinal", "claim_id", "execution_state", F.col("run.selection").isNotNull().alias("answered"), F.col("run.selection.unresolved_surfaces").alias("run_unresolved"), F.concat(F.coalesce("diagnostics.code", F.array().cast("array<string>")), F.coalesce("run.diagnostics.code", F.array().cast("array<string>"))).alias("diagnostics"))
    claims = said.join(labels.select("claim_id", F.col("response.unresolved_surfaces").alias("human_unresolved")), "claim_id", "left")
    members = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    open_ = F.when(~F.col("answered"), "not_compared").when(members("human_unresolved") == members("run_unresolved"), "match").otherwise("mismatch")
    claims = claims.select("ordinal", "claim_id", "execution_state", open_.alias("unresolved"), "diagnostics")

    def metrics(scope: str, only: DataFrame) -> DataFrame:
        of = lambda df: df.join(only, "claim_id", "left_semi").withColumn("case_id", F.lit("comparison"))
        role = F.concat_ws(":", "role", "semantic_role").alias("role")
        rows = lambda df: of(df).select("case_id", *keys, "disposition", role)
        one = lambda df: of(df).select("case_id", *keys)
        return shadow.shadow_metrics(rows(human), rows(model), one(listed.where("deterministic"))).select(F.lit(scope).alias("scope"), "*")

    labelled = labels.select("claim_id")
    accepted = labelled.join(said.where("execution_state = 'accepted'"), "claim_id", "left_semi")
    return {
        "candidates": candidates,
        "claims": claims,
        "metrics": metrics("labelled", labelled).union(metrics("accepted", accepted)),
        "summary": executions.select("summary.*"),
    }


def structural_refusals(packets: DataFrame, observations: DataFrame, labels: DataFrame) -> DataFrame:
    """source and fault of why labels and an observation aren't of a packet (all as documents, packets with digest); no rows if they are."""
    told = references.observation_faults(observations, packets).select(F.lit("observation").alias("source"), F.concat_ws(" ", "subject_id", "id", "fault").alias("fault"))
    fault = lambda df, text: df.select(F.lit("labels").alias("source"), text.alias("fault"))
    told = told.union(fault(labels.join(packets, F.col("packet_digest") == F.col("digest"), "left_anti"), F.lit("unknown packet")))
    told = told.union(fault(labels.where("authority.status = 'verified' and authority.verification_method is null"), F.lit("verified without a method")))
    for what, listed, name, known in (("file", "files", "file_node_id", "candidates"), ("subject", "focuses", "subject_id", "subjects")):
        own = packets.select(F.col("digest").alias("packet_digest"), F.explode(f"{known}.{name}").alias("id"))
        off = evaluation.partition_faults(own, labels.select("packet_digest", F.explode(f"{listed}.{name}").alias("id")), "packet_digest", "id")
        told = told.union(fault(off, F.concat_ws(" ", "id", "fault", F.lit(what))))
    return told


def structural_tables(packets: DataFrame, observations: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """files, focuses and relations of a labelled packet against an observation of it, without refusals.

    A file is a match, a false inclusion or exclusion, of another role, or unresolved by its label. Focuses count shared and
    false members of each kind (file, node) and dimension (selected, direct, context), and disagreements of roles.
    """
    label, seen = labels.select(F.explode("files").alias("l")), observations.select(F.explode("files").alias("o"))
    path = packets.select(F.explode("candidates").alias("c")).select("c.file_node_id", "c.path")
    met = label.select("l.*").join(seen.select("o.file_node_id", F.col("o.role").alias("observed")), "file_node_id", "left").join(path, "file_node_id", "left")
    here = F.col("observed").isNotNull()
    state = (
        F.when(F.col("disposition") == "unresolved", "unresolved").when(~here & (F.col("disposition") == "included"), "false exclusion").when(here & (F.col("disposition") == "excluded"), "false inclusion")
        .when(here & ~F.col("observed").eqNullSafe(F.col("role")), "role disagreement").otherwise("match")
    )
    files = met.select("file_node_id", "path", "disposition", F.col("role").alias("expected"), "observed", state.alias("state"))

    def members(df: DataFrame, kind: str, lists: tuple[str, ...]) -> DataFrame:
        each = F.concat(*[F.transform(F.coalesce(f"f.{x}_{kind}_ids", F.array().cast("array<string>")), _marked(x)) for x in lists])
        return df.select(F.explode("focuses").alias("f")).select("f.subject_id", F.lit(kind).alias("kind"), F.inline(each))

    both = {}
    for name, df, lists in (("seen", observations, ("direct", "suggested", "context", "unresolved")), ("wanted", labels, ("direct", "context"))):
        both[name] = members(df, "file_node", lists).union(members(df, "node", lists))
    keys = ["subject_id", "kind"]
    rows = [evaluation.set_comparison(both["seen"], both["wanted"], keys, "id").withColumn("dimension", F.lit("selected"))]
    rows += [evaluation.set_comparison(both["seen"].where(F.col("list") == x), both["wanted"].where(F.col("list") == x), keys, "id").withColumn("dimension", F.lit(x)) for x in ("direct", "context")]
    only = lambda df: df.where("list in ('direct', 'context')")
    roles = evaluation.role_comparison(only(both["seen"]), both["wanted"], keys, "id", "list").select(*keys, "n_role_disagreements")
    exact = lambda df, field: df.select(F.explode("focuses").alias("f")).select("f.subject_id", F.explode(f"f.{field}").alias("id"))
    return {
        "files": files,
        "focuses": reduce(DataFrame.unionByName, rows).join(roles, keys, "left").na.fill(0, ["n_role_disagreements"]),
        "relations": evaluation.set_comparison(exact(observations, "exact_relation_ids"), exact(labels, "relation_ids"), ["subject_id"], "id"),
    }


def _marked(name: str):
    def marked(x: Column) -> Column:  # its own function, as a lambda of two parameters would take the place
        return F.struct(x.alias("id"), F.lit(name).alias("list"))

    return marked


#: How the tables of a comparison are sorted.
ORDER = {"candidates": ["claim_id", "place"], "claims": ["ordinal"], "metrics": ["scope"], "summary": ["state"], "files": ["file_node_id"], "focuses": ["subject_id", "kind", "dimension"], "relations": ["subject_id"]}

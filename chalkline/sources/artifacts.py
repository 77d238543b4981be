"""Stored artifacts: strict readers, evaluation suites, recorded graphs and scans, and byte-stable JSON writers."""

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources.strict import document_faults

SELECTION = "struct<schema_version:string,request_id:string,subject_id:string,selections:array<struct<evidence_id:string,role:string,semantic_role:string,rationale:string>>,rejected_evidence_ids:array<string>,insufficient_evidence_ids:array<string>,unresolved_surfaces:array<string>>"
LABELS = f"schema_version string, authority string, rubric_version string, labels array<struct<claim_id:string,response:{SELECTION}>>"
PATH = "struct<seed_symbol_id:string,classification:string,steps:array<struct<source_id:string,target_id:string,relation:string,direction:string>>>"
SYMBOL = "struct<id:string,kind:string,name:string,qualified_name:string,file_path:string,language:string,start_line:int,end_line:int>"
REVISION = (
    "struct<revision_side:string,hunk_count:int,index:struct<state:string,provider:string,revision_side:string,revision:string,database_path:string,indexed_files:int,requested_files:int,diagnostics:array<string>>,"
    f"symbols:array<{SYMBOL}>,overlaps:array<struct<hunk_id:string,symbol_id:string,changed_lines:array<int>>>,paths:array<{PATH}>,"
    "traversal_coverage:array<struct<seed_symbol_id:string,state:string,node_count:int,path_count:int,limiting_dimensions:array<string>>>>"
)
CASE = (
    "struct<id:string,fixture:string,expected_selections:array<struct<slot:string,focus_statement_id:string,target_id:string>>,"
    "expected_no_selections:array<struct<slot:string,focus_statement_id:string>>,expected_evidence:array<struct<evidence_id:string,classification:string,profile:string>>,"
    "expected_statements:array<struct<statement_id:string,role:string,purpose:string,authority:string>>,"
    "expected_assessments:array<struct<claim_id:string,predicate_id:string,expectation:string,status:string,reason_kinds:array<string>,supporting_evidence_ids:array<string>,contradicting_evidence_ids:array<string>>>,"
    "expected_focus_outcomes:array<struct<subject_id:string,disposition:string,graph_node_count:int,closure_fact_count:int,closure_revision_states:array<string>,closure_match_count:int>>,"
    f"structural_graph:struct<revisions:array<{REVISION}>>>"
)
SUITE = f"schema_version string, k int, thresholds map<string,double>, shadow_thresholds map<string,double>, cases array<{CASE}>"
STRUCTURE_LABELS = (
    "schema_version string, packet_digest string, files array<struct<file_node_id:string,disposition:string,role:string>>, "
    "focuses array<struct<subject_id:string,direct_file_node_ids:array<string>,context_file_node_ids:array<string>,direct_node_ids:array<string>,context_node_ids:array<string>,relation_ids:array<string>,equivalent_to:array<string>,unresolved:boolean>>, "
    "authority struct<status:string,proposed_by:string,verified_by:string,verification_method:string,verification_evidence:array<string>,system_under_test_isolated:boolean,proposal_digest:string>"
)

PACKETS = (
    "schema_version string, repository string, pull_request long, base_sha string, head_sha string, candidates array<struct<file_node_id:string,path:string,operation:string,member_node_ids:array<string>>>, "
    "symbols array<struct<node_id:string,file_node_id:string,path:string,qualified_name:string,symbol_kind:string,operation:string>>, "
    "relations array<struct<relation_id:string,source_node_id:string,target_node_id:string,relation:string,operation:string>>, "
    "changed_surfaces array<struct<base_path:string,head_path:string,status:string,additions:long,deletions:long,hunk_headers:array<string>>>, "
    "subjects array<struct<subject_id:string,subject_kind:string,authored_statement:string>>, relation_ids array<string>, coverage struct<state:string>, coverage_state string"
)
OBSERVATIONS = (
    "schema_version string, packet_digest string, files array<struct<file_node_id:string,role:string>>, focuses array<struct<subject_id:string,disposition_state:string,"
    + ",".join(f"{x}_{y}_ids:array<string>" for y in ("file_node", "node") for x in ("direct", "suggested", "context", "unresolved"))
    + ",relation_ids:array<string>,exact_relation_ids:array<string>>>"
)
CANDIDATE = (
    "struct<evidence_id:string,summary:string,kind:string,revision_side:string,operation:string,classification:string,profile:string,authority:string,path:string,line_start:int,line_end:int,"
    "symbol_kind:string,qualified_name:string,added_code:string,removed_code:string,structural_context:array<string>,admission_tier:string,association:string>"
)
REQUEST = f"struct<request_id:string,subject_id:string,subject_kind:string,authored_statement:string,candidates:array<{CANDIDATE}>,coverage_limits:array<string>,schema_version:string>"
NOTES = "array<struct<code:string,message:string>>"
COMPARISON = "struct<deterministic_ids:array<string>,shadow_ids:array<string>,shared_ids:array<string>,deterministic_only_ids:array<string>,shadow_only_ids:array<string>>"
POLICY = "struct<adapter_id:string,model_id:string,endpoint:string,timeout_seconds:double,max_output_tokens:int,api_profile:string,thinking_mode:string,reasoning_effort:string,thinking_budget:int,identity:string>"
RUN = (
    f"struct<request_id:string,subject_id:string,state:string,candidate_count:int,duration_ms:double,execution_policy:{POLICY},provider_id:string,model_id:string,"
    f"input_tokens:int,output_tokens:int,selection:{SELECTION},comparison:{COMPARISON},diagnostics:{NOTES}>"
)
OBSERVATION = f"struct<claim_id:string,admission_state:string,execution_state:string,eligible_count:int,deterministic_evidence_ids:array<string>,request:{REQUEST},run:{RUN},diagnostics:{NOTES}>"
ADMISSION = f"struct<claim_id:string,state:string,eligible_count:int,deterministic_evidence_ids:array<string>,request:{REQUEST},diagnostics:{NOTES}>"
SUMMARY = "struct<state:string,admitted_count:bigint,completed_count:bigint,failed_count:bigint,deferred_count:bigint,artifact_written:boolean>"
EXECUTIONS = f"schema_version string, summary {SUMMARY}, observations array<{OBSERVATION}>"
FROZEN = f"schema_version string, repository string, pull_request long, base_sha string, head_sha string, admissions array<{ADMISSION}>"


class ArtifactError(ValueError):
    """An artifact that isn't what it claims to be."""


def read_json(spark: SparkSession, path: str, schema: str, versions: tuple[str, ...], strict: bool = False) -> DataFrame:
    """file and the schema's columns of JSON documents at path; other versions, broken documents and, if strict, fields that the
    schema doesn't know or has as another type, at any depth, are refused. document_faults() gives all faults of all files as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    read = raw.withColumn("j", F.from_json("value", schema))
    if strict:
        told = document_faults(raw, schema, versions).select("file", F.concat_ws(" ", "path", "fault").alias("fault"))
    else:
        fault = F.when(F.json_object_keys("value").isNull(), "unreadable").when(~F.coalesce(F.col("j.schema_version").isin(*versions), F.lit(False)), F.concat(F.lit("version "), F.coalesce("j.schema_version", F.lit("none"))))
        told = read.select("file", fault.alias("fault")).where("fault is not null")
    faults = told.limit(3).collect()
    if faults:
        raise ArtifactError("; ".join(f"{r.file}: {r.fault}" for r in faults))
    return read.select("file", "j.*")


def suite_cases(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of evaluation suites, with the suite's k and thresholds."""
    read = read_json(spark, path, SUITE, ("evaluation_suite.v6",))
    return read.select("k", "thresholds", F.explode("cases").alias("case")).select("k", "thresholds", F.col("case.id").alias("case_id"), "case.*")


def golden_selections(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """case_id, query and target_id of what is expected; and all queries, those that expect nothing too."""
    query = F.concat_ws("|", "case_id", "s.slot", "s.focus_statement_id")
    gold = cases.select("case_id", F.explode("expected_selections").alias("s")).select("case_id", query.alias("query"), F.col("s.target_id").alias("target_id"))
    none = cases.select("case_id", F.explode("expected_no_selections").alias("s")).select("case_id", query.alias("query"))
    return gold, gold.select("case_id", "query").union(none).distinct()


def replayed_graph(cases: DataFrame) -> dict[str, DataFrame]:
    """symbols, overlaps, steps and coverage of recorded graphs, by case and revision side."""
    sides = cases.select("case_id", F.explode("structural_graph.revisions").alias("r"))
    part = lambda name: sides.select("case_id", F.col("r.revision_side").alias("side"), F.posexplode(f"r.{name}").alias("ordinal", "x")).select("case_id", "side", "ordinal", "x.*")
    return {"symbols": part("symbols"), "overlaps": part("overlaps"), "paths": part("paths"), "coverage": part("traversal_coverage")}


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """claim_id, evidence_id and disposition of human labels at path."""
    labels = read_json(spark, path, LABELS, ("llm_shadow_human_labels.v1",), strict=True).select(F.explode("labels").alias("l"))
    picked = labels.select("l.claim_id", F.explode("l.response.selections").alias("s")).select("claim_id", F.col("s.evidence_id").alias("evidence_id"), F.lit("selected").alias("disposition"), F.col("s.role").alias("role"))
    rest = lambda field, name: labels.select("l.claim_id", F.explode(f"l.response.{field}").alias("evidence_id"), F.lit(name).alias("disposition"), F.lit(None).cast("string").alias("role"))
    return picked.union(rest("rejected_evidence_ids", "rejected")).union(rest("insufficient_evidence_ids", "insufficient"))


def executions(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs of an outside selector as they claim to be; runs.run_faults() tells what doesn't derive from what they recorded."""
    return read_json(spark, path, EXECUTIONS, ("llm_shadow_execution.v5",), strict=True)


def frozen_requests(spark: SparkSession, path: str) -> DataFrame:
    """Packets of requests that were frozen before any run; runs.admission_faults() tells what is wrong with them."""
    return read_json(spark, path, FROZEN, ("llm_shadow_labeling_packet.v1",), strict=True)


def human_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, claim_id and response of people's labels; only human review is an authority."""
    read = read_json(spark, path, LABELS, ("llm_shadow_human_labels.v1",), strict=True)
    wrong = ~F.coalesce(F.col("authority") == "human_review", F.lit(False)) | (F.trim(F.coalesce("rubric_version", F.lit(""))) == "") | (F.coalesce(F.size("labels"), F.lit(0)) < 1)
    if not read.where(wrong).isEmpty():
        raise ArtifactError("labels are of human review, under a rubric, and at least one")
    return read.select("file", F.posexplode("labels").alias("ordinal", "l")).select("file", "ordinal", "l.claim_id", "l.response")


def structure_labels(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """Reference labels bound to a packet of that digest; focuses must be unique, and verified ones name how."""
    read = read_json(spark, path, STRUCTURE_LABELS, ("structural_correctness_labels.v2", "structural_correctness_labels.v3"))
    bad = read.where((F.col("packet_digest") != digest) | (F.size(F.array_distinct(F.transform("focuses", lambda f: f["subject_id"]))) != F.size("focuses")) | ((F.col("authority.status") == "verified") & F.col("authority.verification_method").isNull()))
    if not bad.isEmpty():
        raise ArtifactError("labels don't fit their packet")
    return read.select(F.explode("focuses").alias("f")).select("f.*")


def stored_digest(text: Column) -> Column:
    """The format's own digest of a stored document: SHA-256 of its sorted compact JSON with characters beyond ASCII escaped."""
    import pandas as pd

    def digest(value: str | None) -> str | None:
        return value and hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def digests(column: pd.Series) -> pd.Series:
        return column.map(digest)

    return F.pandas_udf(digests, "string")(text)


def structure_packets(spark: SparkSession, path: str) -> DataFrame:
    """Structural packets of both versions with their digests; the older one tells its coverage's state alone."""
    read = read_json(spark, path, PACKETS, ("structural_correctness_packet.v2", "structural_correctness_packet.v3"))
    older = F.col("schema_version") == "structural_correctness_packet.v2"
    state = F.when(older, F.col("coverage_state")).otherwise(F.col("coverage.state"))
    own = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), stored_digest(F.col("value")).alias("digest"))
    return read.withColumn("coverage_state", state).drop("coverage").join(own, "file")


def reference_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reference labels of structural packets as documents, of both versions; comparison.structural_refusals() tells what doesn't fit."""
    return read_json(spark, path, STRUCTURE_LABELS, ("structural_correctness_labels.v2", "structural_correctness_labels.v3"))


def structure_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of structural packets, of both versions."""
    return read_json(spark, path, OBSERVATIONS, ("structural_correctness_observation.v2", "structural_correctness_observation.v3"))


def verified_authority(proposal: dict, verified_by: str, method: str, evidence: list[str], isolated: bool) -> dict:
    """The authority of labels that someone other than their proposer has verified, bound to the proposal's digest."""
    if not verified_by or verified_by == proposal["authority"]["proposed_by"]:
        raise ArtifactError("labels are verified by someone else than who proposed them")
    digest = canonical_digest({k: v for k, v in proposal.items() if k != "authority"})
    return {**proposal["authority"], "status": "verified", "verified_by": verified_by, "verification_method": method, "verification_evidence": sorted(evidence), "system_under_test_isolated": isolated, "proposal_digest": digest}


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def canonical_digest(value) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def write_json(tables: dict[str, DataFrame], path: str, order: dict[str, list[str]], extra: dict | None = None) -> None:
    """One byte-stable document of report tables, which are small: rows in the given order, nothing about the time."""
    body = {name: [r.asDict(recursive=True) for r in df.orderBy(*order[name]).collect()] for name, df in tables.items()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(canonical_json({**(extra or {}), **body}))


def write_markdown(metrics: DataFrame, misses: DataFrame, path: str) -> None:
    """A report's metrics and missed gates for people."""
    row = metrics.first().asDict()
    lines = ["# Evaluation", "", "| metric | value |", "|-|-|", *[f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.items()], ""]
    failed = [f"- {r.metric}: {r.value:.4f} is {'above' if r.metric.startswith('max_') else 'below'} {r.threshold:.4f}" for r in misses.orderBy("metric").collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*lines, *(failed or ["All gates hold."])]) + "\n")


def coverage_line(counts: dict) -> str:
    """One line on how much of a graph was seen."""
    return f"graph: {counts['n_complete']}/{counts['n_seeds']} seeds complete, {counts['n_truncated']} truncated"

"""Commands over packets and suites. Exit codes: 0 well, 1 a gate is missed, 2 an input is refused."""

import argparse
import sys
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chalkline.operators import evaluation
from chalkline.operators.stages import kept
from chalkline.plans import comparison
from chalkline.plans.review import review
from chalkline.sources import artifacts, packets, stable

# The format's names of gates; max_ ones bound from above.
GATES = (
    "precision_at_k", "recall_at_k", "mean_reciprocal_rank", "no_match_accuracy", "max_no_candidate_rate", "max_false_positive_rate", "classification_accuracy",
    "statement_accuracy", "assessment_accuracy", "focus_accuracy",
)
#: What suites may expect that isn't compared here, and the gate that asks for it.
UNCOMPARED = {"expected_assessments": "assessment_accuracy", "expected_focus_outcomes": "focus_accuracy"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chalkline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("review", help="tables of all packets in a folder")
    one.add_argument("packets")
    one.add_argument("output", help="a folder for Parquet tables")
    two = commands.add_parser("evaluate", help="score selections of a suite's cases against its golden ones")
    two.add_argument("suite")
    two.add_argument("packets", help="the suite's fixtures; a case's fixture is the file of that name")
    two.add_argument("--json")
    two.add_argument("--markdown")
    three = commands.add_parser("compare-shadow", help="frozen requests against a stored run and people's labels")
    three.add_argument("--labeling-packet", required=True)
    three.add_argument("--execution", required=True)
    three.add_argument("--human-labels", required=True)
    three.add_argument("--output", required=True, help="a folder for tables of JSON lines")
    four = commands.add_parser("compare-structural-correctness", help="reference labels of a structural packet against an observation")
    four.add_argument("--labeling-packet", required=True)
    four.add_argument("--observation", required=True)
    four.add_argument("--reference-labels", "--human-labels", dest="reference_labels", required=True)
    four.add_argument("--output", required=True, help="a folder for tables of JSON lines")
    return out


def run_review(spark: SparkSession, source: str, output: str) -> int:
    read = packets.read_packets(spark, source)
    refused = read.where("refusal is not null").select("review_id", "refusal").collect()
    for r in refused:
        print(f"{r.review_id}: {r.refusal}", file=sys.stderr)
    for name, table in vars(review(read)).items():
        table.write.mode("overwrite").parquet(f"{output}/{name}")
    return 2 if refused else 0


def run_evaluate(spark: SparkSession, suite: str, source: str, json_path: str | None, markdown_path: str | None) -> int:
    try:
        cases = artifacts.suite_cases(spark, suite)
    except artifacts.ArtifactError as e:
        print(e, file=sys.stderr)
        return 2
    head = cases.select("k", "thresholds").first()
    expects = {c for c in UNCOMPARED if not cases.where(F.size(c) > 0).isEmpty()}
    unknown = sorted(set(head.thresholds or {}) - (set(GATES) - {UNCOMPARED[c] for c in expects}))
    if unknown:
        print(f"thresholds that nothing is computed for: {', '.join(unknown)}", file=sys.stderr)
        return 2
    read = packets.read_packets(spark, source)
    if not read.where("refusal is not null").isEmpty():
        return 2
    names = read.select("review_id", F.element_at(F.split("file", "/"), -1).alias("fixture_name"))
    own = cases.select("case_id", F.element_at(F.split("fixture", "/"), -1).alias("fixture_name")).join(names, "fixture_name")
    told = review(read)
    chosen = told.selections.where("selected").join(own, "review_id")
    chosen = chosen.withColumn("query", F.concat_ws("|", "case_id", "slot", "focus_id"))
    ranked = evaluation.ranked_candidates(chosen, ["query"], [F.col(c) for c in ("source_ordinal", "target_id", "association")])
    gold, queries = artifacts.golden_selections(cases)
    scores = evaluation.query_scores(ranked.select("query", "target_id", "place"), gold.select("query", "target_id"), queries.select("query"), "query", "target_id", "place", head.k)
    facts = told.facts.select("review_id", F.col("id").alias("evidence_id"), "classification", "profile").join(own.select("review_id", "case_id"), "review_id")
    stated = told.statements.select("review_id", "statement_id", "role", "purpose", "authority").join(own.select("review_id", "case_id"), "review_id")
    wanted = lambda c: cases.select("case_id", F.inline(F.coalesce(c, F.array().cast(cases.schema[c].dataType))))
    parts = [
        evaluation.absence_rates(scores),
        evaluation.matched_share(wanted("expected_evidence"), facts, ["case_id", "evidence_id"], ["classification", "profile"], "classification_accuracy"),
        evaluation.matched_share(wanted("expected_statements"), stated, ["case_id", "statement_id"], ["role", "purpose", "authority"], "statement_accuracy"),
    ]
    metrics = evaluation.retrieval_metrics(scores).withColumnRenamed("mrr", "mean_reciprocal_rank")
    for part in parts:
        metrics = metrics.crossJoin(F.broadcast(part))  # one row each
    for name in set(UNCOMPARED.values()) - {UNCOMPARED[c] for c in expects}:
        metrics = metrics.withColumn(name, F.lit(1.0))
    gates = dict(head.thresholds or {})
    misses = evaluation.missed_gates(metrics, gates) if gates else metrics.select(F.lit("").alias("metric"), F.lit(0.0).alias("value"), F.lit(0.0).alias("threshold")).where("false")
    if json_path:
        artifacts.write_json({"queries": scores, "metrics": metrics, "misses": misses}, json_path, {"queries": ["query"], "metrics": ["mean_reciprocal_rank"], "misses": ["metric"]})
    if markdown_path:
        artifacts.write_markdown(metrics, misses, markdown_path)
    return 0 if misses.isEmpty() else 1


def _written(tables: dict, output: str) -> int:
    for name, table in tables.items():
        print(f"{name}: {stable.write_table(table, f'{output}/{name}', comparison.ORDER[name])}")
    return 0


def _compare(readers: list, refusals, tables, output: str) -> int:
    """Reads documents, tells why they can't be compared (20 faults at most), or else writes the tables."""
    try:
        inputs = [kept(read(path)) for read, path in readers]
    except artifacts.ArtifactError as e:
        print(e, file=sys.stderr)
        return 2
    refused = refusals(*inputs).orderBy("source", "fault").limit(20).collect()
    for r in refused:
        print(f"{r.source}: {r.fault}", file=sys.stderr)
    return 2 if refused else _written(tables(*inputs), output)


def run_compare_shadow(spark: SparkSession, packet: str, execution: str, labels: str, output: str) -> int:
    readers = [(partial(read, spark), path) for read, path in ((artifacts.frozen_requests, packet), (artifacts.executions, execution), (artifacts.human_labels, labels))]
    return _compare(readers, comparison.shadow_refusals, comparison.shadow_tables, output)


def run_compare_structure(spark: SparkSession, packet: str, observation: str, labels: str, output: str) -> int:
    readers = [(partial(read, spark), path) for read, path in ((artifacts.structure_packets, packet), (artifacts.structure_observations, observation), (artifacts.reference_labels, labels))]
    return _compare(readers, comparison.structural_refusals, comparison.structural_tables, output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chalkline").getOrCreate()
    if args.command == "review":
        return run_review(spark, args.packets, args.output)
    if args.command == "compare-shadow":
        return run_compare_shadow(spark, args.labeling_packet, args.execution, args.human_labels, args.output)
    if args.command == "compare-structural-correctness":
        return run_compare_structure(spark, args.labeling_packet, args.observation, args.reference_labels, args.output)
    return run_evaluate(spark, args.suite, args.packets, args.json, args.markdown)


if __name__ == "__main__":
    sys.exit(main())

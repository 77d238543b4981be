"""Rules that no plan calls yet, by hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import assessment, convergence, extraction, graph, predicates, projection, rollups, scan, shadow, structure
from chalkline.sources import artifacts, diffs

C = F.col


def test_states_of_reviews(spark):
    rows = spark.createDataFrame([(True, True, "OPEN"), (False, True, "open"), (False, False, "Closed"), (False, False, None), (False, False, "odd")], "m boolean, d boolean, s string")
    assert [r.x for r in rows.select(rollups.pull_request_state(C("m"), C("d"), C("s")).alias("x")).collect()] == ["merged", "draft", "closed", "unknown", "unknown"]
    rows = spark.createDataFrame([("n", "context"), ("n", "matched"), ("o", "suggested")], "node string, membership string")
    assert {tuple(r) for r in rollups.strongest_membership(rows, ["node"], "membership").collect()} == {("n", "matched"), ("o", "suggested")}
    rows = spark.createDataFrame([(True, True), (True, False), (False, False)], "has boolean, whole boolean")
    assert [r.x for r in rows.select(assessment.selector_free_closure(C("has"), C("whole")).alias("x")).collect()] == ["unverified", "partial", "unverified"]


def test_orders_and_names(spark):
    rows = spark.createDataFrame([("claim", 2, "a", "z"), ("claim", 1, "b", "y"), ("anchor", 9, "c", "x")], "slot string, source_ordinal int, target_id string, association string")
    assert [r.target_id for r in rows.orderBy(*convergence.candidate_order()).collect()] == ["c", "b", "a"]
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, review_id int")
    assert {(r.id, r.kept) for r in graph.capped_relations(rows, ["review_id"], ["id"], 1).collect()} == {("a", True), ("b", False), ("c", True)}
    assert spark.range(1).select(structure.path_summary(F.array(F.lit("A.b"), F.lit("C"))).alias("x")).first().x == "A.b → C"
    names = spark.createDataFrame([(a,) for a in shadow.TIER_OF], "a string").select("a", shadow.association_tier(C("a")).alias("t"))
    assert {r.a: r.t for r in names.collect()} == dict(shadow.TIER_OF)
    files = spark.createDataFrame([("n", None, "added"), ("n", "o", "renamed"), ("n", None, "removed"), ("n", None, "modified")], "filename string, previous_filename string, status string")
    assert [(r.base_path, r.head_path) for r in diffs.added_removed_paths(files).collect()] == [(None, "n"), ("o", "n"), ("n", None), ("n", "n")]


def test_intent_is_the_introduction_or_the_title(spark):
    rows = spark.createDataFrame([("a", "intent", "pr_description", "Adds it."), ("b", "intent", "issue", "Not this.")], "review_id string, role string, origin string, text string")
    titles = spark.createDataFrame([("a", "Title a"), ("b", "Title b")], "review_id string, title string")
    assert {tuple(r) for r in extraction.intents(rows, titles).collect()} == {("a", "I1", "Adds it.", "pr_description"), ("b", "I1", "Title b", "pr_title")}


def test_counts_and_evidence_of_a_projection(spark):
    matrix = spark.createDataFrame([("r", "R1", "partial"), ("r", "R2", "partial"), ("r", "R3", "unverified")], "review_id string, subject_id string, status string")
    assert {(r.status, r.n) for r in projection.status_counts(matrix).collect()} == {("partial", 2), ("unverified", 1)}
    overlay = spark.createDataFrame([("r", "R1", "n"), ("r", "R1", "m"), ("r", "R2", "m")], "review_id string, focus_id string, node_id string")
    nodes = spark.createDataFrame([("r", "n", ["E2"]), ("r", "m", ["E1", "E2"])], "review_id string, node_id string, evidence_ids array<string>")
    assert {(r.focus_id, tuple(r.evidence_ids)) for r in projection.overlay_evidence(overlay, nodes).collect()} == {("R1", ("E1", "E2")), ("R2", ("E1", "E2"))}
    files = spark.createDataFrame([("a", 3, True), ("b", 4, False)], "path string, size int, within boolean")
    plans = spark.createDataFrame([("p",)], "plan_id string")
    assert [tuple(r) for r in scan.scan_coverage(plans, files, "plan_id").collect()] == [("p", 1, 3, "partial")]
    assert [r.state for r in scan.scan_coverage(plans, files.where("false"), "plan_id").collect()] == ["unavailable"]
    assert artifacts.coverage_line({"n_complete": 2, "n_seeds": 3, "n_truncated": 1}) == "graph: 2/3 seeds complete, 1 truncated"


def test_matches_of_covered_predicates(spark):
    """Symbol predicates count symbol names only, path predicates paths only; a side without a complete scan proves nothing."""
    own = spark.createDataFrame([("r", "T1", "p1", "symbol"), ("r", "T1", "p2", "repository_path")], "review_id string, claim_id string, predicate_id string, selector_kind string")
    scanned = spark.createDataFrame([("r", "CSP:T1", "s1", "p1", "transition"), ("r", "CSP:T1", "s2", "p2", "transition")], "review_id string, plan_id string, scan_id string, source_predicate_id string, expectation string")
    found = spark.createDataFrame([("r", "CSP:T1", "s1", "base", "symbol_names"), ("r", "CSP:T1", "s1", "base", "file_content"), ("r", "CSP:T1", "s2", "head", "paths"), ("r", "CSP:T1", "s2", "head", "symbol_names")], "review_id string, plan_id string, scan_id string, revision_side string, surface string")
    states = spark.createDataFrame([("r", "CSP:T1", "base", "complete"), ("r", "CSP:T1", "head", "partial")], "review_id string, plan_id string, revision_side string, state string")
    got = {r.predicate_id: (r.transition, r.base_complete, r.head_complete, r.base_matches, r.head_matches) for r in predicates.closure_matches(own, scanned, found, states).collect()}
    assert got == {"p1": (True, True, False, 1, 0), "p2": (True, True, False, 0, 1)}


def test_recorded_graphs_and_labels(spark, tmp_path):
    revision = {"revision_side": "head", "hunk_count": 1, "symbols": [{"id": "s", "kind": "function", "name": "f", "qualified_name": "m.f", "file_path": "a.py", "start_line": 1, "end_line": 2}], "overlaps": [], "paths": [], "traversal_coverage": [{"seed_symbol_id": "s", "state": "complete", "node_count": 1, "path_count": 0, "limiting_dimensions": []}]}
    case = {"id": "c", "fixture": "f.json", "expected_selections": [], "expected_no_selections": [], "structural_graph": {"revisions": [revision]}}
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "evaluation_suite.v6", "k": 5, "thresholds": {}, "cases": [case]}))
    graphs = artifacts.replayed_graph(artifacts.suite_cases(spark, str(tmp_path / "s.json")))
    assert [(r.case_id, r.side, r.ordinal, r.qualified_name) for r in graphs["symbols"].collect()] == [("c", "head", 0, "m.f")]
    assert [r.state for r in graphs["coverage"].collect()] == ["complete"] and graphs["paths"].isEmpty()
    labels = {"schema_version": "structural_correctness_labels.v3", "packet_digest": "d", "files": [], "focuses": [{"subject_id": "R1", "direct_node_ids": ["n"]}], "authority": {"status": "proposed", "proposed_by": "a"}}
    (tmp_path / "l.json").write_text(json.dumps(labels))
    assert [r.subject_id for r in artifacts.structure_labels(spark, str(tmp_path / "l.json"), "d").collect()] == ["R1"]
    with pytest.raises(artifacts.ArtifactError):
        artifacts.structure_labels(spark, str(tmp_path / "l.json"), "other")


def test_pairs_of_predicates_and_bindings_are_not_shuffled(spark):
    """Marks join the bindings before their pairs with predicates; before, each mark shuffled all pairs anew."""
    predicates_ = spark.createDataFrame([("r", "c", "p", "change", "symbol", "reference"), ("r", "c", "q", "change", "ordered_path", "reference"), ("r", "d", "p", "change", "symbol", "absent_head")], "review_id string, claim_id string, predicate_id string, claim_kind string, selector_kind string, expectation string")
    bound = spark.createDataFrame([("r", "c", "b1", "e1", "change", "exact_identifier"), ("r", "c", "b2", "e2", "verification", "distinctive_phrase"), ("r", "d", "b3", "e1", "closure", "x"), ("r", "d", "b4", "e2", "change", "structural_bridge"), ("r", "d", "b5", "e3", "change", None)], "review_id string, claim_id string, binding_id string, evidence_id string, evidence_role string, association string")
    some = "review_id string, claim_id string, predicate_id string, evidence_id string"
    subjects, hits = spark.createDataFrame([("r", "c", "p", "e1"), ("r", "c", "p", "e1")], some), spark.createDataFrame([("r", "c", "q", "e2"), ("r", "d", "q", "e3")], some)
    planned = spark.createDataFrame([("r", "d", "p"), ("r", "d", "p")], some.rpartition(",")[0])
    paths = spark.createDataFrame([("r", "c", "e1")], "review_id string, claim_id string, evidence_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = predicates.predicate_bindings(predicates_, bound, subjects, hits, planned, paths)
        got = sorted((r.claim_id, r.predicate_id, r.binding_id) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        above = plan.split("SortMergeJoin [review_id#", 1)[0]
        joins = plan[len(above) :].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("c", "p", "b1"), ("c", "q", "b1"), ("c", "q", "b2"), ("d", "p", "b3"), ("d", "p", "b4")]
    # the last join is that of claims, and nothing is shuffled above it
    assert joins.count(",") and "predicate_id" not in joins.split("Inner")[0] and "evidence_id" not in joins.split("Inner")[0] and "Exchange" not in above

"""Structural deltas, alignment, shadow selections, artifacts and commands on fixtures of our own."""

import json

import pytest
from pyspark.sql import functions as F

from chalkline import cli
from chalkline.functions.lexical import association_signature
from chalkline.operators import alignment, shadow, structure
from chalkline.sources import artifacts
from tests.test_review import BODY, changed, packet

SIG = "struct<identifiers:array<string>,tokens:array<string>>"


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_symbol_changes(spark):
    symbols = rows(
        spark, "review_id string, side string, file_path string, qualified_name string, kind string, change_relation_ids array<string>",
        ("r", "base", "a.py", "both", "function", ["c1"]), ("r", "head", "a.py", "both", "function", ["c1"]), ("r", "head", "new.py", "n", "function", []),
        ("r", "base", "old.py", "o", "class", []), ("r", "head", "a.py", "pure", "function", ["c2"]), ("r", "head", "a.py", "unknown", "function", ["c2"]), ("r", "head", "a.py", "mapped", "function", ["c3"]),
    )
    files = rows(spark, "review_id string, base_path string, head_path string, status string", ("r", "a.py", "a.py", "modified"), ("r", None, "new.py", "added"), ("r", "old.py", None, "removed"))
    coverage = rows(spark, "review_id string, side string, file_path string, qualified_name string, kind string", ("r", "base", "a.py", "pure", "function"))
    relations = rows(spark, "review_id string, relation_id string, kind string, added array<int>, removed array<int>", ("r", "c1", "replaced", [1], [1]), ("r", "c2", "added", [5], []), ("r", "c3", "replaced", [9], [8]))
    mapped = rows(spark, "review_id string, side string, relation_id string, line int", ("r", "base", "c3", 8))
    got = {r.qualified_name: r.operation for r in structure.symbol_changes(symbols, files, coverage, relations, mapped).collect()}
    assert got == {"both": "modified", "n": "added", "o": "removed", "pure": "added", "unknown": "unresolved", "mapped": "added"}


def test_relation_changes_never_infer_absence(spark):
    step = "array<struct<source:string,target:string,relation:string,direction:string>>"
    paths = rows(spark, f"review_id string, side string, seed string, steps {step}", ("r", "head", "s1", [("a", "b", "calls", "outgoing"), ("c", "b", "calls", "incoming")]), ("r", "base", "s1", [("a", "b", "calls", "outgoing")]), ("r", "head", "s2", [("x", "y", "calls", "outgoing")]), ("r", "base", "s3", [("p", "q", "calls", "outgoing")]))
    changed_ = rows(spark, "review_id string, node string, operation string", ("r", "y", "added"))
    seeds = rows(spark, "review_id string, side string, seed string, state string", ("r", "head", "s3", "complete"), ("r", "base", "s1", "truncated"))
    decided, undecided = structure.relation_changes(paths, changed_, seeds)
    assert {(r.source, r.target): r.operation for r in decided.collect()} == {("a", "b"): "retained", ("x", "y"): "added", ("p", "q"): "removed"}
    assert [r.n_undecided for r in undecided.collect()] == [1]


def test_ownership_changes(spark):
    own = rows(spark, "review_id string, side string, parent string, child string", ("r", "head", "m", "new"), ("r", "base", "m", "kept"), ("r", "head", "m", "kept"), ("r", "base", "m", "moved"))
    coverage = rows(spark, "review_id string, side string, state string", ("r", "head", "complete"), ("r", "base", "partial"))
    observed = rows(spark, "review_id string, side string, node string", ("r", "head", "moved"), ("r", "base", "new"))
    none = rows(spark, "review_id string, node string, operation string").where("false") if False else spark.createDataFrame([], "review_id string, node string, operation string")
    got = {r.child: r.operation for r in structure.ownership_changes(own, none, coverage, observed).collect()}
    assert got == {"new": None, "kept": "retained", "moved": "removed"}


def test_structural_candidates_and_reach(spark):
    anchors = rows(spark, "review_id string, focus_id string, anchor_id string, path_ids array<string>", ("r", "R1", "a1", ["p1", "p2"]), ("r", "R1", "a2", ["p1"]))
    paths = rows(spark, "review_id string, path_id string", ("r", "p1"), ("r", "p2"))
    symbols = rows(spark, "review_id string, symbol_id string, profile string, changed boolean, path_ids array<string>", ("r", "t", "test", False, ["p1"]), ("r", "c", "production", True, ["p1"]), ("r", "u", "production", False, ["p2"]), ("r", "d", "document", False, ["p2"]))
    found = structure.structural_candidates(anchors, paths, symbols)
    assert {(r.slot, r.target_id, tuple(r.bridge_ids)) for r in found.collect()} == {("structural_path", "p1", ("a1", "a2")), ("structural_path", "p2", ("a1",)), ("test_context", "t", ("p1",)), ("runtime_context", "u", ("p2",))}
    kept = structure.reachable(found, rows(spark, "review_id string, focus_id string, target_id string", ("r", "R1", "a2"), ("r", "R1", "p1")))
    assert {r.target_id for r in kept.collect()} == {"p1", "t"}
    foci = rows(spark, "review_id string, focus_id string", ("r", "R1"), ("r", "R2"))
    assert structure.missing_slots(foci, found, ("structural_path", "verification")).count() == 3
    checks = structure.check_candidates(foci, rows(spark, "review_id string, id string, head_sha string", ("r", "v1", "h"), ("r", "v2", "old")), rows(spark, "review_id string, head_sha string", ("r", "h")))
    assert {(r.focus_id, r.target_id) for r in checks.collect()} == {("R1", "v1"), ("R2", "v1")}


def test_subjects_and_bindings(spark):
    sign = lambda text: association_signature(F.lit(text))
    items = spark.range(1).select(F.lit("r").alias("review_id"), F.lit("e1").alias("id"), F.lit("src/app/ledger.py").alias("path"), F.lit("src/app/ledger.py").alias("base_path"), F.lit("src/app/ledger.py").alias("head_path"), sign("LegacyStore").alias("base_signature"), sign("LedgerTotals refund rows").alias("head_signature"), F.lit("change").alias("evidence_role"), F.lit("production").alias("profile"), F.lit("modified").alias("operation"))
    predicates = rows(spark, "review_id string, claim_id string, predicate_id string, selector_kind string, values array<string>, expectation string", ("r", "T1", "p1", "symbol", ["LedgerTotals"], "present_head"), ("r", "T2", "p2", "symbol", ["LedgerTotals"], "present_base"), ("r", "T3", "p3", "repository_path", ["src/app"], "absent_head"), ("r", "T2", "p4", "symbol", ["LegacyStore"], "absent_head"))
    found, lost = alignment.subjects(predicates, items)
    assert {(r.claim_id, r.predicate_id) for r in found.collect()} == {("T1", "p1"), ("T3", "p3"), ("T2", "p4")}
    assert [r.predicate_id for r in lost.collect()] == ["p2"]
    claims = rows(spark, "review_id string, claim_id string, kind string, text string", ("r", "T1", "change", "LedgerTotals are exact"), ("r", "T2", "change", "refund rows stay"), ("r", "T3", "uncertainty", "LedgerTotals maybe"))
    lexical = alignment.lexical_bindings(claims, items)
    assert {(r.claim_id, r.association) for r in lexical.collect()} == {("T1", "exact_identifier"), ("T2", "distinctive_phrase")}
    bound = alignment.bindings(found.where("false"), found, lexical)
    assert {(r.claim_id, r.origin) for r in bound.collect()} == {("T1", "subject"), ("T2", "subject"), ("T3", "subject")}
    assert alignment.unbound(claims, lexical, claims.where("claim_id = 'T9'")).collect()[0].state == "no_eligible_fact"
    closure = alignment.claim_closure(found, rows(spark, "review_id string, seed_id string, path_id string, depth int", ("r", "e1", "q2", 2), ("r", "e1", "q1", 1), ("r", "e1", "q9", 9)), limit=1)
    assert {(r.path_id, r.selected) for r in closure.where("claim_id = 'T1'").collect()} == {("q1", True), ("q2", False), ("q9", False)}


def test_bypasses(spark):
    paths = rows(spark, "review_id string, path_id string, nodes array<string>", ("r", "good", ["gate", "sink"]), ("r", "bad", ["other", "sink"]), ("r", "away", ["other", "end"]))
    bound = rows(spark, "review_id string, claim_id string, path_id string", ("r", "T1", "good"))
    authority = rows(spark, "review_id string, claim_id string, node string", ("r", "T1", "gate"))
    assert [r.path_id for r in alignment.bypasses(bound, paths, authority).collect()] == ["bad"]


def test_shadow_admission(spark):
    direct = rows(spark, "review_id string, claim_id string, evidence_id string, tier string", ("r", "T1", "e1", "identifier"), ("r", "T1", "e1", "baseline"), ("r", "T1", "e2", "phrase"))
    items = rows(spark, "review_id string, claim_id string, id string, kind string, ordinal int, change_relation_ids array<string>", ("r", "T1", "e1", "structural_change", 0, ["c1"]), ("r", "T1", "e3", "change_relation", 2, ["c1"]), ("r", "T1", "e4", "change_relation", 3, ["c9"]), ("r", "T2", "e3", "change_relation", 2, ["c1"]), ("r", "T2", "e5", "structural_change", 5, []))
    claims = rows(spark, "review_id string, claim_id string, kind string", ("r", "T1", "change"), ("r", "T2", "change"), ("r", "T3", "uncertainty"))
    found = shadow.candidate_identities(direct, items, claims, limit=2)
    assert {(r.claim_id, r.evidence_id): (r.tier, r.selected) for r in found.collect()} == {("T1", "e1"): ("baseline", True), ("T1", "e2"): ("phrase", True), ("T1", "e3"): ("same_hunk", False), ("T2", "e5"): ("fallback", True)}
    assert {r.claim_id: r.state for r in shadow.admissions(claims, found, 2).collect()} == {"T1": "ready_truncated", "T2": "ready", "T3": "empty"}
    runs = shadow.run_first(claims.withColumn("n", F.col("claim_id")), "n", 2)
    assert [r.execution for r in runs.orderBy("n").collect()] == ["requested", "requested", "deferred"]


def test_failures_of_a_selector_are_told(spark):
    def provider(row):
        if row["claim_id"] == "bad":
            raise ValueError("no answer")
        return {"picked": "x"}

    requests = rows(spark, "claim_id string", ("good",), ("bad",))
    got = {r.claim_id: (r.picked, r.error) for r in shadow.measured(requests, provider, "claim_id string, picked string, error string").collect()}
    assert got == {"good": ("x", None), "bad": (None, "ValueError: no answer")}


def test_shadow_metrics(spark):
    schema = "case_id string, claim_id string, evidence_id string, disposition string, role string"
    expected = rows(spark, schema, ("c", "T", "a", "selected", "x"), ("c", "T", "b", "selected", "x"), ("c", "T", "d", "rejected", None), ("c", "T", "e", "insufficient", None))
    observed = rows(spark, schema, ("c", "T", "a", "selected", "y"), ("c", "T", "b", "rejected", None), ("c", "T", "d", "selected", "x"), ("c", "T", "e", "insufficient", None))
    m = shadow.shadow_metrics(expected, observed, expected.where("evidence_id = 'a'")).first()
    assert (m.selection_precision, m.selection_recall, m.role_accuracy, m.disposition_accuracy, m.false_rejection_rate, m.insufficient_recall, m.baseline_retention) == (0.5, 0.5, 0.0, 0.5, 0.5, 1.0, 1.0)
    sides = shadow.compare_selections(rows(spark, "review_id string, claim_id string, evidence_id string, ordinal int", ("r", "T", "a", 0), ("r", "T", "b", 1)), rows(spark, "review_id string, claim_id string, evidence_id string", ("r", "T", "a")), rows(spark, "review_id string, claim_id string, evidence_id string", ("r", "T", "a"), ("r", "T", "b")))
    assert [(r.evidence_id, r.side) for r in sides.orderBy("ordinal").collect()] == [("a", "shared"), ("b", "shadow_only")]


def test_strict_readers(spark, tmp_path):
    label = {"claim_id": "T1", "response": {"selections": [{"evidence_id": "e", "role": "x", "semantic_role": "y", "rationale": "z"}], "rejected_evidence_ids": ["f"], "insufficient_evidence_ids": []}}
    good = {"schema_version": "llm_shadow_human_labels.v1", "authority": "h", "rubric_version": "1", "labels": [label]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "extra.json").write_text(json.dumps(good | {"surprise": 1}))
    (tmp_path / "old.json").write_text(json.dumps(good | {"schema_version": "v0"}))
    assert {(r.evidence_id, r.disposition) for r in artifacts.label_rows(spark, str(tmp_path / "good.json")).collect()} == {("e", "selected"), ("f", "rejected")}
    for name in ("extra", "old"):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.label_rows(spark, str(tmp_path / f"{name}.json"))


def test_verified_labels_need_another_person():
    proposal = {"files": [], "authority": {"status": "proposed", "proposed_by": "a"}}
    done = artifacts.verified_authority(proposal, "b", "reading", ["z", "y"], True)
    assert done["status"] == "verified" and done["verification_evidence"] == ["y", "z"] and done["proposal_digest"].startswith("sha256:")
    with pytest.raises(artifacts.ArtifactError):
        artifacts.verified_authority(proposal, "a", "reading", [], True)


@pytest.mark.parametrize("target, code", [("hit", 0), ("miss", 1)])
def test_evaluate_command(spark, tmp_path, target, code):
    import hashlib

    files = [changed("src/app/ledger.py", "@@ -1 +1,2 @@\n-total = 0\n+LedgerTotals = exact(total)\n+refund_rows = charge_rows")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(packet(1, BODY, None, files)))
    fact = "E:change_relation:" + hashlib.sha256(b"change_relation\0hunk:src/app/ledger.py:0:change:0:1,2").hexdigest()[:20]
    gold = [{"slot": "changed_anchor", "focus_statement_id": "R1", "target_id": fact if target == "hit" else "E:none"}]
    suite = {"schema_version": "evaluation_suite.v6", "k": 5, "thresholds": {"recall_at_k": 1.0}, "cases": [{"id": "c", "fixture": "x/one.json", "expected_selections": gold, "expected_no_selections": [{"slot": "changed_anchor", "focus_statement_id": "R9"}]}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    args = ["evaluate", str(tmp_path / "suite.json"), str(tmp_path / "in"), "--json", str(tmp_path / "a.json"), "--markdown", str(tmp_path / "a.md")]
    assert cli.main(args) == code
    first = (tmp_path / "a.json").read_bytes()
    if code:
        assert "recall_at_k" in (tmp_path / "a.md").read_text()
    else:
        assert cli.main(args) == code and (tmp_path / "a.json").read_bytes() == first
    (tmp_path / "suite.json").write_text(json.dumps(suite | {"schema_version": "v0"}))
    assert cli.main(args) == 2
    # all ten gates of the format by their names, as its own suites ask for them
    every = {"precision_at_k": 1.0, "recall_at_k": 1.0, "mean_reciprocal_rank": 0.8, "no_match_accuracy": 1.0, "max_no_candidate_rate": 0.0, "max_false_positive_rate": 0.0, "classification_accuracy": 1.0, "statement_accuracy": 1.0, "assessment_accuracy": 1.0, "focus_accuracy": 1.0}
    expected = {"expected_evidence": [{"evidence_id": fact, "classification": "code", "profile": "production"}], "expected_statements": [{"statement_id": "R1", "role": "obligation", "purpose": "acceptance", "authority": "pr_description"}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite | {"thresholds": every, "cases": [suite["cases"][0] | expected]}))
    assert cli.main(args) == code
    told = json.loads((tmp_path / "a.json").read_text())
    assert told["metrics"][0]["classification_accuracy"] == told["metrics"][0]["statement_accuracy"] == 1.0
    assert {m["metric"] for m in told["misses"]} == (set() if code == 0 else {"precision_at_k", "recall_at_k", "mean_reciprocal_rank"})
    wrong = {"expected_evidence": [{"evidence_id": fact, "classification": "code", "profile": "test"}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite | {"thresholds": {"classification_accuracy": 1.0, "max_false_positive_rate": 0.0}, "cases": [suite["cases"][0] | wrong]}))
    assert cli.main(args) == 1 and "classification_accuracy" in (tmp_path / "a.md").read_text()
    (tmp_path / "suite.json").write_text(json.dumps(suite | {"thresholds": every, "cases": [suite["cases"][0] | {"expected_focus_outcomes": [{"subject_id": "R1", "disposition": "projected"}]}]}))
    assert cli.main(args) == 2
    # a threshold that nothing is computed for is refused, not passed over
    (tmp_path / "suite.json").write_text(json.dumps(suite | {"thresholds": {"recall_at_k": 1.0, "other": 1.0}}))
    assert cli.main(args) == 2

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chalkline import cli
from chalkline.operators import evaluation, references, shadow
from chalkline.sources import artifacts

PACKET = {
    "schema_version": "structural_correctness_packet.v3",
    "repository": "o/r",
    "candidates": [{"file_node_id": "f1", "path": "a.py", "operation": "added", "member_node_ids": ["n1"]}, {"file_node_id": "f2", "path": "b.py", "operation": "modified"}],
    "symbols": [{"node_id": "n1", "file_node_id": "f1", "path": "a.py", "qualified_name": "a.x", "symbol_kind": "function", "operation": "added"}],
    "relations": [{"relation_id": "e1", "source_node_id": "n1", "target_node_id": "f2", "relation": "calls", "operation": "added"}],
    "subjects": [{"subject_id": "R1", "subject_kind": "requirement", "authored_statement": "s"}, {"subject_id": "R2", "subject_kind": "requirement", "authored_statement": "t"}],
    "relation_ids": ["e1", "o1"],
    "coverage": {"state": "complete"},
}


def focus(subject, **lists):
    return {"subject_id": subject, "disposition_state": "d", **lists}


def faults(spark, tmp_path, observation):
    (tmp_path / "packet.json").write_text(json.dumps(PACKET))
    (tmp_path / "seen.json").write_text(json.dumps({"schema_version": "structural_correctness_observation.v3", "packet_digest": "d", **observation}))
    packets = artifacts.structure_packets(spark, str(tmp_path / "packet.json")).withColumn("digest", F.lit("d"))
    found = references.observation_faults(artifacts.structure_observations(spark, str(tmp_path / "seen.json")), packets)
    return {(r.subject_id, r.id, r.fault) for r in found.collect()}


def test_observations_that_fit(spark, tmp_path):
    good = {"files": [{"file_node_id": "f1", "role": "changed"}], "focuses": [focus("R1", direct_node_ids=["n1", "f2"], relation_ids=["o1"], exact_relation_ids=["e1"]), focus("R2")]}
    assert faults(spark, tmp_path, good) == set()


def test_observations_that_do_not_fit(spark, tmp_path):
    bad = {
        "files": [{"file_node_id": "f1", "role": "odd"}, {"file_node_id": "f1", "role": "changed"}, {"file_node_id": "zz", "role": "changed"}],
        "focuses": [focus("R1", direct_file_node_ids=["n1"], direct_node_ids=["n1"], context_node_ids=["n1"], relation_ids=["q"], exact_relation_ids=["o1"]), focus("R9")],
    }
    assert faults(spark, tmp_path, bad) == {
        (None, "f1", "invalid role"), (None, "f1", "repeated file"), (None, "zz", "unknown file"), ("R1", "n1", "unknown focus_file"), ("R1", "n1", "node in several lists"),
        ("R1", "q", "unknown relation"), ("R1", "o1", "unknown exact_relation"), ("R9", "R9", "unknown subject"), ("R2", "R2", "missing subject"),
    }


def test_observation_of_another_packet(spark, tmp_path):
    assert faults(spark, tmp_path, {"packet_digest": "other", "files": [], "focuses": []}) == {(None, None, "unknown packet")}


def test_packets_of_both_versions_and_template(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps(PACKET))
    (tmp_path / "old.json").write_text(json.dumps({k: v for k, v in PACKET.items() if k != "coverage"} | {"schema_version": "structural_correctness_packet.v2", "coverage_state": "partial"}))
    read = artifacts.structure_packets(spark, str(tmp_path))
    assert {(r.schema_version[-2:], r.coverage_state) for r in read.collect()} == {("v2", "partial"), ("v3", "complete")}
    made = references.label_template(read.where("schema_version like '%v3'").withColumn("digest", F.lit("d"))).first()
    assert [(f.file_node_id, f.disposition, f.role) for f in made.files] == [("f1", "unresolved", None), ("f2", "unresolved", None)]
    assert [(f.subject_id, f.unresolved) for f in made.focuses] == [("R1", True), ("R2", True)] and made.authority.proposed_by == "unassigned"
    (tmp_path / "bad.json").write_text(json.dumps(PACKET | {"schema_version": "v1"}))
    with pytest.raises(artifacts.ArtifactError):
        artifacts.structure_packets(spark, str(tmp_path / "bad.json"))


def test_query_mismatches(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "q string, t string")
    found = evaluation.query_mismatches(rows(("a", "1"), ("a", "3"), ("b", "1"), ("c", "2")), rows(("a", "2"), ("a", "0"), ("a", "1"), ("b", "1")), ["q"], "t")
    assert {(r.q, tuple(r.missing), tuple(r.unexpected)) for r in found.collect()} == {("a", ("0", "2"), ("3",)), ("c", (), ("2",))}


def test_outcome_mismatches(spark):
    names = ("selected", "roles", "unresolved", "rejected", "insufficient")
    schema = "case_id string, claim_id string, labelled boolean, diagnostics_matched boolean, expected_state string, observed_state string, " + ", ".join(f"expected_{n} array<string>, observed_{n} array<string>" for n in names)
    same, other = [["x", "y"], ["y", "x", "x"]], [["x"], None]
    outcomes = spark.createDataFrame(
        [
            ("c", "fine", True, True, "done", "done", *same * 5),
            ("c", "all", True, False, "done", None, *other * 5),
            ("c", "unlabelled", None, None, "done", "done", *other * 5),
        ],
        schema,
    )
    got = {(r.claim_id, r.code) for r in shadow.outcome_mismatches(outcomes).collect()}
    assert got == {("all", f"shadow_{k}_mismatch") for k in ("state", "selection", "role", "unresolved", "disposition", "diagnostic")} | {("unlabelled", "shadow_diagnostic_mismatch")}


def test_compare_structure_command(spark, tmp_path, capsys):
    (tmp_path / "packet.json").write_text(json.dumps(PACKET, indent=1))
    digest = artifacts.structure_packets(spark, str(tmp_path / "packet.json")).first().digest
    assert digest == hashlib.sha256(json.dumps(PACKET, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    seen = {"schema_version": "structural_correctness_observation.v3", "packet_digest": digest, "files": [{"file_node_id": "f1", "role": "changed"}], "focuses": [focus("R1", direct_node_ids=["n1"], context_node_ids=["f2"], exact_relation_ids=["e1"], relation_ids=["e1"]), focus("R2")]}
    labels = {
        "schema_version": "structural_correctness_labels.v3", "packet_digest": digest, "authority": {"status": "proposed", "proposed_by": "p"},
        "files": [{"file_node_id": "f1", "disposition": "included", "role": "retained_context"}, {"file_node_id": "f2", "disposition": "included", "role": "changed"}],
        "focuses": [{"subject_id": "R1", "direct_node_ids": ["f2"], "context_node_ids": ["n1"], "relation_ids": []}, {"subject_id": "R2", "direct_node_ids": ["n1"], "relation_ids": ["e1"]}],
    }

    def run(labels, out):
        (tmp_path / "seen.json").write_text(json.dumps(seen))
        (tmp_path / "labels.json").write_text(json.dumps(labels))
        return cli.main(["compare-structural-correctness", "--labeling-packet", str(tmp_path / "packet.json"), "--observation", str(tmp_path / "seen.json"), "--human-labels", str(tmp_path / "labels.json"), "--output", str(tmp_path / out)])

    assert run(labels, "out") == 0
    rows = lambda name: [json.loads(x) for p in sorted((tmp_path / "out" / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r["path"], r["state"]) for r in rows("files")] == [("a.py", "role disagreement"), ("b.py", "false exclusion")]
    got = {(r["subject_id"], r["kind"], r["dimension"]): (r["n_shared"], r["n_false_in"], r["n_false_out"], r["n_role_disagreements"]) for r in rows("focuses")}
    assert got == {("R1", "node", "selected"): (2, 0, 0, 2), ("R1", "node", "direct"): (0, 1, 1, 2), ("R1", "node", "context"): (0, 1, 1, 2), ("R2", "node", "selected"): (0, 0, 1, 0), ("R2", "node", "direct"): (0, 0, 1, 0)}
    assert [(r["subject_id"], r["n_shared"], r["n_false_in"], r["n_false_out"]) for r in rows("relations")] == [("R1", 0, 1, 0), ("R2", 0, 0, 1)]
    assert run(labels | {"packet_digest": "other", "focuses": labels["focuses"][:1]}, "none") == 2
    assert "labels: unknown packet" in capsys.readouterr().err
    assert run(labels | {"focuses": labels["focuses"][:1]}, "none") == 2 and "labels: R2 missing subject" in capsys.readouterr().err

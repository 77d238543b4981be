"""Stored runs: derived fields computed again, frozen requests, labels, and the comparison for people."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from chalkline import cli
from chalkline.operators import runs
from chalkline.sources import artifacts, stable, strict

POLICY = {"adapter_id": "replay", "model_id": "m", "endpoint": "file", "timeout_seconds": 5.0, "max_output_tokens": 100}


def candidate(i):
    return {"evidence_id": i, "summary": f"about {i}", "kind": "change_relation"}


def request(claim, *ids):
    return {"request_id": f"q-{claim}", "subject_id": claim, "subject_kind": "transformation", "authored_statement": "Keeps it.", "candidates": [candidate(i) for i in ids], "coverage_limits": [], "schema_version": "2"}


def answer(claim, picked, rejected=(), insufficient=(), surfaces=()):
    return {
        "schema_version": "2", "request_id": f"q-{claim}", "subject_id": claim, "rejected_evidence_ids": list(rejected), "insufficient_evidence_ids": list(insufficient), "unresolved_surfaces": list(surfaces),
        "selections": [{"evidence_id": i, "role": "supporting", "semantic_role": "path", "rationale": "It says so."} for i in picked],
    }


def admission(claim, state, own=(), asked=None, eligible=None):
    return {"claim_id": claim, "state": state, "eligible_count": len(asked["candidates"]) if asked and eligible is None else eligible or 0, "deterministic_evidence_ids": list(own), "request": asked, "diagnostics": []}


FROZEN = {
    "schema_version": "llm_shadow_labeling_packet.v1", "repository": "o/r", "pull_request": 1, "base_sha": "b", "head_sha": "h",
    "admissions": [admission("T1", "ready", ["a", "c"], request("T1", "a", "b", "c")), admission("U1", "empty"), admission("T2", "ready", [], request("T2", "a")), admission("T3", "blocked", ["a"], None, 50), admission("T4", "ready_truncated", [], request("T4", "d"), 9)],
}
LABELS = {
    "schema_version": "llm_shadow_human_labels.v1", "authority": "human_review", "rubric_version": "1",
    "labels": [{"claim_id": "T1", "response": answer("T1", ["a", "b"], ["c"], surfaces=["x"])}, {"claim_id": "T2", "response": answer("T2", ["a"])}, {"claim_id": "T4", "response": answer("T4", [], [], ["d"])}],
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A run made from the frozen requests by recorded answers: one good, one invalid, one late."""
    folder = tmp_path_factory.mktemp("runs")
    (folder / "frozen.json").write_text(json.dumps(FROZEN))
    (folder / "labels.json").write_text(json.dumps(LABELS))
    frozen = artifacts.frozen_requests(spark, str(folder / "frozen.json"))
    given = [("T1", json.dumps(answer("T1", ["c", "a"], ["b"], surfaces=["x"]))), ("T2", json.dumps(answer("T2", ["zz"])))]
    responses = spark.createDataFrame(given, "claim_id string, j string").select("claim_id", F.from_json("j", artifacts.SELECTION).alias("response"), F.lit(None).cast("string").alias("error"), F.lit(1.5).alias("duration_ms"))
    responses = responses.select("*", F.from_json(F.lit(json.dumps(POLICY)), artifacts.POLICY).alias("execution_policy"), F.lit("replay").alias("provider_id"), F.lit("m").alias("model_id"), F.lit(3).alias("input_tokens"), F.lit(4).alias("output_tokens")).crossJoin(frozen.select("file"))
    claims = runs.executed(runs.admissions(frozen), responses, limit=2)
    stable.write_table(runs.run_documents(claims, frozen).drop("file"), str(folder / "run"), ["schema_version"])
    (part,) = [p for p in (folder / "run").glob("part-*") if p.stat().st_size]
    return folder, json.loads(part.read_text())


def faults_of(spark, tmp_path, run):
    (tmp_path / "run.json").write_text(json.dumps(run))
    return {(r.claim_id, r.field): (r.stored, r.derived) for r in runs.run_faults(artifacts.executions(spark, str(tmp_path / "run.json"))).collect()}


def test_a_run_from_frozen_requests(spark, stored, tmp_path):
    folder, run = stored
    assert [(o["claim_id"], o["execution_state"]) for o in run["observations"]] == [("T1", "accepted"), ("U1", "empty"), ("T2", "invalid_output"), ("T3", "blocked"), ("T4", "deferred")]
    assert run["summary"] == {"state": "partial", "admitted_count": 3, "completed_count": 1, "failed_count": 1, "deferred_count": 1, "artifact_written": True}
    one, bad = run["observations"][0]["run"], run["observations"][2]["run"]
    assert one["comparison"] == {"deterministic_ids": ["a", "c"], "shadow_ids": ["c", "a"], "shared_ids": ["a", "c"], "deterministic_only_ids": [], "shadow_only_ids": []}
    assert [d["code"] for d in bad["diagnostics"]] == ["incomplete_candidate_partition", "unknown_evidence_id"] and bad["selection"] is None
    assert run["observations"][4]["diagnostics"][0]["code"] == "shadow_execution_budget_deferred"
    assert faults_of(spark, tmp_path, run) == {}


def test_a_tampered_run_is_told_by_field(spark, stored, tmp_path):
    run = copy.deepcopy(stored[1])
    run["summary"]["completed_count"], run["summary"]["state"] = 2, "completed"
    run["observations"][0]["run"]["comparison"]["shared_ids"] = ["a"]
    run["observations"][0]["deterministic_evidence_ids"] = ["c", "a"]
    run["observations"][2]["run"]["candidate_count"] = 7
    run["observations"][3]["execution_state"] = "empty"
    run["observations"][4]["eligible_count"] = 0
    got = faults_of(spark, tmp_path, run)
    assert got.pop(("T1", "run.comparison.shared_ids")) == ('["a"]', '["a","c"]')
    assert got.pop((None, "summary.completed_count")) == ("2", "1") and got.pop((None, "summary.state")) == ("completed", "partial")
    assert set(got) == {("T1", "deterministic_evidence_ids"), ("T2", "run.candidate_count"), ("T3", "execution_state"), ("T4", "eligible_count")}


def test_runs_with_nothing(spark, tmp_path):
    run = {"schema_version": "llm_shadow_execution.v5", "summary": {"state": "unavailable", "admitted_count": 0, "completed_count": 0, "failed_count": 0, "deferred_count": 0}, "observations": []}
    assert faults_of(spark, tmp_path, run) == {}
    assert faults_of(spark, tmp_path, run | {"summary": run["summary"] | {"state": "empty"}}) == {}
    assert set(faults_of(spark, tmp_path, run | {"observations": [{"claim_id": "T1", "admission_state": "empty", "execution_state": "empty", "eligible_count": 0}]})) == {(None, "observations")}
    with pytest.raises(artifacts.ArtifactError, match=r"summary.state not a string"):
        faults_of(spark, tmp_path, run | {"summary": {"state": 3}})


def test_compare_shadow_command(spark, stored, tmp_path, capsys):
    folder, run = stored
    (tmp_path / "run.json").write_text(json.dumps(run))
    args = lambda out, labels="labels.json": ["compare-shadow", "--labeling-packet", str(folder / "frozen.json"), "--execution", str(tmp_path / "run.json"), "--human-labels", str(folder / labels), "--output", str(tmp_path / out)]
    assert cli.main(args("out")) == 0
    assert [line.split(":")[0] for line in capsys.readouterr().out.splitlines()] == ["candidates", "claims", "metrics", "summary"]
    lines = lambda name: [json.loads(x) for p in sorted((tmp_path / "out" / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert [(c["claim_id"], c["evidence_id"], c["human"], c["run"], c["side"], c["roles"]) for c in lines("candidates")] == [
        ("T1", "a", "selected", "selected", "shared", "match"), ("T1", "b", "selected", "rejected", "unselected", "not_applicable"), ("T1", "c", "rejected", "selected", "shared", "not_applicable"),
        ("T2", "a", "selected", "not_observed", "not_observed", "not_applicable"), ("T4", "d", "insufficient", "not_observed", "not_observed", "not_applicable"),
    ]
    assert [c["unresolved"] for c in lines("claims")] == ["match", "not_compared", "not_compared", "not_compared", "not_compared"]
    told = {m["scope"]: m for m in lines("metrics")}
    assert (told["labelled"]["n_labels"], told["labelled"]["selection_recall"], told["accepted"]["selection_recall"], told["accepted"]["selection_precision"]) == (5, 1 / 3, 0.5, 0.5)
    # labels must answer every request, and a run must keep what was frozen
    (folder / "few.json").write_text(json.dumps(LABELS | {"labels": LABELS["labels"][:2]}))
    assert cli.main(args("out2", "few.json")) == 2 and "T4 missing" in capsys.readouterr().err
    other = copy.deepcopy(run)
    other["observations"][4]["request"]["authored_statement"] = "Other."
    (tmp_path / "run.json").write_text(json.dumps(other))
    assert cli.main(args("out2")) == 2 and "run against packet: 4 request" in capsys.readouterr().err


def test_invalid_answers_by_code(spark):
    ask = json.dumps(request("T1", "a", "b"))
    good = answer("T1", ["a"], ["b"])
    cases = [
        (good, []), (answer("T1", ["a"], ["a", "b"]), ["overlapping_candidate_disposition"]), (answer("T1", ["a", "a"], ["b"]), ["duplicate_evidence_id"]), (answer("T1", ["a"]), ["incomplete_candidate_partition"]),
        (good | {"schema_version": "1", "request_id": "x", "subject_id": None}, ["request_mismatch", "schema_mismatch", "subject_mismatch"]), (good | {"unresolved_surfaces": [" "]}, ["invalid_unresolved_surface"]),
        (good | {"selections": None}, ["incomplete_candidate_partition", "invalid_selections"]), (good | {"unresolved_surfaces": ["x"] * 21}, ["unresolved_surface_budget_exceeded"]),
        (good | {"selections": [{"evidence_id": "a", "role": "odd", "semantic_role": None, "rationale": "r" * 2001}]}, ["invalid_evidence_role", "invalid_rationale", "invalid_semantic_role"]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(a), ask) for i, (a, _) in enumerate(cases)], "i int, a string, q string")
    rows = rows.select("i", F.from_json("a", artifacts.SELECTION).alias("a"), F.from_json("q", artifacts.REQUEST).alias("q"))
    assert [r.x for r in rows.select("i", runs.selection_faults(F.col("a"), F.col("q")).alias("x")).orderBy("i").collect()] == [codes for _, codes in cases]


def test_differences_meet_null_keys_and_repeats(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (None, "n", None), (4, "q", 1.0), (5, "r", 1.0), (5, "r", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.0), (None, "m", None), (6, "z", 0.0), (5, "r", 1.0)], "k int, s string, v double")
    assert {tuple(r) for r in runs.differences(a, b, ["k"]).collect()} == {(1, "v", "1.0", "1.5"), (None, "s", "n", "m"), (4, "*", "1", None), (6, "*", None, "1"), (5, "*", "2", "1")}
    assert runs.differences(a.where("false"), b.where("false"), ["k"]).isEmpty()


def test_faults_at_any_depth(spark):
    schema = "schema_version string, k int, t map<string,double>, xs array<struct<a:string,b:struct<c:boolean,d:array<string>>>>"
    docs = [
        ("ok", {"schema_version": "1", "k": 3, "t": {"x": 1, "y": 0.5}, "xs": [{"a": "q", "b": {"c": True, "d": ["x", None]}}, None]}), ("old", {"schema_version": "0"}), ("none", {}), ("list", [1]),
        ("bad", {"schema_version": "1", "k": 3.5, "t": {"x": "1"}, "zz": 1, "xs": [{"a": 1, "b": {"c": "True", "d": ["x", 3], "e": {}}}, 4]}),
    ]
    raw = spark.createDataFrame([(n, json.dumps(d)) for n, d in docs] + [("torn", '{"a":'), ("null", None), ("empty", "")], "file string, value string")
    got = {}
    for r in strict.document_faults(raw, schema, ("1",)).collect():
        got.setdefault(r.file, set()).add((r.path, r.fault))
    assert got.pop("bad") == {("zz", "unknown field"), ("k", "not a whole number"), ("t.x", "not a number"), ("xs[0].a", "not a string"), ("xs[0].b.e", "unknown field"), ("xs[0].b.c", "not a boolean"), ("xs[0].b.d[1]", "not a string"), ("xs[1]", "not an object")}
    assert got == {"old": {("schema_version", "version 0")}, "none": {("schema_version", "version none")}} | {n: {(None, "unreadable")} for n in ("list", "torn", "null", "empty")}


def test_digests_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"), F.struct(F.lit(None).cast("string").alias("z"), F.col("id").alias("a")).alias("s"), F.array(F.lit("é"), F.lit('"')).alias("l"))
    written = {}
    for n in (1, 50):
        path = tmp_path / str(n)
        root = stable.write_table(rows.repartition(n), str(path), ["k"])
        written[n] = root, b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))
    assert written[1] == written[50]
    assert written[1][1].splitlines()[0].decode() == '{"k":0,"l":["é","\\""],"s":{"a":0,"z":null}}'
    one = stable.digest_tree(stable.sorted_lines(rows, ["k"]), 10)
    two = stable.digest_tree(stable.sorted_lines(rows.withColumn("l", F.when(F.col("s.a") == 5, F.array(F.lit("x"))).otherwise(F.col("l"))), ["k"]), 10)
    assert [r["n"] for r in one.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()] == [100, 10, 1]
    assert one.exceptAll(two).count() == 3
    assert stable.write_table(rows.where("false"), str(tmp_path / "none"), ["k"]) is None


def test_levels_of_a_digest_tree(spark):
    """The SQL of table_digests has three levels, whatever the number of lines; the tree went on to its root."""
    lines = stable.sorted_lines(spark.range(20).select("id"), ["id"])
    told = {n: sorted(map(tuple, stable.digest_tree(lines, 2, n).collect())) for n in (None, 3, 9)}
    assert [level for level, *_ in told[None]].count(5) == 1 and told[9] == told[None]
    assert told[3] == [x for x in told[None] if x[0] <= 3]

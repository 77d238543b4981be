"""Reviews with recorded graphs, from packets to the projection, on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import references, stages
from chalkline.plans import blind, projection
from chalkline.sources import packets
from tests.test_review import BODY, changed, packet

STEPS = "array<struct<source:string,target:string,relation:string,direction:string>>"
A, B = "o/r#1", "o/r#2"


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    moved = {"base_path": "src/app/old.py", "head_path": "src/app/new.py", "status": "renamed", "additions": 1, "deletions": 1, "changes": 2, "source_url": "", "patch": "@@ -5 +5 @@\n-x = 1\n+x = 2"}
    files = [changed("src/app/ledger.py", "@@ -1 +1,2 @@\n-total = 0\n+LedgerTotals = exact(total)\n+refund_rows = charge_rows\n@@ -50 +51,2 @@\n context\n+loose = 1"), moved]
    for i, n in enumerate((1, 2)):
        (folder / f"{i}.json").write_text(json.dumps(packet(n, BODY, None, files)))
    return packets.read_packets(spark, str(folder))


@pytest.fixture(scope="module")
def whole(spark, read):
    rows = lambda schema, *data: spark.createDataFrame([(r, *d) for r in (A, B) for d in data], "review_id string, " + schema)
    ledger, store, test = "src/app/ledger.py", "src/app/store.py", "tests/test_ledger.py"
    symbols = rows(
        "side string, symbol_id string, file_path string, qualified_name string, kind string, profile string, start_line int, end_line int",
        ("base", "lf", ledger, ledger, "file", "production", 1, 99), ("base", "l1", ledger, "Ledger.total", "function", "production", 1, 3), ("base", "s1", store, "Store.rows", "function", "production", 1, 9),
        ("base", "o1", "src/app/old.py", "moved", "function", "production", 4, 6), ("head", "lf", ledger, ledger, "file", "production", 1, 99), ("head", "l1", ledger, "Ledger.total", "function", "production", 1, 3),
        ("head", "lc", ledger, "Ledger", "class", "production", 1, 20), ("head", "sf", store, store, "file", "production", 1, 50), ("head", "s1", store, "Store.rows", "function", "production", 1, 9),
        ("head", "t1", test, "test_total", "function", "test", 1, 9), ("head", "n1", "src/app/new.py", "moved", "function", "production", 4, 6),
    )
    paths = rows(
        f"side string, path_id string, seed string, steps {STEPS}",
        ("head", "p1", "l1", [("l1", "s1", "calls", "outgoing")]), ("head", "p2", "l1", [("l1", "t1", "calls", "incoming")]), ("base", "p1", "l1", [("l1", "s1", "calls", "outgoing")]),
    )
    owns = [(A, "base", "lf", "l1"), (A, "head", "lf", "lc"), (A, "head", "lc", "l1"), (A, "head", "sf", "s1"), (B, "head", "lc", "l1"), (B, "head", "l1", "lc")]
    ownership = spark.createDataFrame(owns, "review_id string, side string, parent string, child string")
    looked_up = rows("side string, file_path string, qualified_name string, kind string", ("base", ledger, "Ledger", "class"))
    seeds = rows("side string, seed string, state string", ("head", "l1", "complete"), ("base", "l1", "complete"))
    owned = rows("side string, state string", ("base", "complete"), ("head", "complete"))
    return projection.whole_review(read, projection.Graphs(symbols, paths, ownership, looked_up, seeds, owned))


@pytest.fixture(scope="module")
def names(whole):
    return {(r.review_id, r.node_id): r.qualified_name for r in whole.facts.symbols.collect()}


def test_structural_facts(whole, names):
    assert len({n for n in names if n[0] == A}) == 7  # a symbol of both revisions, a renamed file's too, is one node
    got = {names[A, r.node_id]: r.operation for r in whole.facts.changes.where(f"review_id = '{A}'").collect()}
    assert got == {"Ledger.total": "modified", "moved": "renamed"}
    got = {(names[A, r.source], r.relation, names[A, r.target]): r.operation for r in whole.facts.relations.where(f"review_id = '{A}'").collect()}
    assert got == {("Ledger.total", "calls", "Store.rows"): "retained", ("test_total", "calls", "Ledger.total"): "added"}
    got = {(names[A, r.parent], names[A, r.child]): r.operation for r in whole.facts.ownership.where(f"review_id = '{A}'").collect()}
    assert got == {("src/app/ledger.py", "Ledger.total"): "removed", ("src/app/ledger.py", "Ledger"): None, ("Ledger", "Ledger.total"): "added", ("src/app/store.py", "Store.rows"): "added"}
    assert {(r.side, r.path, r.line) for r in whole.facts.unmapped.where(f"review_id = '{A}'").collect()} == {("head", "src/app/ledger.py", 52)}


def test_projection(whole, names):
    shown = whole.projection
    assert [(r.review_id, r.reason, sorted(names[B, n] for n in r.nodes)) for r in shown.refused.collect()] == [(B, "placement_cycle", ["Ledger", "Ledger.total"])]
    for table in (shown.nodes, shown.edges, shown.overlays, shown.matrix, shown.dispositions):
        assert table.where(f"review_id = '{B}'").isEmpty()
    deltas = {names[A, r.node_id]: r.delta for r in shown.nodes.collect()}
    assert deltas == {"src/app/ledger.py": "retained", "Ledger.total": "modified", "Ledger": "unresolved", "Store.rows": "retained", "src/app/store.py": "unresolved", "test_total": "unresolved", "moved": "renamed"}
    chain = {names[A, r.node]: [names[A, n] for n in r.chain] for r in shown.chains.collect()}
    assert chain["Ledger.total"] == ["src/app/ledger.py", "Ledger", "Ledger.total"] and chain["Store.rows"] == ["src/app/store.py", "Store.rows"] and chain["moved"] == ["moved"]
    r1 = {names[A, r.node_id]: r.membership for r in shown.overlays.where("focus_id = 'R1'").collect()}
    assert r1 == {"Ledger.total": "matched", "Ledger": "context", "src/app/ledger.py": "context", "Store.rows": "context", "src/app/store.py": "context", "test_total": "context"}
    groups = {(names[A, r.lifted_source], r.relation, names[A, r.lifted_target]): (r.operation, r.n_edges) for r in shown.groups.collect()}
    assert groups == {("src/app/ledger.py", "calls", "src/app/store.py"): ("retained", 1), ("test_total", "calls", "src/app/ledger.py"): ("added", 1)}
    states = {r.focus_id: r.state for r in shown.dispositions.collect()}
    assert states["R1"] == "projected" and states["G1"] != "projected"
    matrix = {r.subject_id: (r.status, r.n_nodes) for r in shown.matrix.collect()}
    assert matrix["R1"] == ("unverified", 6) and set(matrix) == set(states)
    assert sum(r.n for r in shown.statuses.collect()) == len(matrix)
    assert {r.focus_id for r in shown.evidence.collect()} == {f for f, (_, n) in matrix.items() if n}
    observed = {r.focus_id: r for r in shown.observed.collect()}
    assert [names[A, n] for n in observed["R1"].direct] == ["Ledger.total"] and len(observed["R1"].exact_relations) == 2


def test_closure_and_tables(whole, names):
    got = {(r.kind, r.slot, names.get((A, r.id), r.id)) for r in whole.closure.where(f"review_id = '{A}' and focus_id = 'R1'").collect()}
    assert got == {("path", "structural_path", "head:p1"), ("path", "structural_path", "head:p2"), ("context", "runtime_context", "Store.rows"), ("context", "test_context", "test_total")} or ("path", "structural_path", "base:p1") in got
    tables = whole.tables()
    assert {"statements", "facts_changes", "projection_nodes", "closure", "claim_overlays"} <= set(tables)
    assert all(t.columns for t in tables.values())


@pytest.fixture(scope="module")
def frozen(spark, whole, read):
    seeds = spark.createDataFrame([(A, "complete"), (A, "truncated")], "review_id string, state string")
    return stages.kept(blind.structural_packets(read, whole, seeds))


def test_blind_packet(spark, whole, read, names, frozen):
    (p,) = frozen.collect()  # the refused review has none
    assert (p.review_id, p.repository, p.pull_request, p.coverage.state, p.coverage.n_seeds) == (A, "o/r", 1, "limited", 2)
    files = {names[A, c.file_node_id]: (c.operation, [names[A, n] for n in c.member_node_ids]) for c in p.candidates}
    assert files["src/app/store.py"] == ("unresolved", ["Store.rows"]) and set(files["src/app/ledger.py"][1]) == {"Ledger", "Ledger.total"} and set(files) == {"src/app/ledger.py", "src/app/store.py"}
    assert {s.qualified_name for s in p.symbols} == {"Ledger", "Ledger.total", "Store.rows"}
    assert {s.head_path: s.hunk_headers for s in p.changed_surfaces}["src/app/ledger.py"] == ["@@ -1 +1,2 @@", "@@ -50 +51,2 @@"]
    assert {s.subject_id: s.subject_kind for s in p.subjects}["R1"] == "requirement" and all(s.authored_statement for s in p.subjects)
    assert p.relation_ids == [r.relation_id for r in p.relations] and len(p.relations) == 2
    # the digest doesn't depend on how rows lie
    again = blind.structural_packets(read.repartition(3), whole, spark.createDataFrame([(A, "truncated"), (A, "complete")], "review_id string, state string"))
    assert [r.digest for r in again.collect()] == [p.digest] and len(p.digest) == 64
    other = blind.structural_packets(read, whole, spark.createDataFrame([(A, "complete")], "review_id string, state string"))
    assert [(r.digest, r.now != p.digest) for r in blind.stale_packets(frozen, other).collect()] == [(p.digest, True)] and blind.stale_packets(frozen, frozen).isEmpty()
    (t,) = references.label_template(frozen).collect()
    assert t.packet_digest == p.digest and len(t.files) == 2 and all(f.unresolved for f in t.focuses)


def test_hunk_headers_are_cut(spark, whole, read):
    many = read.withColumn("packet", read.packet.withField("changed_files", F.transform("packet.changed_files", lambda f: f.withField("patch", F.repeat(F.lit("@@ -1 +1 @@ f\n+x\r\n"), 40)))))
    (p,) = blind.structural_packets(many, whole, spark.createDataFrame([], "review_id string, state string")).collect()
    assert {len(s.hunk_headers) for s in p.changed_surfaces} == {32} and p.coverage.state == "unavailable"


def test_own_observation_fits_its_packet(spark, whole, names, frozen):
    seen = stages.kept(blind.structural_observation(whole, frozen))
    # the one node whose file the graph lacks is told, nothing else
    assert {(names[A, r.id], r.fault) for r in references.observation_faults(seen, frozen).collect()} == {("test_total", "unknown focus_node")}
    (o,) = seen.collect()
    assert {names[A, f.file_node_id]: f.role for f in o.files} == {"src/app/ledger.py": "changed", "src/app/store.py": "retained_context"}
    r1 = {f.subject_id: f for f in o.focuses}["R1"]
    assert [names[A, n] for n in r1.direct_file_node_ids] == ["src/app/ledger.py"] and [names[A, n] for n in r1.context_file_node_ids] == ["src/app/store.py"] and len(r1.exact_relation_ids) == 2

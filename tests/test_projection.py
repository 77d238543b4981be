"""Overlays, matrices, coverage labels and excerpts on small fixtures."""

from chalkline.operators import projection


def test_nodes_and_overlay(spark):
    make = lambda schema, *data: spark.createDataFrame(list(data), schema)
    symbols = make("review_id string, node_id string, id string, side string, path string", ("r", "a", "s1", "head", "src/app/a.py"), ("r", "a", "s0", "base", "src/app/a.py"), ("r", "b", "s2", "base", "src/app/b.py"), ("r", "c", "s3", "head", "docs/c.md"), ("r", "c", "s4", "base", "docs/c.md"))
    changes = make("review_id string, node_id string, id string, operation string, path string", ("r", "a", "ch", "modified", "src/app/a.py"))
    nodes = projection.graph_nodes(symbols, changes).cache()
    assert {r.node_id: (r.delta, r.display_id) for r in nodes.collect()} == {"a": ("modified", "ch"), "b": ("unresolved", "s2"), "c": ("retained", "s3")}
    anchors = make("review_id string, focus_id string, relation_id string, node_id string, association string", ("r", "R1", "p1", "a", "distinctive_phrase"), ("r", "R1", "p2", "a", "exact_identifier"))
    contexts = make("review_id string, focus_id string, relation_id string, node_id string, association string", ("r", "R1", "p3", "b", "structural_bridge"))
    paths = make("review_id string, focus_id string, relation_id string, node_ids array<string>", ("r", "R1", "p4", ["a", "b"]))
    owners = make("review_id string, node_id string, owner string", ("r", "a", "c"))
    overlay = projection.focus_overlay(anchors, contexts, paths, owners).cache()
    assert {r.node_id: (r.membership, r.sources) for r in overlay.collect()} == {"a": ("matched", ["anchor:p1", "anchor:p2", "path:p4"]), "b": ("context", ["context:p3", "path:p4"]), "c": ("context", ["owner:a"])}
    assert projection.strays(overlay, nodes).count() == 0
    assert {(r.domain, r.layer, tuple(r.node_ids)) for r in projection.components(nodes).collect()} == {("app", "unclassified", ("a", "b")), ("docs", "documentation", ("c",))}
    seen = projection.observed_focuses(overlay, make("review_id string, focus_id string, edge_id string", ("r", "R1", "e")), make("review_id string, edge_id string, group_id string", ("r", "e", "g"))).first()
    assert (seen.direct, seen.context, seen.exact_relations) == (["a"], ["b", "c"], ["g"])
    files = projection.overview_files(make("review_id string, node_id string, file string", ("r", "a", "f1"), ("r", "b", "f2"), ("r", "c", "f3")), nodes, make("review_id string, file string", ("r", "f2")))
    assert {r.file: r.role for r in files.collect()} == {"f1": "changed", "f2": "bridge", "f3": "context"}
    matrix = projection.verification_matrix(make("review_id string, subject_id string", ("r", "T1"), ("r", "T2")), make("review_id string, subject_id string, status string", ("r", "T1", "demonstrated")), make("review_id string, subject_id string, evidence_id string", ("r", "T1", "x"), ("r", "T1", "w")), overlay.withColumnRenamed("focus_id", "subject_id"))
    assert {r.subject_id: (r.status, r.evidence_ids) for r in matrix.collect()} == {"T1": ("demonstrated", ["w", "x"]), "T2": ("unverified", [])}
    assert projection.drift(overlay.select("focus_id", "node_id"), overlay.select("focus_id", "node_id").where("node_id <> 'c'")).collect()[0].only_in == "baseline"


def test_focus_coverage(spark):
    labels = spark.createDataFrame([("r", "1", True, ["x"], ["a"]), ("r", "2", False, [], []), ("r", "3", False, ["x"], ["z"]), ("r", "4", False, ["x"], ["a", "b"]), ("r", "5", False, ["x"], ["a"]), ("q", "6", False, ["x"], ["a"]), ("r", "7", False, ["x"], ["u"])], "review_id string, focus_id string, unresolved boolean, members array<string>, direct_nodes array<string>")
    seeds = spark.createDataFrame([("r", "a", "complete"), ("r", "b", "truncated"), ("r", "u", "unknown")], "review_id string, node_id string, state string")
    mapping = spark.createDataFrame([("r", "complete"), ("q", "partial")], "review_id string, state string")
    got = {r.focus_id: r.coverage for r in projection.focus_coverage(labels, seeds, mapping).collect()}
    assert got == {"1": "reference unresolved", "2": "not required for empty reference", "3": "unknown · no admitted direct seed", "4": "limited · admitted seed truncated", "5": "complete for admitted direct seeds", "6": "unknown · exact seed mapping unavailable", "7": "unknown · admitted seed state unavailable"}


def test_code_packet_equals_one_by_one(spark):
    rows = [("q", i, "a" * (7 * i % 30), "r" * (11 * i % 25)) for i in range(12)]
    got = {r.ordinal: (len(r.added_code), len(r.removed_code), r.truncated) for r in projection.code_packet(spark.createDataFrame(rows, "request_id string, ordinal int, added string, removed string"), 20, 100).collect()}
    left = 100
    for _, i, a, r in rows:
        budget = min(20, left)
        keep_a = min(len(a), budget - min(len(r), budget // 2))
        keep_r = min(len(r), budget - keep_a)
        left -= keep_a + keep_r
        assert got[i] == (keep_a, keep_r, (keep_a, keep_r) != (len(a), len(r)))


def test_one_owner_for_each_diagnostic(spark):
    rows = [("r", "1", "R1", "focus", "p", "s", "empty"), ("r", "2", "R2", "focus", "p", "s", "empty"), ("r", "3", "R1", "focus", "p", "s", "cut"), ("r", "4", None, "review", "p", "s", "stale"), ("r", "5", "R1", "focus", "p", "s", "not_applicable")]
    df = spark.createDataFrame(rows, "review_id string, id string, focus_id string, scope string, provider string, slot string, state string")
    assert {r.id: r.owner for r in projection.owned_diagnostics(df).collect()} == {"1": "review", "2": "review", "3": "focus:R1", "4": "review", "5": "hidden"}

"""Scalar rules and verdicts, row by row; stateful steps; the three vocabularies of check outcomes."""

import pytest
from pyspark.sql import functions as F

from chalkline.functions import focus, lexical, paths, selectors
from chalkline.operators import assessment, closure, convergence, delta, facts, graph, overlap, rollups, scan

C, L = F.col, F.lit


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def many(spark, schema, rows, column):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("x")).orderBy("i").collect()]


def test_lexical(spark):
    assert one(spark, "t string", ("The loadLedger_rows with ROW_cache into ab_cdef9",), lexical.semantic_tokens(C("t"))) == ["ab_cdef9", "cache", "cdef9", "loadledger", "loadledger_rows", "row_cache", "rows"]
    assert one(spark, "t string", ("loadLedger_rows x_12_abc plain A_b",), lexical.identifier_keys(C("t"))) == ["12abc", "loadledgerrows"]


def test_paths(spark):
    rows = {
        "src/app/views/list.py": ("code", "production", "app/views", "presentation"),
        "tests/test_x.py": ("test", "test", "tests", "verification"),
        "a/b_test.py": ("test", "test", "a", "unclassified"),
        "docs/x.RST": ("document", "document", "docs", "documentation"),
        ".github/workflows/ci.yml": ("code", "workflow", ".github", "automation"),
        "Poetry.lock": ("code", "dependency", "poetry.lock", "unclassified"),
        "conf/app.TOML": ("code", "configuration", "conf", "unclassified"),
        "db/migrations/1.sql": ("code", "schema", "db", "persistence"),
        "lib/vendor/x.js": ("code", "generated", "vendor", "unclassified"),
        "src\\tests\\x.py": ("test", "test", "src\\tests\\x.py", "unclassified"),
        "": ("code", "production", "unclassified", "unclassified"),
    }
    got = many(spark, "p string", [(p,) for p in rows], F.concat_ws("|", paths.path_classification(C("p")), paths.fact_profile(C("p")), paths.architectural_domain(C("p")), paths.architectural_layer(C("p"))))
    assert got == ["|".join(v) for v in rows.values()]


def test_requirement_profiles(spark):
    rows = [("guardrail", "x"), ("deliverable", "Document the api"), ("deliverable", "Tests must pass"), ("deliverable", "render a component"), ("deliverable", "config action"), ("deliverable", "schema for api"), ("deliverable", "versioned interface"), ("deliverable", "execute fast"), ("deliverable", "other")]
    tokens = lexical.semantic_tokens(C("t"))
    assert many(spark, "k string, t string", rows, focus.requirement_profile(C("k"), C("t"), tokens)) == ["guardrail", "documentation", "test_verification", "ui", "workflow_configuration", "schema_migration", "api_contract", "behavior", "generic"]


def test_change_operations(spark):
    names = "base head renamed added removed is_file looked pure_a pure_r mapped".split()
    rows = {"1110000000": "renamed", "1100000000": "modified", "0101000000": "added", "1000100000": "removed", "0100010000": "modified", "0100001100": "added", "1000001010": "removed", "0100000001": "added", "1000000001": "removed", "0100001000": "unresolved", "1000000000": "unresolved"}
    got = many(spark, ", ".join(f"{n} boolean" for n in names), [tuple(c == "1" for c in r) for r in rows], delta.change_operation(*[C(n) for n in names]))
    assert got == list(rows.values())


def test_relation_operations(spark):
    names = "base head a r pb ph".split()
    rows = {"110000": "retained", "011000": "added", "010010": "added", "010000": None, "100100": "removed", "100001": "removed", "101010": None}
    assert many(spark, ", ".join(f"{n} boolean" for n in names), [tuple(c == "1" for c in r) for r in rows], delta.relation_operation(*[C(n) for n in names])) == list(rows.values())


def test_narrowest_keeps_ties(spark):
    lines = spark.createDataFrame([("f", 70), ("f", 5), ("f", 500)], "g string, line int")
    spans = spark.createDataFrame([("f", "wide", 1, 400), ("f", "a", 60, 80), ("f", "b", 65, 85), ("h", "x", 1, 9)], "g string, span_id string, start_line int, end_line int")
    got = {(r.line, r.span_id) for r in overlap.narrowest_spans(lines, spans, "g").collect()}
    assert got == {(70, "a"), (70, "b"), (5, "wide")}
    assert [r.line for r in overlap.unmapped(lines, spans, "g").collect()] == [500]


def test_three_outcome_vocabularies(spark):
    conclusions = ["success", "neutral", "skipped", "failure", "error", "failed", "startup_failure", "pending", None]
    rows = [("completed", c) for c in conclusions]
    assert many(spark, "s string, c string", rows, convergence.check_outcome(C("s"), C("c"))) == ["success", "success", "success", "failure", "failure", "failure", "unknown", "pending", "unknown"]
    checks = spark.createDataFrame([(c or "none", "completed", c) for c in conclusions], "k string, status string, conclusion string")
    header = {r.k: r.state for r in rollups.ci_state(checks, ["k"], L(True)).collect()}
    assert header == {"success": "passing", "neutral": "passing", "skipped": "passing", "failure": "failure", "error": "failure", "failed": "failure", "startup_failure": "pending", "pending": "pending", "none": "pending"}
    verdict = {r.k: r.status for r in assessment.verification_status(checks, ["k"], L(True), L(True)).collect()}
    assert verdict == {"success": "demonstrated", "neutral": "partial", "skipped": "partial", "failure": "contradicted", "error": "partial", "failed": "partial", "startup_failure": "contradicted", "pending": "partial", "none": "partial"}


def test_unfinished_beside_success_passes(spark):
    checks = spark.createDataFrame([(1, "success"), (1, None), (2, None), (3, "success")], "k int, conclusion string")
    got = {r.k: r.state for r in rollups.ci_state(checks, ["k"], C("k") < 3).collect()}
    assert got == {1: "passing", 2: "pending", 3: "not_observed"}


def test_closure_status(spark):
    # transition, absent_head, base complete, head complete, base matches, head matches
    rows = [((True, False, True, True, 1, 0), "demonstrated"), ((True, False, True, True, 1, 2), "contradicted"), ((True, False, False, True, 0, 0), "partial"), ((True, False, True, True, 0, 0), "unverified"), ((False, True, False, True, 0, 0), "demonstrated"), ((False, True, False, True, 0, 1), "contradicted"), ((False, True, False, False, 0, 0), "partial")]
    expectation = F.when(C("a"), "absent_head").otherwise("reference")
    got = many(spark, "t boolean, a boolean, b boolean, h boolean, nb int, nh int", [r for r, _ in rows], assessment.closure_status(C("t"), expectation, C("b"), C("h"), C("nb"), C("nh")))
    assert got == [x for _, x in rows]
    assert many(spark, "s string", [("Old_Name",), ("a.b",), ("f()",)], assessment.spelled_by_symbols(C("s"))) == [True, False, False]


def test_claim_status_order(spark):
    schema = "kind string, preds boolean, rolled string, bound boolean, closure string, plan boolean, ver string, decisive boolean, exact boolean"
    rows = [
        (("uncertainty", True, "demonstrated", True, None, False, None, False, True), "unverified"),
        (("change", True, "partial", True, "x", False, None, False, True), "partial"),
        (("change", False, None, False, None, True, None, False, True), "unverified"),
        (("removal", False, None, True, "partial", True, None, False, False), "partial"),
        (("removal", False, None, True, None, True, "demonstrated", True, True), "partial"),
        (("completion_condition", False, None, True, None, False, "contradicted", False, False), "contradicted"),
        (("authority", False, None, True, None, False, "demonstrated", False, True), "partial"),
        (("change", False, None, True, None, False, None, False, True), "demonstrated"),
    ]
    assert many(spark, schema, [r for r, _ in rows], assessment.claim_status(*[C(c.split()[0]) for c in schema.split(", ")])) == [x for _, x in rows]


def test_supporting_less_contradicting(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], []), (1, ["c"], ["b"])], "c int, supporting array<string>, contradicting array<string>")
    r = assessment.supporting_evidence(rows, ["c"]).first()
    assert (r.supporting, r.contradicting) == (["a", "c"], ["b"])


def test_selectors(spark):
    assert one(spark, "v string", ("pkg.Ledger_rows()",), selectors.selector_keys(C("v"))) == ["ledger_rows", "ledgerrows"]
    matched = selectors.selector_matches(L("repository_path"), C("v"), F.array(L("src/app/x.py")), F.array().cast("array<string>"), L(False), L(None), L(""))
    assert many(spark, "v string", [("./src/app/",), ("src/ap",), ("src/app/x.py",)], matched) == [True, False, True]
    found = one(spark, "t string", ("No uses of legacyStore, and do not keep old exporter rows anymore or in src/old",), selectors.inferred_selectors(C("t")))
    assert [(x.kind, x.value) for x in found] == [("identifier", "legacyStore"), ("phrase", "old exporter rows anymore"), ("path", "src/old")]
    assert many(spark, "u string", [("https://a/b",), ("javascript:x",), ("/rel",)], selectors.safe_href(C("u"))) == ["https://a/b", None, None]
    kinds = [("removal", "change", "production", "removed"), ("removal", "change", "production", "added"), ("test_migration", "change", "test", "added"), ("uncertainty", "change", "test", "added"), ("authority", "verification", "x", "x"), ("change", None, "x", "x")]
    none = F.array().cast("array<string>")
    assert many(spark, "k string, r string, p string, o string", kinds, selectors.eligible_evidence(C("k"), C("r"), C("p"), C("o"), none, none)) == [True, False, True, False, False, False]


def test_bounded_code(spark):
    a, r = convergence.bounded_code(C("a"), C("r"), C("b"))
    rows = [("aaaa", "rrrr", 4), ("a", "rrrrrr", 4), ("aaaaaa", "r", 4), ("", "rrrr", 3), ("aaaa", "", 3), ("aa", "rr", 0), ("aa", "rr", 9)]
    assert many(spark, "a string, r string, b int", rows, F.concat_ws("/", a, r)) == ["aa/rr", "a/rrr", "aaa/r", "/rrr", "aaa/", "/", "aa/rr"]


def test_scan_matching(spark):
    rows = [("x OLD_Name()", "Old_Name", False), ("xOld_Name", "Old_Name", False), ("has OLD thing", "old THING", True), ("a.b c", "a.b", False), ("axb", "a.b", False)]
    assert many(spark, "t string, s string, p boolean", rows, scan.bounded_match(C("t"), C("s"), C("p"))) == [True, False, True, True, False]
    assert many(spark, "p string", [("src/a.py",), ("srcx/a.py",), ("lib/SRC/b",)], scan.within_scopes(C("p"), F.array(L("src"), L("nowhere")))) == [True, False, True]
    files = spark.createDataFrame([(i, "x" * i) for i in range(1, 50)], "id long, text string").withColumn("size", F.length("text"))
    kept = scan.read_until(files, "size", ["id"], max_bytes=100, bins=7).where("within").agg(F.max("id")).first()[0]
    assert kept == 13
    found = scan.line_matches(spark.createDataFrame([(1, "a\nuse Old.x\nsome Phrase here")], "id long, text string"), spark.createDataFrame([("s", "Old", False), ("p", "some phrase", True), ("n", "9.9", False)], "k string, value string, phrase boolean"), "id", "k")
    assert {(r.k, r.line) for r in found.collect()} == {("s", 2), ("p", 3)}


def test_traversal_by_review(spark):
    edges = spark.createDataFrame([("r", "s", "a", "calls", 1), ("r", "a", "b", "calls", 2), ("q", "s", "z", "calls", 1)], "review_id string, source string, target string, relation string, order int")
    seeds = spark.createDataFrame([("r", "s", 1), ("q", "s", 1)], "review_id string, seed string, order int")
    rows = graph.budgeted_paths(edges, seeds).collect()
    assert {(r.review_id, ">".join(r.nodes)) for r in rows if r.kind == "path"} == {("r", "s>a"), ("r", "s>a>b"), ("q", "s>z")}
    assert [r.detail for r in rows if r.kind == "state"] == [["complete"], ["complete"]]


def test_greedy_cover_reuses_chosen():
    meets = {"p": [(3, 0, "x", "long")], "q": [(1, 1, "x", "short"), (3, 0, "x", "long")], "r": [(1, 2, "x", "other")]}
    always = lambda goal: lambda: None
    assert closure.cover(["p", "q"], meets, 5, 5, always) == (["long"], [])
    assert closure.cover(["q", "p"], meets, 5, 5, always) == (["short", "long"], [])
    assert closure.cover(["q", "p", "r"], meets, 2, 5, always) == (["short", "long"], ["r"])
    assert closure.cover(["q"], meets, 5, 5, lambda goal: None) == ([], [])

def test_lifting_and_paths(spark):
    low, high = graph.lifted_endpoints(C("a"), C("b"))
    rows = [(["r", "f", "x"], ["r", "g", "y"]), (["r", "f", "x"], ["r", "f", "y"]), (["r", "f"], ["r", "f", "y"]), (["q"], ["r", "g"])]
    assert many(spark, "a array<string>, b array<string>", rows, F.concat_ws(">", low, high)) == ["f>g", "x>y", "f>y", "q>r"]
    steps = "steps array<struct<source:string,target:string,relation:string,direction:string>>"
    assert one(spark, steps, ([("a", "b", "calls", "outgoing"), ("b", "c", "calls", "incoming")],), graph.path_nodes(C("steps"))) == ["a", "b", "c"]
    row = ([("a", "b", "calls", "outgoing"), ("b", "c", "instantiates", "incoming")],)
    assert one(spark, steps, row, graph.executable_head_path(L("head"), L(True), C("steps"))) is True
    assert one(spark, steps, row, graph.executable_head_path(L("head"), L(True), C("steps"), outgoing=True)) is False
    assert one(spark, "n array<array<string>>, s array<array<string>>", ([["a"], ["b", "x"], ["c"]], [["x"], ["c", "d"]]), assessment.path_subsequence(C("n"), C("s"))) is True
    assert one(spark, "n array<string>", (["a", "b"],), assessment.authority_controls(C("n"), F.array(L("b")))) is False


def test_merge_facts(spark):
    rows = spark.createDataFrame([("k", 2, True, "added", None, "x"), ("k", 1, False, "removed", "first", "y"), ("k", 3, True, "removed", "third", "x"), ("m", 1, False, "added", None, "z")], "id string, n int, changed boolean, operation string, text string, source string")
    got = {r.id: r for r in facts.merge_facts(rows, ["id"], "n", ["text"], ["source"], operation="operation").collect()}
    assert (got["k"].changed, got["k"].operation, got["k"].text, got["k"].source) == (True, "replaced", "first", ["x", "y"])
    assert (got["m"].changed, got["m"].operation, got["m"].text) == (False, None, None)
    assert facts.kind_conflicts(rows, ["id"], "text").count() == 1


def test_retained_bridges_need_two_ends(spark):
    edges = spark.createDataFrame([("c1", "r1"), ("r1", "r2"), ("r2", "c2"), ("c1", "r3"), ("r3", "c1"), ("r4", "c2")], "source string, target string")
    changed = spark.createDataFrame([("c1",), ("c2",)], "file string")
    assert {r.file for r in graph.retained_bridges(edges, changed).collect()} == {"r1", "r2"}


def test_scan_plans(spark):
    rows = spark.createDataFrame([("G1", "guardrail", "reference"), ("T1", "removal", "absent_head"), ("CC1", "completion_condition", "verified_head"), ("CC2", "completion_condition", "absent_head"), ("T2", "change", "reference")], "statement_id string, kind string, expectation string")
    plans = scan.scan_plans(rows)
    assert sorted((r.statement_id, r.revision_side) for r in plans.collect()) == [("CC2", "head"), ("G1", "head"), ("T1", "base"), ("T1", "head")]
    assert {r.state for r in scan.unavailable_results(plans, "none").collect()} == {"unavailable"}


def test_scan_predicates(spark):
    schema = "claim_id string, predicate_id string, selector_kind string, values array<string>, role string, n int"
    rows = [("T1", "p1", "symbol", ["Old"], "target", 1), ("T1", "p2", "repository_path", ["src/app/"], "path_scope", 2), ("T1", "p3", "ordered_path", ["a", "b"], "target", 3), ("T1", "p4", "repository_path", ["x.py"], "target", 4), ("T1", "p1", "symbol", ["Old"], "target", 5)]
    authored = scan.authored_candidates(spark.createDataFrame(rows, schema))
    prose = scan.inferred_candidates(spark.createDataFrame([("G1", "Do not touch the exporter module, keep loadRows")], "statement_id string, text string"))
    got = {r.predicate_id: (r.kind, r.value, list(r.scopes), r.source_predicate_id) for r in scan.scan_predicates(authored.union(prose)).collect()}
    assert got["CSP:T1:predicate:1"] == ("identifier", "Old", ["src/app/"], "p1") and got["CSP:T1:predicate:2"] == ("path", "x.py", ["src/app/"], "p4")
    assert got["CSP:G1:predicate:2"] == ("identifier", "loadRows", [], None) and got["CSP:G1:predicate:1"][0] == "phrase" and len(got) == 4


def test_scan_surfaces(spark):
    files = spark.createDataFrame(
        [("r", "head", "src/old.py", "x = OldThing\nOldThing(oldthing)\n"), ("r", "head", "src/b.py", "nothing\0 OldThing"), ("r", "head", "lib/OldThing.py", "a OldThing b"), ("r", "head", "vendor/z.py", "OldThing"), ("r", "base", "src/old.py", "OldThing")],
        "review_id string, revision_side string, path string, text string",
    )
    keys = ["review_id", "revision_side"]
    seen = scan.scanned_paths(files, keys)
    assert "vendor/z.py" not in {r.path for r in seen.collect()}
    own = [("r", s, "CSP:T1", f"CSP:T1:predicate:{n}", n, kind, value, scopes, None) for s in ("base", "head") for n, kind, value, scopes in ((1, "identifier", "OldThing", ["src"]), (2, "path", "old.py", ["src"]), (3, "phrase", "b", []))]
    predicates = spark.createDataFrame(own, "review_id string, revision_side string, plan_id string, predicate_id string, number int, kind string, value string, scopes array<string>, source_predicate_id string")
    found, states = scan.surface_matches(seen, predicates, keys)
    got = [(r.predicate_id[-1], r.surface, r.path, r.line, r.excerpt, r.profile) for r in found.where("revision_side = 'head'").orderBy("place").collect()]
    assert got == [
        ("2", "paths", "src/old.py", None, "src/old.py", "production"),
        ("3", "file_content", "lib/OldThing.py", 1, "a OldThing b", "production"),
        ("1", "file_content", "src/old.py", 1, "x = OldThing", "production"),
        ("1", "symbol_names", "src/old.py", 1, "OldThing", "production"),
        ("1", "file_content", "src/old.py", 2, "OldThing(oldthing)", "production"),
        ("1", "symbol_names", "src/old.py", 2, "OldThing", "production"),
        ("1", "symbol_names", "src/old.py", 2, "oldthing", "production"),
    ]
    assert {(r.revision_side, r.n_files, r.n_matches, r.state) for r in states.collect()} == {("head", 2, 7, "complete"), ("base", 1, 3, "complete")}
    few, cut = scan.surface_matches(scan.scanned_paths(files, keys, 1), predicates, keys, max_bytes=5, max_matches=2)
    assert {r.state for r in cut.collect()} == {"partial"} and few.where("revision_side = 'head'").count() == 0
    assert {tuple(r) for r in scan.closure_evidence(states, ["base", "head"]).collect()} == {("CSP:T1", 10, "base: complete; head: complete")}


def test_scanned_texts_are_not_shuffled(spark):
    """The texts of a checkout met in one task before, to be ordered by path."""
    files = spark.range(100).select(F.lit("r").alias("review_id"), F.concat(F.lit("src/f"), F.col("id")).alias("path"), F.repeat(F.lit("x"), 50).alias("text"))
    seen = scan.scanned_paths(files, ["review_id"], 5)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert sorted((r.path, r.text, r.path_place, r.file_limited) for r in seen.collect()) == [(p, "x" * 50, i + 1, True) for i, p in enumerate(sorted(f"src/f{n}" for n in range(100))[:5])]


def test_scan_refusals(spark):
    rows = [("base", False, None, None, True, 1), ("head", True, "x", "y", True, 1), ("head", True, "x", "x", False, 1), ("head", True, "x", None, True, 0), ("head", True, "x", "x", True, 1)]
    got = many(spark, "s string, r boolean, v string, e string, c boolean, n int", rows, scan.scan_refusal(C("s"), C("r"), C("v"), C("e"), C("c"), C("n")))
    assert got == ["closure_scan_base_input_missing", "closure_scan_stale_checkout", "closure_scan_dirty_checkout", "closure_scan_no_executable_selector", None]


@pytest.mark.parametrize("states, wanted", [(["no_association"], "unassociated"), (["stale_source"], "unavailable"), ([], "no_structural_evidence")])
def test_dispositions(spark, states, wanted):
    assert one(spark, "s array<string>", (states,), graph.disposition_state(L(False), L(0), L(0), C("s"))) == wanted


def test_structural_files_and_path_kinds(spark):
    rows = {"a/B.PY": True, "conf/routes": True, "x/app.routing.yml": True, "application-dev.yml": True, "dev.yml": False, "templates/a.json": True, "templates.json": False, "README.md": False}
    assert many(spark, "p string", [(p,) for p in rows], paths.is_structural(C("p"))) == list(rows.values())
    assert many(spark, "p array<string>", [(["tests/a.py"],), (["src/a.py", "src/b.py"],), (["tests/a.py", "src/b.py"],), ([],)], paths.path_kind(C("p"))) == ["test", "runtime", "mixed", "mixed"]


def test_located_sources(spark):
    schema = "s struct<label:string,url:string,path:string,line_start:int,line_end:int>"
    rows = [(("l", None, "src/a b.py", 3, 5),), (("l", "http://x", "p", 1, 1),), (("l", None, None, None, None),), (("l", None, "p", 2, 2),)]
    got = many(spark, schema, rows, selectors.located(C("s"), L("https://h"), L("o/r"), L("sha"))["url"])
    assert got == ["https://h/o/r/blob/sha/src/a%20b.py#L3-L5", "http://x", None, "https://h/o/r/blob/sha/p#L2"]


def test_intake_of_checks_and_issues(spark):
    from chalkline.sources import packets

    runs = spark.createDataFrame([("r", 1, None, "completed", None, "h")], "review_id string, id int, name string, status string, conclusion string, head_sha string")
    statuses = spark.createDataFrame([("r", 2, "ci", "success", "h"), ("r", 3, None, "pending", "h")], "review_id string, id int, context string, state string, head_sha string")
    assert {(r.observation_id, r.name, r.status, r.conclusion) for r in packets.checks(runs, statuses).collect()} == {("check-run:1", "check run", "completed", ""), ("commit-status:2", "ci", "completed", "success"), ("commit-status:3", "commit status", "pending", "pending")}
    nodes = spark.createDataFrame([("r", "o/r", 1, None, "b", None), ("r", "o/r", 2, "T", None, None), ("q", "o/r", None, "x", "y", None)], "review_id string, repository string, number int, title string, body string, url string")
    found, several = packets.linked_issues(nodes)
    assert {r.title for r in found.collect()} == {"Issue #1", "T"} and [r.review_id for r in several.collect()] == ["r"]


def test_keys_of_selectors_never_miss(spark):
    """Whatever a selector matches it meets by its key, phrases that begin or end inside a word too."""
    rows = [
        ("use Old.x now", "Old", False), ("a.b", "a.b", False), ("  .env ", ".env", False), ("remove the legacy rows", "ove the leg", True), ("the nth", "the nt", True), ("thenth", "hen", True), ("x -> y", "->", True), ("end. Next", "d. n", True),
        ("KELVIN \u212a1", "k1", True), ("say (hello) twice", "(hello", True), ("one two three", "two", True), ("A_b c", "a_B", False), ("tab\there", "tab\there", True), ("nothing", "other", False), ("of of", "f o", True),
    ]
    df = spark.createDataFrame(rows, "content string, value string, phrase boolean").withColumn("key", scan.selector_key(C("value"), C("phrase")))
    got = df.select("content", "value", scan.bounded_match(C("content"), C("value"), C("phrase")).alias("matches"), (C("key").isNull() | F.array_contains(scan.line_keys(C("content"), True), C("key"))).alias("met")).collect()
    assert sum(r.matches for r in got) >= 13 and not [r for r in got if r.matches and not r.met]


def test_refused_checkouts_are_not_read(spark):
    keys = "review_id string, revision_side string, "
    checkouts = spark.createDataFrame([("a", "head", True, "h", "h", True), ("b", "head", True, "old", "h", True), ("c", "head", True, "h", "h", False), ("e", "head", True, "h", "h", True)], keys + "has_root boolean, revision string, expected string, clean boolean")
    files = spark.createDataFrame([(r, "head", "x.py", "Old") for r in "abcde"], keys + "path string, text string")
    plans = spark.createDataFrame([(r, f"CSP:{r}", "T1", s) for r in "abcde" for s in ("head",)], "review_id string, plan_id string, statement_id string, revision_side string")
    wanted = spark.createDataFrame([(r, f"CSP:{r}", f"CSP:{r}:predicate:1", 1, "identifier", "Old", [], None) for r in "abcd"], "review_id string, plan_id string, predicate_id string, number int, kind string, value string, scopes array<string>, source_predicate_id string")
    found, states = scan.checked_scans(checkouts, files, plans, wanted)
    assert {r.review_id for r in found.collect()} == {"a"}
    assert {r.review_id: (r.refusal, r.state) for r in states.collect()} == {
        "a": (None, "complete"), "b": ("closure_scan_stale_checkout", "unavailable"), "c": ("closure_scan_dirty_checkout", "unavailable"),
        "d": ("closure_scan_head_input_missing", "unavailable"), "e": ("closure_scan_no_executable_selector", "unavailable"),
    }


def test_authority_control(spark):
    from chalkline.operators import alignment

    paths = spark.createDataFrame([("r", "good", ["in", "gate", "sink"]), ("r", "bad", ["other", "sink"]), ("r", "end", ["x", "gate"]), ("q", "good", ["in", "gate", "sink"])], "review_id string, path_id string, nodes array<string>")
    bound = spark.createDataFrame([("r", "T1", "good"), ("q", "T1", "good"), ("r", "T2", "end")], "review_id string, claim_id string, path_id string")
    authority = spark.createDataFrame([("r", "T1", "gate"), ("q", "T1", "gate"), ("r", "T2", "gate")], "review_id string, claim_id string, node string")
    revisions = spark.createDataFrame([("r", "complete", 0), ("q", "complete", 2)], "review_id string, state string, n_truncated int")
    doubts = spark.createDataFrame([], "review_id string, claim_id string")
    got = {(r.review_id, r.claim_id): (r.n_controls, r.n_bypasses, r.status) for r in alignment.control(bound, paths, authority, revisions, doubts).collect()}
    assert got == {("r", "T1"): (1, 1, "contradicted"), ("q", "T1"): (1, 0, "partial"), ("r", "T2"): (0, 0, "unverified")}
    whole = revisions.withColumn("n_truncated", L(0))
    assert {(r.review_id, r.claim_id): r.status for r in alignment.control(bound, paths, authority, whole, doubts).collect()}["q", "T1"] == "demonstrated"
    doubted = spark.createDataFrame([("q", "T1")], "review_id string, claim_id string")
    assert {(r.review_id, r.claim_id): r.status for r in alignment.control(bound, paths, authority, whole, doubted).collect()}["q", "T1"] == "partial"

"""Diffs, Markdown, packets and whole reviews, on fixtures of our own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chalkline.operators import extraction
from chalkline.plans import review
from chalkline.sources import diffs, markdown, packets

PATCH = """@@ -10,4 +10,5 @@ def load_ledger():
 keep
-old_total = 1
+new_total = 2
+extra_row = 3
 tail
-gone
\\ No newline at end of file
@@ -30 +31,2 @@
+++ odd
+last
"""


@pytest.fixture(scope="module")
def lines(spark):
    files = spark.createDataFrame([("r", "src/a.py", PATCH), ("r", "src/b.py", "@@ -1 +1 @@\r\n-x\r\n+y")], "review_id string, path string, patch string")
    return diffs.patch_lines(files, ["review_id", "path"]).cache()


def test_diff_lines(lines):
    got = [(r.hunk, r.mark, r.number, r.text) for r in lines.where("path = 'src/a.py' and mark <> '@'").orderBy("position").collect()]
    assert got == [
        (0, " ", 10, "keep"), (0, "-", 11, "old_total = 1"), (0, "+", 11, "new_total = 2"), (0, "+", 12, "extra_row = 3"), (0, " ", 13, "tail"), (0, "-", 13, "gone"),
        (1, " ", 31, "++ odd"), (1, "+", 32, "last"),
    ]


def test_diff_relations(lines):
    got = {(r.path, r.hunk, r.ordinal): (r.kind, [x.number for x in r.added], [x.number for x in r.removed]) for r in diffs.change_relations(lines, ["review_id", "path"]).collect()}
    assert got == {
        ("src/a.py", 0, 0): ("replaced", [11, 12], [11]),
        ("src/a.py", 0, 1): ("removed", [], [13]),
        ("src/a.py", 1, 0): ("added", [32], []),
        ("src/b.py", 0, 0): ("replaced", [1], [1]),
    }
    heads = diffs.hunks(lines, ["path"]).where("path = 'src/a.py'").orderBy("hunk").collect()
    assert [tuple(h)[1:] for h in heads] == [(0, 10, 4, 10, 5), (1, 30, 1, 31, 2)]


BODY = """This adds the ledger.
Second line.

Later paragraph is not the introduction.

## Requirements
- R1: Keep `LedgerTotals` exact
  - for refunds
  - for charges
- Do not touch the exporter
- keep `ledgertotals` EXACT: for refunds
```
- not this
```
## Summary (short)
The ledger reads [rows](http://x) from *storage*.
It is faster.

1. first thing; 2. second thing
## Migration
### Consumers
- `src/app/ledger.py` -> `Ledger.read`
## Completion conditions
- no `LegacyLedger` in `src/app/`
"""


def statements_of(spark, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "body_id int, body string")
    rows = markdown.statements(table, ["body_id"]).orderBy("body_id", "ordinal").collect()
    return [[(r.role, r.purpose, r.kind, r.text, r.line) for r in rows if r.body_id == i] for i in range(len(texts))]


def test_markdown(spark):
    assert statements_of(spark, BODY)[0] == [
        ("intent", "intent", None, "This adds the ledger. Second line.", 1),
        ("obligation", "acceptance", None, "Keep LedgerTotals exact: for refunds", 8),
        ("obligation", "acceptance", None, "Keep LedgerTotals exact: for charges", 9),
        ("obligation", "acceptance", None, "Do not touch the exporter", 10),
        ("claim", "implementation", None, "The ledger reads rows from storage. It is faster.", 16),
        ("claim", "implementation", None, "first thing", 19),
        ("claim", "implementation", None, "second thing", 19),
        (None, None, "consumer_migration", "src/app/ledger.py -> Ledger.read", 22),
        (None, None, "completion_condition", "no LegacyLedger in src/app/", 24),
    ]


LISTS = """- dropped item
text after it is introduction
~~~
```
still fenced
~~~
```
fenced again
```
more introduction
# Scope:
- a
  goes on
    - b
  - c
      - d
\t- e
- a
    b2 is text of a

- f
- g <!-- hidden --> [h](u) **i**
- (1) one; (2) two;
## Why (draft)
a paragraph
over two lines
* AC-1: no label of goals
* O2. a label of goals
### unknown
- not kept
# Change region
## Inputs
- T3: `x`
"""


def test_markdown_lists_and_fences(spark):
    found = statements_of(spark, LISTS, None, "", "\n\nOnly\r\nthis\n\nnot this", "## 1) Acceptance Criteria & x\n- y\n#### Goals -- :\n- y\n- Y")
    scope, goal = ("context", "scope", None), ("objective", "goal", None)
    assert found[0] == [
        ("intent", "intent", None, "text after it is introduction more introduction", 2),
        (*scope, "a goes on: b", 14),
        (*scope, "a goes on: c: d", 16),
        (*scope, "a goes on: c: e", 17),
        (*scope, "a b2 is text of a", 18),
        (*scope, "f", 21),
        (*scope, "g h i", 22),
        (*scope, "one", 23),
        (*scope, "two", 23),
        (*goal, "a paragraph over two lines", 25),
        (*goal, "AC-1: no label of goals", 27),
        (*goal, "a label of goals", 28),
        (None, None, "input_boundary", "x", 33),
    ]
    assert found[1:] == [[], [], [("intent", "intent", None, "Only this", 3)], [(*goal, "y", 4)]]


def test_inline_numbers(spark):
    row = spark.range(1).select(
        *[markdown.numbered_parts(F.lit(x)).alias(str(i)) for i, x in enumerate(["1. one; 2. two; (3) three", "see 1. only"])],
        *[markdown.heading_name(F.lit(x)).alias(f"h{i}") for i, x in enumerate(["2. Goals & aims (draft):", "- 3) What's / new --", "`Test` **plan**"])],
    ).first()
    assert tuple(row) == (["one", "two", "three"], ["see 1. only"], "goals and aims", "3) what's new", "test plan")


def packet(number, body, issue=None, files=(), checks=()):
    records = [{"id": "p", "kind": "pull_request", "repository": "o/r", "url": "u", "title": "Title", "body": body, "revision": "1", "availability": "available"}]
    if issue:
        records.append({"id": "i", "kind": "linked_issue", "repository": "o/r", "url": "v", "title": "Issue", "body": issue, "revision": "1", "availability": "available"})
    inner = {"schema_version": "review_source_packet.v2", "repository": "o/r", "pull_request": number, "title": "Title", "source_url": "u", "head_sha": "h", "base_sha": "b", "source_records": records, "changed_files": list(files), "verification_observations": list(checks), "diagnostics": [], "metadata": {}}
    digest = hashlib.sha256(json.dumps(inner, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return {"schema_version": "analysis_fixture.v3", "source_packet": inner | {"packet_revision": "sha256:" + digest}, "requirements": [], "evidence": []}


def changed(path, patch, status="modified"):
    return {"base_path": None if status == "added" else path, "head_path": path, "status": status, "additions": 1, "deletions": 1, "changes": 2, "source_url": "", "patch": patch}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packets")
    files = [changed("src/app/ledger.py", "@@ -1 +1,2 @@\n-total = 0\n+LedgerTotals = exact(total)\n+refund_rows = charge_rows"), changed("docs/guide.md", "@@ -1 +1 @@\n-a\n+LedgerTotals guide"), changed("src/app/export.py", None, "added")]
    check = {"id": "c1", "name": " Unit  Tests ", "kind": "ci", "status": "completed", "conclusion": "success", "head_sha": "h", "details_url": "", "provider": "Actions"}
    issue = "## Acceptance criteria\n- Issue duty about `LedgerTotals`\n## Out of scope\n- The `Exporter` stays\n"
    broken = packet(3, "x")
    broken["source_packet"]["title"] = "changed later"
    old = packet(4, "x")
    old["schema_version"] = "analysis_fixture.v1"
    for i, p in enumerate([packet(1, BODY, None, files, [check]), packet(2, BODY, issue, files[:1]), broken, old]):
        (folder / f"{i}.json").write_text(json.dumps(p))
    return packets.read_packets(spark, str(folder)).cache()


def test_refusals(read):
    assert {r.review_id: r.refusal for r in read.collect()} == {"o/r#1": None, "o/r#2": None, "o/r#3": "digest", "o/r#4": "schema_version"}


def test_statements(read):
    rows = extraction.parsed(packets.records(read)).cache()
    got = {(r.review_id, r.statement_id): (r.text, r.kind, r.authority) for r in extraction.requirements(rows).collect()}
    assert got == {
        ("o/r#1", "R1"): ("Keep LedgerTotals exact: for refunds", "deliverable", "pr_description"),
        ("o/r#1", "R2"): ("Keep LedgerTotals exact: for charges", "deliverable", "pr_description"),
        ("o/r#1", "G1"): ("Do not touch the exporter", "guardrail", "pr_description"),
        ("o/r#2", "R1"): ("Issue duty about LedgerTotals", "deliverable", "issue"),
        ("o/r#2", "G1"): ("The Exporter stays", "guardrail", "issue"),
    }
    claims = extraction.transformation_claims(rows)
    found = {(r.predicate_id): (r.selector_kind, list(r["values"]), r.expectation, r.role) for r in extraction.predicates(claims).where("review_id = 'o/r#1'").collect()}
    assert found == {
        "TP:T1:1": ("ordered_path", ["src/app/ledger.py", "Ledger.read"], "present_head", "target"),
        "TP:CC1:1": ("symbol", ["LegacyLedger"], "absent_head", "target"),
        "TP:CC1:2": ("repository_path", ["src/app/"], "verified_head", "path_scope"),
    }


def test_whole_review(read):
    tables = review.review(read)
    facts = {r.path: r for r in tables.facts.where("review_id = 'o/r#1'").collect()}
    identity = "hunk:src/app/ledger.py:0:change:0:1,2"
    assert facts["src/app/ledger.py"].id == "E:change_relation:" + hashlib.sha256(f"change_relation\0{identity}".encode()).hexdigest()[:20]
    assert facts["src/app/export.py"].id == "E:changed_file:" + hashlib.sha256(b"changed_file\0src/app/export.py").hexdigest()[:20]
    assert facts["src/app/export.py"].operation == "added" and facts["docs/guide.md"].profile == "document"
    picked = {(r.review_id, r.focus_id, r.target_id): r for r in tables.selections.collect()}
    code = facts["src/app/ledger.py"].id
    assert picked["o/r#1", "R1", code].association == "exact_identifier" and picked["o/r#1", "R1", code].selected
    assert picked["o/r#1", "R1", facts["docs/guide.md"].id].evidence_role == "document_support"
    assert ("o/r#2", "R1", code) in picked
    check = tables.checks.first()
    assert (check.identity.name, check.identity.provider, check.conclusion) == ("unit tests", "actions", "success")
    told = {(r.review_id, r.focus_id, r.slot, r.state) for r in tables.diagnostics.collect()}
    assert ("o/r#1", None, "changed_file", "missing_patch") in told and ("o/r#2", "R1", "verification", "no_association") in told
    assert not any(r == "o/r#1" and slot == "verification" for r, _, slot, _ in told)
    assert {(r.review_id, r.focus_id, r.selected, r.conflicting) for r in tables.check_selections.collect()} == {("o/r#1", f, True, False) for f in ("R1", "R2", "G1")}
    assert all(r.selected for r in tables.claim_selections.collect())


def test_digest_of_supplied_notes(spark):
    from chalkline.operators.facts import supplied_facts

    notes = spark.createDataFrame([("Seen", "log", "ci", [("l", None, "p", 1, None)], ["R1"])], f"summary string, kind string, classification string, sources {packets.SOURCES}, statement_ids array<string>")
    identity = json.dumps({"summary": "Seen", "kind": "log", "classification": "ci", "sources": [{"label": "l", "url": None, "path": "p", "line_start": 1, "line_end": None}], "statement_ids": ["R1"]}, sort_keys=True, separators=(",", ":"))
    assert supplied_facts(notes).first().id == "E:provided:" + hashlib.sha256(f"provided\0{identity}".encode()).hexdigest()[:20]
    assert F is not None


def test_claims_of_one_file_are_dealt(spark):
    """A thousand claims of one partition came out of one task before."""
    rows = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("review_id"), F.lit("T1").alias("claim_id"), F.lit("change").alias("kind"), F.lit("`a -> b`").alias("raw"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = extraction.predicates(rows).where("selector_kind = 'ordered_path'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(found) > 1 and sum(r["count"] for r in found) == 1000

"""Authored statements with their ids and authority, of many reviews at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import headings as H
from chalkline.operators.stages import kept
from chalkline.sources.markdown import statements

#: Records whose body may speak for the issue; more than one of them speak for none.
ISSUE_KINDS = ("linked_issue", "ticket")


def requirement_kind(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    starts = plain.startswith(H.GUARDRAIL_STARTS[0])
    for start in H.GUARDRAIL_STARTS[1:]:
        starts = starts | plain.startswith(start)
    return F.when(starts, "guardrail").otherwise("deliverable")


def bodies(records: DataFrame) -> DataFrame:
    """review_id, origin (issue, pr_description) and body of records (review_id, ordinal, kind, body)."""
    pr = records.where("kind = 'pull_request'").groupBy("review_id").agg(F.min_by(F.coalesce("body", F.lit("")), "ordinal").alias("body"))
    issue = records.where(F.col("kind").isin(*ISSUE_KINDS)).groupBy("review_id").agg(F.count("*").alias("n"), F.min("body").alias("body")).where("n = 1")
    return issue.select("review_id", F.lit("issue").alias("origin"), "body").union(pr.select("review_id", F.lit("pr_description"), "body"))


def parsed(records: DataFrame) -> DataFrame:
    """Statements of bodies() in order: issues' before descriptions'."""
    rows = statements(bodies(records), ["review_id", "origin"])
    return rows.withColumn("place", F.when(F.col("origin") == "issue", 0).otherwise(1))


def _numbered(rows: DataFrame, prefix: Column, order: list[str]) -> DataFrame:
    """rows with statement_id: the prefix and a number of its own count in each review."""
    marked = rows.withColumn("prefix", prefix)
    number = F.row_number().over(Window.partitionBy("review_id", "prefix").orderBy(*order))
    return marked.withColumn("statement_id", F.concat("prefix", number.cast("string"))).drop("prefix")


def requirements(rows: DataFrame) -> DataFrame:
    """review_id, statement_id (R or G), text, kind, purpose and authority: the issue's obligations, or else the
    description's; then the issue's boundaries as guardrails. Texts count once, whatever their case."""
    duties = rows.where("role = 'obligation'")
    whole = Window.partitionBy("review_id")
    duties = duties.withColumn("from_issue", F.max(F.col("origin") == "issue").over(whole)).where((F.col("origin") == "issue") == F.col("from_issue")).withColumn("part", F.lit(0)).drop("from_issue")
    limits = rows.where("purpose = 'boundary' and origin = 'issue'").withColumn("part", F.lit(1))
    both = duties.unionByName(limits)
    first = Window.partitionBy("review_id", F.lower("text")).orderBy("part", "ordinal")
    once = both.withColumn("n", F.row_number().over(first)).where("n = 1")
    once = once.withColumn("kind", F.when(F.col("purpose") == "boundary", "guardrail").otherwise(requirement_kind(F.col("text"))))
    numbered = _numbered(once, F.when(F.col("kind") == "guardrail", "G").otherwise("R"), ["part", "ordinal"])
    return numbered.select("review_id", "statement_id", "text", F.lit("obligation").alias("role"), F.when(F.col("kind") == "guardrail", "guardrail").otherwise("acceptance").alias("purpose"), F.col("origin").alias("authority"), "kind", "section", "line")


def other_statements(rows: DataFrame) -> DataFrame:
    """Objectives (O), scope (S), the issue's verification expectations (V) and the description's claims (C, B, VC)."""
    parts = {
        "O": rows.where("role = 'objective'").withColumn("as_role", F.lit("objective")),
        "S": rows.where("purpose = 'scope'").withColumn("as_role", F.lit("context")),
        "V": rows.where("purpose = 'verification' and origin = 'issue'").withColumn("as_role", F.lit("context")),
        "C": rows.where("role = 'claim' and origin = 'pr_description'").withColumn("as_role", F.lit("claim")),
    }
    out = None
    for prefix, part in parts.items():
        own = F.lit(prefix) if prefix != "C" else F.when(F.col("purpose") == "baseline", "B").when(F.col("purpose") == "verification", "VC").otherwise("C")
        numbered = _numbered(part, own, ["place", "ordinal"]).select("review_id", "statement_id", "text", F.col("as_role").alias("role"), "purpose", F.col("origin").alias("authority"), F.lit(None).cast("string").alias("kind"), "section", "line")
        out = numbered if out is None else out.unionByName(numbered)
    return out


def intents(rows: DataFrame, packets: DataFrame) -> DataFrame:
    """review_id, statement_id I1, text and authority: the description's introduction, or else the title (packets: review_id, title)."""
    intro = rows.where("role = 'intent' and origin = 'pr_description'").select("review_id", F.col("text").alias("intro"))
    joined = packets.select("review_id", "title").join(intro, "review_id", "left")
    authority = F.when(F.col("intro").isNotNull(), "pr_description").otherwise("pr_title")
    return joined.select("review_id", F.lit("I1").alias("statement_id"), F.coalesce("intro", "title").alias("text"), authority.alias("authority"))


def transformation_claims(rows: DataFrame) -> DataFrame:
    """review_id, claim_id (T or CC), kind, text, raw of the description's transformation sections."""
    own = rows.where("kind is not null and origin = 'pr_description'")
    return _numbered(own, F.when(F.col("kind") == "completion_condition", "CC").otherwise("T"), ["ordinal"]).select("review_id", F.col("statement_id").alias("claim_id"), "kind", "text", "raw", "section", "line")


def selector_kind(value: Column) -> Column:
    plain = F.lower(value)
    hit = F.lit(False)
    for start in H.PATH_STARTS:
        hit = hit | plain.startswith(start)
    for end in H.PATH_ENDS:
        hit = hit | plain.endswith(end)
    return F.when(hit, "repository_path").otherwise("symbol")


def claim_expectation(kind: Column) -> Column:
    out = F.lit("reference")
    for own, expectation in H.EXPECTATIONS.items():
        out = F.when(kind == own, expectation).otherwise(out)
    return out


def predicates(claims: DataFrame) -> DataFrame:
    """review_id, claim_id, predicate_id, selector_kind, values, expectation and role of claims' code spans.

    Spans that arrows join, in one span or between spans, are one ordered path. Text is cut at ticks, so odd pieces are
    spans and the pieces around them tell scopes and negations. Claims are dealt first: a small file is one task, and the
    expressions take far longer than reading it. Spans are written once, as all that follows would repeat their expression.
    """
    own = claims.select("review_id", "claim_id", "kind", "raw")
    cut = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "review_id", "claim_id").withColumn("pieces", F.split("raw", "`", -1))
    spans = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.floor((F.size("pieces") - 1) / 2), F.lit(1))), lambda i: F.struct(
        F.trim(F.coalesce(F.try_element_at(F.col("pieces"), (2 * i).cast("int")), F.lit(""))).alias("value"),
        F.coalesce(F.try_element_at(F.col("pieces"), (2 * i - 1).cast("int")), F.lit("")).alias("before"),
        F.coalesce(F.try_element_at(F.col("pieces"), (2 * i + 1).cast("int")), F.lit("")).alias("after"),
    )), lambda s: s["value"] != "")
    cut = kept(cut.select("review_id", "claim_id", "kind", spans.alias("spans"))).where(F.size("spans") > 0).withColumn("kind_expects", claim_expectation(F.col("kind")))
    inner = F.filter(F.transform(F.split(F.col("spans")[0]["value"], H.ARROW), lambda x: F.trim(x)), lambda x: x != "")
    between = F.forall(F.slice("spans", 1, F.size("spans") - 1), lambda s: s["after"].rlike(H.ARROW))
    chain = F.when((F.size("spans") == 1) & (F.size(inner) > 1), inner).when((F.size("spans") > 1) & between, F.transform("spans", lambda s: s["value"]))
    cut = cut.withColumn("chain", chain)
    keys = ["review_id", "claim_id"]
    paths = cut.where("chain is not null").select(*keys, F.lit(1).alias("n"), F.lit("ordered_path").alias("selector_kind"), F.col("chain").alias("values"), F.col("kind_expects").alias("expectation"), F.lit("target").alias("role"))
    each = cut.where("chain is null").select(*keys, "kind", "kind_expects", F.posexplode("spans").alias("at", "s"))
    negated = (F.col("kind") == "completion_condition") & (F.col("s.before").rlike("(?i)" + H.NEGATED_BEFORE) | F.col("s.after").rlike("(?i)" + H.NEGATED_AFTER))
    own_kind = selector_kind(F.col("s.value"))
    scoped = (own_kind == "repository_path") & F.col("s.before").rlike("(?i)" + H.SCOPE_BEFORE)
    each = each.select(*keys, "at", own_kind.alias("selector_kind"), F.col("s.value").alias("value"), F.when(negated, "absent_head").otherwise(F.col("kind_expects")).alias("expectation"), F.when(scoped, "path_scope").otherwise("target").alias("role"))
    each = each.groupBy(*keys, "selector_kind", "value", "expectation", "role").agg(F.min("at").alias("at"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).select(*keys, "n", "selector_kind", F.array("value").alias("values"), "expectation", "role")
    return paths.unionByName(each).select(*keys, F.concat(F.lit("TP:"), "claim_id", F.lit(":"), F.col("n").cast("string")).alias("predicate_id"), "selector_kind", "values", "expectation", "role")
